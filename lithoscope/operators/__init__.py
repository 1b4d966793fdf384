"""Analyses: profile, histograms, correlations, quality, anomalies, storage advice and rewriting."""
