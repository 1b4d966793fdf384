"""Parquet sources, their footers, and the catalog of open ones."""
