"""Batch analyses applied to arriving files by Structured Streaming."""
