"""Logical types and formatting of values."""
