"""Aggregates, searches, filters and fusion over DataFrames with vector columns."""
