"""Quillon: query-item relevance analytics on PySpark DataFrames."""
