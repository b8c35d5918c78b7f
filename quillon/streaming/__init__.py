"""Incremental forms of the popularity counts."""
