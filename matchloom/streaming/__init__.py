"""Incremental matching of arriving records."""
