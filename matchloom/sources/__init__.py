"""Readers, writers and adapters of record tables."""
