"""Scalar functions: text normalisers and similarities."""
