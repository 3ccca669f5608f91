"""Readers, normalisation and the derived market tables."""
