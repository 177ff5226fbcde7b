"""Readers and normalisers."""
