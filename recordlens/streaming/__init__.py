"""Matching and validation on streams."""
