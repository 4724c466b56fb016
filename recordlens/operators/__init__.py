"""Operators over DataFrames: matching, validation, catalog lookups, freshness and dependency graphs."""
