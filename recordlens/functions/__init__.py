"""Column functions: similarity, normalization and validation predicates."""
