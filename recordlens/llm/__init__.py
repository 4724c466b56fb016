"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; it stands on PySpark
alone (and tokenizers, xxhash, numpy and pyarrow where a module says so).
"""
