"""Operators for text corpora used as training data. Nothing outside this subpackage imports it."""
