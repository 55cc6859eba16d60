"""Relational operators over findings tables."""
