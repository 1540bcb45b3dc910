"""Relational operators over publication tables."""
