"""Readers that turn packages into rows."""
