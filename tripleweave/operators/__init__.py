"""Alignment operators on triple, value and match tables."""
