"""Composed queries and the tables between their steps."""
