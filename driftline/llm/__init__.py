"""Operators of a training-data pipeline: thirteen of them, each usable alone, plus their queries.

Nothing else in the library imports this subpackage.
"""
