"""Corpus operators for building training data: thirteen operators and their queries.

Nothing else in the library imports this subpackage.
"""
