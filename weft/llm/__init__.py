"""Operators for building training corpora, each a function from DataFrames to DataFrames.

Nothing else in the library imports this subpackage.
"""
