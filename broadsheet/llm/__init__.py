"""Operators for preparing language-model training data.

Every operator takes and returns DataFrames.  Nothing else in the library
imports this subpackage.
"""
