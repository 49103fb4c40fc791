"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames, covers all rows and whole texts, and states in its docstring
what it does with nulls, empty texts, repeated rows and empty tables.
"""
