"""Operators for preparing language-model training data.

Nothing outside this package imports it; the package may be removed whole.
Each module keeps one operator with a general interface over DataFrames, and
``queries`` applies every operator to the tables of a data folder.
"""
