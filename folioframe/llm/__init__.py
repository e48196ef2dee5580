"""Operators for large text corpora: ten methods, each a function of DataFrames."""
