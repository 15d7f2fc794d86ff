"""Operators for training data: each takes and returns DataFrames over a table of documents."""
