"""Whole-table operators: DataFrames and column names in, a DataFrame out."""
