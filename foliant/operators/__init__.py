"""Operators: DataFrames in, a DataFrame out. None of them collects more than a bounded number of rows."""
