"""Operators: each takes DataFrames and returns a DataFrame, lazily unless its docstring says otherwise."""
