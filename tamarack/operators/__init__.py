"""Relational operators that take and give DataFrames."""
