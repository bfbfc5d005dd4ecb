"""Operators: DataFrame in, DataFrame out, with explicit order keys."""
