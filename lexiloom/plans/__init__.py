"""Whole queries: the given tables in, one result table out."""
