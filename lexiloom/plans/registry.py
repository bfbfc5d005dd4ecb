"""Registration of queries beside their SQL."""

from __future__ import annotations


def registry():
    """``(QUERIES, ORACLES, query)``: two tables and the decorator that fills them."""
    queries, oracles = {}, {}

    def query(name, sql=None):
        def register(fn):
            queries[name] = fn
            if sql is not None:
                oracles[name] = sql
            return fn
        return register

    return queries, oracles, query
