"""All registered queries and their SQL."""

from __future__ import annotations

from . import corpora, packing, runs, streams, tagging, vectors

FAMILIES = [tagging, corpora, packing, vectors, runs, streams]
QUERIES = {name: fn for family in FAMILIES for name, fn in family.QUERIES.items()}
ORACLES = {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
