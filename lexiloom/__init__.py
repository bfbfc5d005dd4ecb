"""Token-sequence analytics on Spark: pack, reverse, tag, decode and evaluate corpora as DataFrames."""

__version__ = "0.1.0"
