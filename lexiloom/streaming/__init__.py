"""Structured Streaming: the batch column functions over streams, and packing with kept remainders."""
