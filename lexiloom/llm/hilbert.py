"""Shards along a Hilbert curve over several metadata columns.

Each dimension is quantised to ``bits`` bits: numbers by the logarithm of their size, strings by a hash. The Hilbert
index of the cell orders the rows, so a run of rows covers a compact part of every dimension and a reader can skip
shards by any of them. Rows of one cell are ordered by the text's checksum and hash, then by id: equal texts with equal
metadata lie side by side. The order is cut into runs whose row counts differ by one at most (law ``rows``).

Only narrow rows are sorted: ranges over the whole order, a sort inside each, written to the shared folder once; a
row's rank is its place in its range plus the rows of the ranges before, of which there is one narrow row each.

Cases: a null text has size 8 and no bytes, null dimensions fall into cell 0, a null ``doc_id`` comes first among
equals, equal rows take slots of their own, an empty table gives no row, and fewer rows than shards leave shards
empty. Texts are only measured, never collected.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored

BITS = 6
SHARDS = 24
#: bytes of a row besides its text
ROW_BYTES = 8


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the curve of cells (rows of n coordinates below 2^bits); neighbours on it differ by one step."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    # undo the rotations and reflections of the sub-cubes, from the largest down
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            flip = x[i] & q > 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(flip, q - 1, swap)
            x[i] ^= swap
    # Gray code over all coordinates
    for i in range(1, n):
        x[i] ^= x[i - 1]
    odd = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        odd ^= np.where(x[-1] & q > 0, q - 1, 0)
    x ^= odd
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | x[i] >> b & 1
    return out


def level(number: Column, bits: int = BITS) -> Column:
    """A non-negative number's cell: steps of a quarter of its logarithm to base 2."""
    return F.least(F.floor(4 * F.log2(F.greatest(number, F.lit(1)))), F.lit((1 << bits) - 1)).cast("int")


def place(value: Column, bits: int = BITS) -> Column:
    """A string's cell."""
    return F.pmod(F.xxhash64(value), F.lit(1 << bits)).cast("int")


def _index(bits: int):
    @F.pandas_udf("long")
    def index(cells: pd.Series) -> pd.Series:
        if not len(cells):
            return pd.Series([], dtype="int64")
        return pd.Series(hilbert_index(np.stack(cells.to_numpy()), bits))

    return index


def shards(docs: DataFrame, dims: dict[str, Column], n_shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, the dimensions' cells, hilbert, shard and slot of every row of ``docs``.

    ``dims``: cells by name, integer columns below 2^bits over ``docs``.
    """
    raw = F.encode(F.col("text").cast("string"), "UTF-8")
    cells = [F.coalesce(c, F.lit(0)).cast("int").alias(name) for name, c in dims.items()]
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
        F.coalesce(F.crc32(raw), F.lit(0)).alias("text_crc32"), F.xxhash64("text").alias("text_hash"), *cells)
    keyed = narrow.withColumn("hilbert", _index(bits)(F.array(*dims)))
    order = ["hilbert", "text_crc32", "text_hash", "doc_id"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    # within a partition the generated ids count its rows from zero
    placed = stored(ranged.select("*", F.spark_partition_id().alias("part"),
                                  F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("pos")), "hilbert")
    parts = placed.groupBy("part").agg(F.count("*").alias("n"))
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"),
                          F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    return (placed.join(F.broadcast(starts), "part")  # one row per range of the sort
            .withColumn("rank", F.col("before") + F.col("pos")).withColumn("shard", F.expr(f"rank * {n_shards} div total").cast("int"))
            .select("doc_id", (F.col("bytes") + ROW_BYTES).alias("size"), "text_crc32", *dims, "hilbert", "shard",
                    (F.col("rank") - F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}")).alias("slot")))


def pruning(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """Least and largest cell of every dimension per shard: what a reader needs to skip shards."""
    ends = reduce(lambda cols, d: [*cols, F.min(d).alias(f"{d}_min"), F.max(d).alias(f"{d}_max")], dims, [])
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("bytes"), *ends)
