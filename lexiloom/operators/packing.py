"""Fixed-length blocks from ragged token arrays.

Documents are cut into *slices*, one per block they touch, never into single tokens. Tokens travel in a
shuffle once, to the tasks that know their place in the stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import BITS, BUCKET, dense_index, running_total

BATCH_ROWS = 1000


def _slices(df: DataFrame, start: str, columns: Sequence[str], length: int, keep: Sequence[str]) -> DataFrame:
    """One row per document and block: ``block_id``, ``__off`` and the block's part of every column."""
    begin, size = F.col(start), F.size(columns[0])
    blocks = F.sequence(F.floor(begin / length).cast("bigint"),
                        F.floor((begin + size - 1) / length).cast("bigint"))
    cut = df.where(size > 0).select(*keep, start, *columns, F.explode(blocks).alias("block_id"))
    low = F.greatest(F.col("block_id") * length, begin)
    high = F.least((F.col("block_id") + 1) * length, begin + size)
    return cut.select(
        *keep, "block_id", low.alias("__off"),
        *[F.slice(c, (low - begin + 1).cast("int"), (high - low).cast("int")).alias(c) for c in columns])


def _assemble(slices: DataFrame, keys: Sequence[str], columns: Sequence[str], length: int) -> DataFrame:
    """Blocks from slices, in offset order; blocks that are not full are dropped."""
    parts = (slices.groupBy(*keys, "block_id")
             .agg(F.sort_array(F.collect_list(F.struct("__off", *columns))).alias("__parts"),
                  F.sum(F.size(columns[0])).alias("__size"))
             .where(F.col("__size") == length))
    return parts.select(*keys, "block_id", *[F.flatten(F.col("__parts")[c]).alias(c) for c in columns])


def cut_stream(df: DataFrame, length: int, start: str, keys: Sequence[str] = (), columns: Sequence[str] = ("tokens",)) -> DataFrame:
    """``(*keys, block_id, *columns)``: rows that know their first token's place, as blocks, full or not."""
    parts = (_slices(df, start, columns, length, keys).groupBy(*keys, "block_id")
             .agg(F.sort_array(F.collect_list(F.struct("__off", *columns))).alias("__parts")))
    return parts.select(*keys, "block_id", *[F.flatten(F.col("__parts")[c]).alias(c) for c in columns])


def pack_stream(df: DataFrame, length: int, order: Sequence[str] = ("row_id",),
                columns: Sequence[str] = ("tokens",), keys: Sequence[str] = (), reverse: bool = True,
                size: Column | None = None, bits: int = BITS, levels: int = 1) -> DataFrame:
    """Whole-corpus packing: ``(*keys, block_id, *columns)``, the last part of a stream dropped.

    The tokens of every document are reversed (``reverse``), documents follow one another in ``order``, and
    the stream is cut into blocks of ``length``. Documents come together by bucket, a run of neighbouring
    documents. A block that lies inside one bucket is built right there, without a further shuffle; only the
    one or two blocks at a bucket's borders meet in a second, small shuffle. ``size`` may name a stored
    token count, so that the bucket totals are read from a narrow column.
    """
    size = F.size(columns[0]).cast("bigint") if size is None else size
    narrow = df.select(*keys, *order, *columns, size.alias("__n"))
    placed = running_total(narrow, F.col("__n"), "__start", order, keys, bits=bits, levels=levels, keep_bucket=True)
    if reverse:
        placed = placed.withColumns({c: F.reverse(c) for c in columns})
    group = [*keys, BUCKET]
    slices = _slices(placed, "__start", columns, length, [*group, "__low", "__high"])
    first, last = F.col("block_id") * length, (F.col("block_id") + 1) * length
    inside = (first >= F.col("__low")) & (last <= F.col("__high"))
    inner = _assemble(slices.where(inside), group, columns, length).drop(BUCKET)
    border = _assemble(slices.where(~inside), keys, columns, length)
    return inner.unionByName(border)


def pack_batches(df: DataFrame, length: int, order: Sequence[str] = ("row_id",),
                 columns: Sequence[str] = ("tokens",), keys: Sequence[str] = (),
                 rows_per_batch: int = BATCH_ROWS, index: str | None = None, shards: int | None = None,
                 rows: int | Column | None = None) -> DataFrame:
    """Per-batch packing: ``(*keys, batch_id, block_id, *columns)``; each batch's last part is dropped.

    A batch is ``rows_per_batch`` consecutive rows. ``index`` names a dense zero-based row index; without it
    one is made from ``order``. With ``shards`` (and the row count ``rows``) the rows are first divided into
    that many contiguous shards, as parallel workers do, and batches do not cross shards. A batch has a
    fixed number of rows, so it is a bounded group: one shuffle by batch, nothing after it.
    """
    if index is None:
        index = "__index"
        df = dense_index(df.select(*keys, *order, *columns), index, order, keys)
    batch = [*keys, "batch_id"]
    if shards:
        if rows is None:
            raise ValueError("shards need the row count")
        rows = rows if isinstance(rows, Column) else F.lit(rows)
        small, larger = F.floor(rows / shards), rows % shards
        edge = larger * (small + 1)
        shard = F.when(F.col(index) < edge, F.floor(F.col(index) / (small + 1))).otherwise(
            larger + F.floor((F.col(index) - edge) / F.greatest(small, F.lit(1))))
        first = F.least(F.col("shard") * (small + 1), F.col("shard") * small + larger)
        df = df.withColumn("shard", shard.cast("bigint"))
        df = df.withColumn("batch_id", F.floor((F.col(index) - first) / rows_per_batch).cast("bigint"))
        batch = [*keys, "shard", "batch_id"]
    else:
        df = df.withColumn("batch_id", F.floor(F.col(index) / rows_per_batch).cast("bigint"))
    before = Window.partitionBy(*batch).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn("__start", F.coalesce(
        F.sum(F.size(columns[0]).cast("bigint")).over(before), F.lit(0).cast("bigint")))
    return _assemble(_slices(placed, "__start", columns, length, batch), batch, columns, length)


def reverse_blocks(blocks: DataFrame, ids: str = "input_ids", labels: str = "labels",
                   masks: Sequence[str] = (), reverse_masks: bool = False) -> DataFrame:
    """Reverse every block's ids and copy them to ``labels``.

    The masks stay as they are unless ``reverse_masks`` is set: a special-token mask is then no longer
    aligned with the ids, which is what existing data files hold.
    """
    changed = {ids: F.reverse(ids), labels: F.reverse(ids)}
    if reverse_masks:
        changed.update({m: F.reverse(m) for m in masks})
    return blocks.withColumns(changed)


def stack_batches(df: DataFrame, size: int, length: int, order: Sequence[str],
                  columns: Sequence[str] = ("input_ids",), keys: Sequence[str] = (),
                  index: str | None = None) -> DataFrame:
    """Batches of ``size`` examples as ``array<array>`` columns; an example of another length raises."""
    if index is None:
        index = "__index"
        df = dense_index(df.select(*keys, *order, *columns), index, order, keys)
    checked = [
        F.when(F.size(c) == length, F.col(c))
        .otherwise(F.raise_error(F.format_string(f"{c}: length %d, not {length}", F.size(c)))).alias(c)
        for c in columns]
    rows = df.select(*keys, F.floor(F.col(index) / size).cast("bigint").alias("batch_id"),
                     F.col(index).alias("__i"), *checked)
    packed = rows.groupBy(*keys, "batch_id").agg(
        F.sort_array(F.collect_list(F.struct("__i", *columns))).alias("__b"))
    return packed.select(*keys, "batch_id", *[F.col("__b")[c].alias(c) for c in columns])


def wrong_lengths(df: DataFrame, length: int, column: str = "input_ids") -> DataFrame:
    """Rows whose array is not ``length`` long."""
    return df.where(F.size(column) != length)
