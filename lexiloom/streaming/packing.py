"""Packing on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ordered import running_total
from ..operators.packing import cut_stream, pack_batches, reverse_blocks
from .text import start_batches


def with_shard(df: DataFrame, row: str, ids: int, out: str = "shard") -> DataFrame:
    """Number the runs of ``ids`` neighbouring row ids. As a key of :func:`pack_carry` a run is a stream of its own,
    with a remainder of its own."""
    return df.withColumn(out, F.floor(F.col(row) / ids).cast("bigint"))


def pack_carry(df: DataFrame, length: int, path: str, checkpoint: str, keys: Sequence[str], row: str | Sequence[str] = "row_id",
               tokens: str = "tokens", reverse: bool = True, **options) -> StreamingQuery:
    """Blocks per key, the remainder kept for the next micro-batch; read them with :func:`blocks` and :func:`rests`.

    The rows of a micro-batch are taken in the order of ``row`` (integers); micro-batches follow in file order. A key's
    state is one row: its next block's number and a remainder of fewer than ``length`` tokens. It enters the next
    micro-batch as the key's first row, with all tokens before it as its size, so that the bucketed prefix sum numbers
    tokens of the whole stream, in many tasks however hot the key. A micro-batch writes its own folder, blocks and
    remainders at once, and the state from them; repeated after a failure, it overwrites both.
    """
    order = [row] if isinstance(row, str) else list(row)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    state_schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "next long", f"`{tokens}` array<string>"])

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*keys, *order, tokens)
        before = spark.read.schema(state_schema).parquet(f"{path}/state/{number - 1}") if number else None
        if before is not None:  # no order key: NULL comes first
            rows = rows.unionByName(before, allowMissingColumns=True)
        else:
            rows = rows.withColumn("next", F.lit(None).cast("long"))
        past = F.col("next") * length
        placed = running_total(rows, F.coalesce(past, F.lit(0)) + F.size(tokens), "__sum", order, keys, **options)
        placed = placed.withColumn("__start", F.coalesce(past, F.col("__sum")))
        made = cut_stream(placed, length, "__start", keys, [tokens]).withColumn("full", F.size(tokens) == length)
        if reverse:
            made = made.withColumn(tokens, F.when(F.col("full"), F.reverse(tokens)).otherwise(F.col(tokens)))
        here = f"{path}/blocks/micro_batch={number}"
        made.write.mode("overwrite").parquet(here)
        written = spark.read.schema(made.schema).parquet(here)
        none = F.array().cast("array<string>")
        after = written.select(*keys, (F.col("block_id") + F.col("full").cast("long")).alias("next"), F.when(F.col("full"), none).otherwise(F.col(tokens)).alias(tokens))
        after = after if before is None else after.unionByName(before)
        newest = F.max_by(F.struct("next", tokens), F.struct("next", F.size(tokens).alias("n")))
        after.groupBy(*keys).agg(newest.alias("s")).select(*keys, "s.*").write.mode("overwrite").parquet(f"{path}/state/{number}")

    return start_batches(df, handle, checkpoint)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """``(*keys, block_id, tokens, micro_batch)`` of all full blocks that :func:`pack_carry` wrote."""
    return spark.read.parquet(f"{path}/blocks").where("full").drop("full")


def rests(spark: SparkSession, path: str, keys: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """``(*keys, block_id, tokens)``: what no block holds yet, after the last micro-batch; it may be empty."""
    written = spark.read.parquet(f"{path}/blocks").select(
        *keys, (F.col("block_id") + F.col("full").cast("long")).alias("block_id"),
        F.when(F.col("full"), F.array().cast("array<string>")).otherwise(F.col(tokens)).alias(tokens))
    newest = F.max_by(F.struct("block_id", tokens), F.struct("block_id", F.size(tokens).alias("n")))
    return written.groupBy(*keys).agg(newest.alias("s")).select(*keys, "s.*")


def pack_drop(df: DataFrame, length: int, path: str, checkpoint: str, row: str | Sequence[str] = "row_id", tokens: str = "tokens",
              rows_per_batch: int = 1000) -> StreamingQuery:
    """Batch packing of every micro-batch; each batch of rows drops its remainder.

    A micro-batch writes its own folder, overwriting it when it is repeated after a failure.
    """
    order = [row] if isinstance(row, str) else list(row)

    def handle(batch: DataFrame, number: int) -> None:
        packed = pack_batches(batch, length, order, [tokens], rows_per_batch=rows_per_batch)
        reverse_blocks(packed, tokens).write.mode("overwrite").parquet(f"{path}/micro_batch={number}")

    return start_batches(df, handle, checkpoint)
