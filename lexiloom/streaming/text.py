"""Streaming readers, stateless transformations and file sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.corpus import drop_blank, drop_headings
from ..operators.vocab import tokenize
from ..session import shared_dir


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int | None = None,
                **options) -> DataFrame:
    """A folder as a stream of its files; ``files_per_trigger`` bounds a micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def clean_tokens(lines: DataFrame, keys: list[str], text: str = "text", headings: bool = True) -> DataFrame:
    """Line filters and tokens, with the functions of the batch path: they work on both kinds of table."""
    kept = drop_blank(lines, text)
    return tokenize(drop_headings(kept, text) if headings else kept, keys, text)


def start_sink(df: DataFrame, path: str, checkpoint: str, by: list[str] | None = None) -> StreamingQuery:
    """Append a stream to Parquet files, once each, and stop when the input is drained."""
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    writer = writer.partitionBy(*by) if by else writer
    return writer.outputMode("append").trigger(availableNow=True).start(path)


def start_batches(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a batch function on every micro-batch, and stop when the input is drained."""
    return (df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def drain(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Run a stream to its end into the shared folder and return what was written."""
    spark = df.sparkSession
    target, checkpoint = shared_dir(spark, f"{name}-out"), shared_dir(spark, f"{name}-log")
    start_sink(df, target, checkpoint, by).awaitTermination()
    return spark.read.schema(df.schema).parquet(target)
