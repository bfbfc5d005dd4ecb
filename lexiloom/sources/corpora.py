"""Corpus readers and writers."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import union_corpora
from ..operators.labels import kshot

TEXT_EXTENSIONS = ("csv", "json", "txt")


def read_text_file(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """A csv, json or txt file by its extension; any other raises ``ValueError``."""
    extension = os.path.splitext(path)[1].lstrip(".")
    if extension not in TEXT_EXTENSIONS:
        raise ValueError(f"{path!r} should be a csv, a json or a txt file.")
    reader = spark.read.options(**options)
    if extension == "txt":
        return reader.text(path).withColumnRenamed("value", "text")
    reader = reader.schema(schema) if schema else reader
    return reader.csv(path, header=True) if extension == "csv" else reader.json(path)


def read_corpora(spark: SparkSession, names: Sequence[str], configs: Sequence[str], base: str = "",
                 fmt: str = "parquet") -> DataFrame:
    """Several corpora in list order. Names and configurations are paired; the longer list is cut.

    A corpus lies at ``base/name`` or, with a configuration other than ``"None"``, at ``base/name/config``.
    """
    parts = []
    for name, config in zip(names, configs):
        path = "/".join(p for p in (base, name, None if config == "None" else config) if p)
        parts.append((name if config == "None" else f"{name}/{config}", spark.read.format(fmt).load(path)))
    return union_corpora(parts)


def read_shards(spark: SparkSession, pattern: str | Sequence[str], fmt: str = "parquet") -> DataFrame:
    """All files of one or several glob patterns as one table; no file raises ``FileNotFoundError``."""
    patterns = [pattern] if isinstance(pattern, str) else list(pattern)
    try:
        return spark.read.format(fmt).load(patterns)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no file matches {patterns}") from error
        raise


def read_processed(spark: SparkSession, folder: str, split: str, k: int = -1,
                   order: Sequence[str] = ("sent_id",), tags: str = "tags") -> DataFrame:
    """One split of a processed folder, cut to K sentences per type when ``k`` is positive."""
    rows = spark.read.parquet(folder).where(F.col("split") == split)
    return kshot(rows, k, order, tags).drop("type") if k > 0 else rows


def write_once(df: DataFrame, path: str, by: Sequence[str] = ("split",)) -> None:
    """Write a Parquet folder per split; do nothing if the folder exists."""
    df.write.mode("ignore").partitionBy(*by).parquet(path)
