"""Inputs that Spark derives from the given tables. Every rule uses only length, position and md5."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import words

TYPES = ["PER", "ORG", "LOC", "MISC"]
# a bucket of a run's events is 2 ** 26 microseconds, 67 seconds
BUCKET_BITS = 26


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


# bytes of text that a task tags at once
TAGGED_BYTES = 2 << 20
_LISTS = pa.list_(pa.string())
LISTS = ("tokens", "gold", "pred")


def _tags(kind: np.ndarray, first: np.ndarray) -> pa.Array:
    """BIO tags of kinds (-1 for none); ``first`` marks the tokens that begin a sentence."""
    inside = np.append(False, kind[1:] == kind[:-1])[: len(kind)] & ~first
    names = pa.array(["O", *[f"B-{t}" for t in TYPES], *[f"I-{t}" for t in TYPES]])
    return names.take(pa.array(np.where(kind < 0, 0, kind + 1 + inside * len(TYPES))))


def _tagged(doc_id: pa.Array, text: pa.Array, columns: Sequence[str] = LISTS) -> pa.RecordBatch:
    """The sentences of some texts, with their tags by length and position of the tokens."""
    split = pc.split_pattern_regex(text, "[.\n]+")
    sizes = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    sent = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    pieces = pc.list_flatten(split)
    for gap in "\t\r":
        if pc.any(pc.match_substring(pieces, gap)).as_py():
            pieces = pc.replace_substring(pieces, gap, " ")
    cut = pc.split_pattern(pieces, " ")  # empty tokens go below; a regular expression takes five times as long
    owner = pc.list_parent_indices(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    token = pc.list_flatten(cut)
    solid = pc.greater(pc.binary_length(token), 0)
    token, owner = token.filter(solid), owner[solid.to_numpy(zero_copy_only=False)]
    first = np.append(True, owner[1:] != owner[:-1])[: len(owner)]
    start = np.flatnonzero(first)
    pos = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
    size = pc.utf8_length(token).to_numpy(zero_copy_only=False)
    gold = np.where(size >= 7, pos // 4 % len(TYPES), -1)
    made = {"tokens": lambda: token, "gold": lambda: _tags(gold, first), "pred": lambda: _tags(
        np.where((gold < 0) | (size % 5 == 4), -1, np.where(size % 11 == 0, TYPES.index("LOC"), gold)), first)}
    offsets = pa.array(np.append(start, len(owner)).astype(np.int32))
    rows = owner[start]
    lists = [pa.ListArray.from_arrays(offsets, made[c]()).cast(_LISTS) for c in columns]
    return pa.RecordBatch.from_arrays([doc_id.take(pa.array(doc[rows])), pa.array(sent[rows]), *lists], names=["doc_id", "sent", *columns])


def _tagged_batches(batches: Iterator[pa.RecordBatch], columns: Sequence[str] = LISTS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // TAGGED_BYTES
        ends = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(ends[:-1], ends[1:]):
            if b > a:
                yield _tagged(batch.column("doc_id").slice(a, b - a), batch.column("text").slice(a, b - a), columns)


def tagged_sentences(spark: SparkSession, folder: str, ranged: bool = False, columns: Sequence[str] = LISTS) -> DataFrame:
    """``(doc_id, sent, tokens, gold, pred)``: one row per non-empty sentence of the documents.

    ``ranged``: in ranges of ``doc_id``, for work in its order. Texts are dealt out before they are tagged, so that they are
    tagged once; a sort of the sentences would tag them for its sample too. ``columns``: the lists that are wanted.
    """
    rows = documents(spark, folder).select("doc_id", "text")
    if ranged:
        rows = rows.repartitionByRange("doc_id")
    kind = rows.schema["doc_id"].dataType.simpleString()
    lists = ", ".join(f"{c} array<string>" for c in columns)
    return rows.mapInArrow(functools.partial(_tagged_batches, columns=tuple(columns)), f"doc_id {kind}, sent bigint, {lists}")


def with_control(tokens: Column) -> Column:
    """Every fifth token from the second on with a control character before it."""
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def put(rows: pa.Array) -> pa.Array:
        counts = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.append(0, np.cumsum(counts))
        pos = np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts)
        mark = pa.array(["", "\u0001"]).take(pa.array((pos % 5 == 1).astype(np.int8)))
        flat = pc.binary_join_element_wise(mark, pc.list_flatten(rows).cast(pa.string()), "")
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=rows.is_null())

    return put(tokens)


def tagged_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, gold, pred)``: the tags of a document's sentences one after another."""
    sentences = tagged_sentences(spark, folder).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("sent", "gold", "pred"))).alias("s"))
    return sentences.select("doc_id", F.flatten("s.gold").alias("gold"), F.flatten("s.pred").alias("pred"))


def document_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, tokens)``."""
    return documents(spark, folder).select("doc_id", words(F.col("text")).alias("tokens"))


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, line_no, text)``: lines of the documents, some made headings, some with blanks after them."""
    lines = documents(spark, folder).select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    text = (F.when(F.col("line_no") % 10 == 3, F.concat(F.lit(" = "), "line", F.lit(" = ")))
            .when(F.col("line_no") % 4 == 1, F.concat("line", F.lit(" \t"))).otherwise(F.col("line")))
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), text.alias("text"))


def joined_key(*columns: str) -> Column:
    """A text key of several columns."""
    return F.concat_ws(":", *[F.col(c).cast("string") for c in columns])


def corpora(spark: SparkSession, folder: str) -> list[tuple[str, DataFrame]]:
    """The three text tables as ``(name, (row_id, text))``."""
    talks = table(spark, folder, "conversations")
    return [
        ("documents", documents(spark, folder).select(joined_key("doc_id").alias("row_id"), "text")),
        ("conversations", talks.select(joined_key("conv_id", "turn").alias("row_id"), "text")),
        ("benchmark", table(spark, folder, "benchmark").select(joined_key("item_id").alias("row_id"), "text")),
    ]


def emissions(spark: SparkSession, folder: str) -> DataFrame:
    """``(seq_id, pos, vec, tag)``: ten vectors are one sequence, ten dimensions are the scores of the ten labels."""
    return table(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / 10).cast("bigint").alias("seq_id"), (F.col("vec_id") % 10).alias("pos"),
        F.slice("embedding", 1, 10).cast("array<double>").alias("vec"), F.col("label").cast("int").alias("tag"))


def epochs(spark: SparkSession, folder: str) -> DataFrame:
    """``(run_id, ts, event_id, score, bucket)``: an event is an epoch of its user's run, in time order."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run_id"), "ts", "event_id", F.col("value").alias("score"),
        F.shiftright(F.unix_micros(F.col("ts").cast("timestamp")), BUCKET_BITS).alias("bucket"))
