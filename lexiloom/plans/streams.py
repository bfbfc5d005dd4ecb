"""Queries that run a stream over a table to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.vocab import tokenize
from ..session import shared_dir
from ..streaming import packing, text
from . import inputs
from .registry import registry

QUERIES, ORACLES, query = registry()

TALKS = "conv_id bigint, turn bigint, role string, text string"
WORDS_SQL = r"list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: x <> '')"


def _talks(spark, folder):
    # a pattern, because a stream's plain path must be a folder and the table may be one file
    return text.read_stream(spark, f"{folder}/conversations.parque[t]", TALKS, files_per_trigger=1)


@query("stream_tokens", f"""
SELECT conv_id, turn, array_to_string({WORDS_SQL}, ' ') AS tokens FROM conversations
WHERE text <> '' AND NOT starts_with(text, ' =') AND regexp_matches(text, '[^ \\t\\r\\n]')""")
def stream_tokens(spark, folder):
    done = text.drain(text.clean_tokens(_talks(spark, folder), ["conv_id", "turn"]), "tokens")
    return done.select("conv_id", "turn", F.array_join("tokens", " ").alias("tokens"))


@query("stream_by_split", """
SELECT role AS split, count(*) AS n FROM conversations GROUP BY role""")
def stream_by_split(spark, folder):
    """A streaming Parquet sink with one folder per split."""
    rows = _talks(spark, folder).select("conv_id", "turn", "text", F.col("role").alias("split"))
    return text.drain(rows, "splits", ["split"]).groupBy("split").agg(F.count("*").alias("n"))


LENGTH = 32
CARRY_SQL = f"""
WITH flat AS (SELECT role, conv_id, turn, generate_subscripts({WORDS_SQL}, 1) AS pos, unnest({WORDS_SQL}) AS tok
  FROM conversations),
placed AS (SELECT role, tok, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn, pos) - 1 AS g FROM flat)"""


ARRIVALS = 3


def _carried(spark, folder):
    """The table arrives in parts, one after the other by conversation, each a micro-batch of its own."""
    arrived, out, log = (shared_dir(spark, f"talks-{x}") for x in ("in", "out", "log"))
    talks = inputs.table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    low, high = talks.agg(F.min("conv_id"), F.max("conv_id")).first()
    part = F.floor((F.col("conv_id") - low) * ARRIVALS / (high - low + 1))
    for i in range(ARRIVALS):
        talks.where(part == i).coalesce(1).write.mode("append").parquet(arrived)  # a file is an arrival
    words = tokenize(text.read_stream(spark, arrived, TALKS, files_per_trigger=1), ["role", "conv_id", "turn"])
    packing.pack_carry(words, LENGTH, out, log, ["role"], ["conv_id", "turn"]).awaitTermination()
    return out


@query("stream_pack", f"""{CARRY_SQL}
SELECT role, (g // {LENGTH})::BIGINT AS block_id, string_agg(tok, ' ' ORDER BY g DESC) AS block
FROM placed GROUP BY role, g // {LENGTH} HAVING count(*) = {LENGTH}""")
def stream_pack(spark, folder):
    """One stream per role: its last tokens, fewer than a block, are all that waits."""
    made = packing.blocks(spark, _carried(spark, folder))
    return made.select("role", "block_id", F.array_join("tokens", " ").alias("block"))


@query("stream_pack_rest", f"""{CARRY_SQL},
ends AS (SELECT role, count(*) AS n FROM placed GROUP BY role)
SELECT role, (n // {LENGTH})::BIGINT AS block_id, coalesce(string_agg(tok, ' ' ORDER BY g)
  FILTER (g >= n // {LENGTH} * {LENGTH}), '') AS rest FROM placed JOIN ends USING (role) GROUP BY role, n""")
def stream_pack_rest(spark, folder):
    last = packing.rests(spark, _carried(spark, folder), ["role"])
    return last.select("role", "block_id", F.array_join("tokens", " ").alias("rest"))


@query("stream_pack_drop", f"""
WITH numbered AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS i, {WORDS_SQL} AS w
  FROM conversations),
flat AS (SELECT i // 100 AS batch_id, i, generate_subscripts(w, 1) AS pos, unnest(w) AS tok FROM numbered),
placed AS (SELECT batch_id, tok, row_number() OVER (PARTITION BY batch_id ORDER BY i, pos) - 1 AS g FROM flat)
SELECT 0 AS micro_batch, batch_id::BIGINT AS batch_id, (g // {LENGTH})::BIGINT AS block_id,
  string_agg(tok, ' ' ORDER BY g DESC) AS block
FROM placed GROUP BY batch_id, g // {LENGTH} HAVING count(*) = {LENGTH}""")
def stream_pack_drop(spark, folder):
    """Micro-batches packed by the batch operator; remainders are dropped. Each file is one micro-batch."""
    path, log = shared_dir(spark, "blocks-out"), shared_dir(spark, "blocks-log")
    words = tokenize(_talks(spark, folder), ["conv_id", "turn"])
    packing.pack_drop(words, LENGTH, path, log, ["conv_id", "turn"], rows_per_batch=100).awaitTermination()
    return spark.read.parquet(path).select("micro_batch", "batch_id", "block_id", F.array_join("tokens", " ").alias("block"))
