"""Queries that pack, reverse, mask and batch token arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import packing
from . import inputs
from .corpora import TOKENS_SQL
from .registry import registry

QUERIES, ORACLES, query = registry()

LENGTH = 128
ROWS = 100


@query("pack_global", f"""WITH {TOKENS_SQL},
flat AS (SELECT doc_id, generate_subscripts(toks, 1) AS pos, unnest(toks) AS tok FROM toks),
stream AS (SELECT tok, row_number() OVER (ORDER BY doc_id, pos DESC) - 1 AS g FROM flat)
SELECT (g // {LENGTH})::BIGINT AS block_id, string_agg(tok, ' ' ORDER BY g) AS block FROM stream
GROUP BY g // {LENGTH} HAVING count(*) = {LENGTH}""")
def pack_global(spark, folder):
    blocks = packing.pack_stream(inputs.document_tokens(spark, folder), LENGTH, ["doc_id"])
    return blocks.select("block_id", F.array_join("tokens", " ").alias("block"))


def _three_columns(spark, folder):
    """Token arrays with both masks: a word of one character is the special token here."""
    return inputs.document_tokens(spark, folder).select(
        "doc_id", F.col("tokens").alias("input_ids"),
        F.transform("tokens", lambda t: F.lit(1)).alias("attention_mask"),
        F.transform("tokens", lambda t: (F.char_length(t) == 1).cast("int")).alias("special_tokens_mask"))


BATCH_SQL = f"""{TOKENS_SQL},
numbered AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, toks FROM toks),
flat AS (SELECT i // {ROWS} AS batch_id, i, generate_subscripts(toks, 1) AS pos, unnest(toks) AS tok FROM numbered),
placed AS (SELECT batch_id, tok, row_number() OVER (PARTITION BY batch_id ORDER BY i, pos) - 1 AS g FROM flat)"""


@query("pack_batches", f"""WITH {BATCH_SQL}
SELECT batch_id::BIGINT AS batch_id, (g // {LENGTH})::BIGINT AS block_id, string_agg(tok, ' ' ORDER BY g) AS block
FROM placed GROUP BY batch_id, g // {LENGTH} HAVING count(*) = {LENGTH}""")
def pack_batches(spark, folder):
    blocks = packing.pack_batches(inputs.document_tokens(spark, folder), LENGTH, ["doc_id"], rows_per_batch=ROWS)
    return blocks.select("batch_id", "block_id", F.array_join("tokens", " ").alias("block"))


@query("block_reverse", f"""WITH {BATCH_SQL}
SELECT batch_id::BIGINT AS batch_id, (g // {LENGTH})::BIGINT AS block_id,
  string_agg(tok, ' ' ORDER BY g DESC) AS input_ids, string_agg(tok, ' ' ORDER BY g DESC) AS labels,
  string_agg((length(tok) = 1)::INT::VARCHAR, ',' ORDER BY g) AS special_tokens_mask,
  count(*) AS attention
FROM placed GROUP BY batch_id, g // {LENGTH} HAVING count(*) = {LENGTH}""")
def block_reverse(spark, folder):
    columns = ["input_ids", "attention_mask", "special_tokens_mask"]
    blocks = packing.pack_batches(_three_columns(spark, folder), LENGTH, ["doc_id"], columns, rows_per_batch=ROWS)
    made = packing.reverse_blocks(blocks, masks=columns[1:])
    return made.select(
        "batch_id", "block_id", F.array_join("input_ids", " ").alias("input_ids"),
        F.array_join("labels", " ").alias("labels"),
        F.array_join(F.col("special_tokens_mask").cast("array<string>"), ",").alias("special_tokens_mask"),
        F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("attention"))


SHARDS = 4


@query("pack_sharded", f"""WITH {TOKENS_SQL},
numbered AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n, toks FROM toks),
sharded AS (SELECT i, toks, n, CASE WHEN i < (n % {SHARDS}) * (n // {SHARDS} + 1) THEN i // (n // {SHARDS} + 1)
  ELSE (n % {SHARDS}) + (i - (n % {SHARDS}) * (n // {SHARDS} + 1)) // (n // {SHARDS}) END AS shard FROM numbered),
batched AS (SELECT shard, (i - min(i) OVER (PARTITION BY shard)) // {ROWS} AS batch_id, i, toks FROM sharded),
flat AS (SELECT shard, batch_id, i, generate_subscripts(toks, 1) AS pos, unnest(toks) AS tok FROM batched),
placed AS (SELECT shard, batch_id, tok,
  row_number() OVER (PARTITION BY shard, batch_id ORDER BY i, pos) - 1 AS g FROM flat)
SELECT shard::BIGINT AS shard, batch_id::BIGINT AS batch_id, (g // {LENGTH})::BIGINT AS block_id,
  string_agg(tok, ' ' ORDER BY g) AS block
FROM placed GROUP BY shard, batch_id, g // {LENGTH} HAVING count(*) = {LENGTH}""")
def pack_sharded(spark, folder):
    """Batches that do not cross the four worker shards."""
    rows = inputs.table(spark, folder, "documents").agg(F.count("*")).scalar()
    blocks = packing.pack_batches(inputs.document_tokens(spark, folder), LENGTH, ["doc_id"], rows_per_batch=ROWS,
                                  shards=SHARDS, rows=rows)
    return blocks.select("shard", "batch_id", "block_id", F.array_join("tokens", " ").alias("block"))


FIT = 64
IDS_SQL = f"""{TOKENS_SQL},
ids AS (SELECT doc_id, list_transform(toks, lambda t: length(t)) AS ids FROM toks)"""


def _ids(spark, folder):
    """Word lengths stand for token ids."""
    return inputs.document_tokens(spark, folder).select(
        "doc_id", F.transform("tokens", lambda t: F.char_length(t)).alias("ids"))


def _text(column):
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


@query("fit_length", f"""WITH {IDS_SQL}
SELECT doc_id, array_to_string(list_resize(ids, {FIT}, 0), ',') AS input_ids,
  array_to_string(list_transform(range({FIT}), lambda i: (i < len(ids))::INT), ',') AS attention_mask,
  array_to_string(list_transform(list_resize(ids, {FIT}, 0), lambda i: (i IN (0, 2))::INT), ',')
    AS special_tokens_mask FROM ids""")
def fit_length(spark, folder):
    made = _ids(spark, folder).select(
        "doc_id", arrays.fit_length(F.col("ids"), FIT, 0).alias("input_ids"),
        arrays.fit_mask(F.col("ids"), FIT).alias("attention_mask"))
    made = made.withColumn("special_tokens_mask", arrays.special_mask(F.col("input_ids"), [0, 2]))
    return made.select("doc_id", _text("input_ids"), _text("attention_mask"), _text("special_tokens_mask"))


STEP = 64
# a document's ids padded to the next multiple of STEP
PADDED_SQL = f"""{IDS_SQL},
padded AS (SELECT doc_id, ids, (len(ids) + {STEP - 1}) // {STEP} * {STEP} AS width FROM ids)"""


def _padded(spark, folder):
    """Whole documents, each padded to its own length rounded up."""
    pads = F.pmod(-F.size("ids"), F.lit(STEP))
    return _ids(spark, folder).select(
        "doc_id", "ids", pads.alias("pads"), F.concat("ids", F.array_repeat(F.lit(0), pads)).alias("input_ids"),
        F.concat(F.transform("ids", lambda i: F.lit(1)), F.array_repeat(F.lit(0), pads)).alias("attention_mask"))


@query("masked_reverse", f"""WITH {PADDED_SQL}
SELECT doc_id, array_to_string(list_resize(list_reverse(ids), width, 0), ',') AS input_ids,
  array_to_string(list_transform(range(width), lambda i: (i < len(ids))::INT), ',') AS attention_mask FROM padded""")
def masked_reverse(spark, folder):
    made = _padded(spark, folder).withColumn(
        "input_ids", arrays.masked_reverse(F.col("input_ids"), F.col("attention_mask")))
    return made.select("doc_id", _text("input_ids"), _text("attention_mask"))


@query("masked_reverse_left", f"""WITH {PADDED_SQL},
cut AS (SELECT doc_id, ids AS v, range(width - len(ids)) AS p FROM padded)
SELECT doc_id, array_to_string(list_concat(list_reverse(v), list_reverse(list_transform(p, lambda x: -1 - x))), ',')
    AS input_ids,
  array_to_string(list_concat(list_transform(p, lambda x: 0), list_transform(v, lambda x: 1)), ',') AS attention_mask
FROM cut""")
def masked_reverse_left(spark, folder):
    """Left padding with pads that differ: the ids come out right-padded, the mask stays as it was."""
    pads = F.when(F.col("pads") > 0, F.transform(F.sequence(F.lit(1), F.col("pads")), lambda i: -i)).otherwise(
        F.array().cast("array<int>"))
    padded = _padded(spark, folder).withColumn("p", pads).select(
        "doc_id", F.concat("p", "ids").alias("input_ids"),
        F.concat(F.transform("p", lambda x: F.lit(0)), F.transform("ids", lambda x: F.lit(1))).alias("attention_mask"))
    made = padded.withColumn("input_ids", arrays.masked_reverse(F.col("input_ids"), F.col("attention_mask")))
    return made.select("doc_id", _text("input_ids"), _text("attention_mask"))


@query("unreverse", f"""WITH {PADDED_SQL}
SELECT doc_id, array_to_string(list_resize(ids, width, 0), ',') AS input_ids FROM padded""")
def unreverse(spark, folder):
    """The reversal and its inverse give the ids back."""
    made = _padded(spark, folder)
    made = made.withColumn("input_ids", arrays.masked_reverse(F.col("input_ids"), F.col("attention_mask")))
    made = made.withColumn("input_ids", arrays.unreverse(F.col("input_ids"), F.col("attention_mask")))
    return made.select("doc_id", _text("input_ids"))


@query("stack_batches", f"""WITH {TOKENS_SQL},
flat AS (SELECT doc_id, generate_subscripts(toks, 1) AS pos, unnest(toks) AS tok FROM toks),
stream AS (SELECT tok, row_number() OVER (ORDER BY doc_id, pos DESC) - 1 AS g FROM flat),
blocks AS (SELECT g // {LENGTH} AS i, string_agg(tok, ' ' ORDER BY g) AS line FROM stream GROUP BY 1 HAVING count(*) = {LENGTH})
SELECT (i // 8)::BIGINT AS batch_id, count(*) AS n, string_agg(line, ';' ORDER BY i) AS batch FROM blocks
GROUP BY i // 8""")
def stack_batches(spark, folder):
    """Batches of eight packed blocks; a block's number is its index, so nothing has to be counted."""
    blocks = packing.pack_stream(inputs.document_tokens(spark, folder), LENGTH, ["doc_id"])
    made = packing.stack_batches(blocks, 8, LENGTH, ["block_id"], ["tokens"], index="block_id")
    lines = F.transform("tokens", lambda r: F.array_join(r, " "))
    return made.select("batch_id", F.size("tokens").cast("bigint").alias("n"),
                       F.array_join(lines, ";").alias("batch"))
