"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from . import cost_packing, ecoc_lang, elias_fano_lm, gray_simhash, hilbert, impact_topk, interval_align, license_ngrams, line_chunks, line_crf, resident_lloyd, window_decontam, word_aligned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_word_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written in the word-aligned code and read back."""
    path = shared_dir(spark, "word-aligned")
    word_aligned.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 2, spaceless=True)
    return word_aligned.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op4_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens, balanced by attention cost."""
    packed = cost_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op6_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = gray_simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_ecoc_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four fifths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = ecoc_lang.fit(docs.where(~held_out))
    found = ecoc_lang.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op3_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards along a Hilbert curve over size, language and source."""
    dims = {"size_cell": hilbert.level(F.octet_length("text")), "lang_cell": hilbert.place(F.col("lang")),
            "source_cell": hilbert.place(F.col("source"))}
    found = hilbert.shards(table(spark, sf_dir, "documents"), dims)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"), "hilbert", *dims)


@query
def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated runs of lines, whole copies too: what went and a digest of what stays."""
    found = line_chunks.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), copies=True)
    return found.select("doc_id", "removed", F.length("text").cast("long").alias("kept_chars"),
                        F.crc32(F.encode("text", "UTF-8")).alias("kept_crc32"))


@query
def op9_window_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in all documents."""
    found = window_decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.round("similarity", 6))


@query
def op10_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), impact_topk.integers(F.col("embedding")).alias("vector"))
    return impact_topk.top_k(vectors, F.col("id") % 20 == 0)


ORACLES["op10_impact_topk"] = """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM pairs QUALIFY rank <= 20"""


@query
def op5_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a model of nine tenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    found = elias_fano_lm.score(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op2_license_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in the paragraphs of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_ngrams.scan(docs, license_ngrams.fit(docs))
    return found.withColumn("probability", F.round("probability", 4)).withColumn("similarity", F.round("similarity", 4))


@query
def op11_interval_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens of two tokenizers aligned by their bytes."""
    return interval_align.score(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                public_tokenizers.path("piece_bpe_32k.model"))


@query
def op12_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from the labels of four fifths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))  # no id: no remainder
    model = line_crf.fit(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    found = line_crf.predict(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op13_resident_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of 16 parts for all vectors, by codebooks of 64 entries after two rounds."""
    found = resident_lloyd.compress(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _lloyd_round(k: int) -> str:
    """Assignment to the codebook ``c{k}``, and the codebook that follows from it."""
    return f"""
d{k} AS (SELECT vec_id, v.p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM v JOIN c{k} ON c{k}.p = v.p),
a{k} AS (SELECT vec_id, p, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM d{k} GROUP BY vec_id, p),
m{k} AS (SELECT p, e, list(m ORDER BY j) AS c FROM (SELECT a{k}.p, e, j, floor(sum(x[j])::DOUBLE / count(*))::BIGINT AS m
  FROM a{k} JOIN v USING (vec_id, p), range(1, 5) t(j) GROUP BY a{k}.p, e, j) GROUP BY p, e),
c{k + 1} AS (SELECT p, e, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (p, e))"""


ORACLES["op13_resident_lloyd"] = f"""
WITH kept AS (SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
v AS (SELECT vec_id, p, x[4 * p + 1 : 4 * p + 4] AS x FROM kept, range(16) t(p)),
c0 AS (SELECT p, e, x AS c FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept
  QUALIFY e < 64) USING (vec_id)),{_lloyd_round(0)},{_lloyd_round(1)},{_lloyd_round(2)},
codes AS (SELECT vec_id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c2) AS codebooks_sha256
FROM codes JOIN kept USING (vec_id)"""
