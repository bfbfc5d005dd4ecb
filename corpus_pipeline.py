"""The corpus pipeline: documents in, packed training sequences out.

Five stages, each a function of (spark, docs, sf_dir) that returns a DataFrame; a runner writes each result as Parquet
and hands it to the next. All but the last return the columns of documents.

1. language: texts without a letter have no language and go.
2. lines: repeated runs of lines go from the texts; a text of which nothing is left goes too.
3. near duplicates: of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays.
4. decontamination: documents that hold a passage of the benchmark go.
5. packing: token sequences of balanced cost.

Every stage keeps rows as they are unless its own decision removes them: null columns, equal rows and other columns,
whatever their names, pass. A null text has no language and goes at the first stage. Empty tables pass all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import bloom, cost_packing, ecoc_lang, gray_simhash, line_chunks, window_decontam
from lexiloom.session import stored

#: near copies: Jaccard similarity of the sets of five-word shingles; codes of four words name the candidates, within 72 of 256 bits
NEAR = {"width": 5, "words": 4, "limit": 72, "similarity": 0.8}

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language, by a model of the labelled ones."""
    found = ecoc_lang.predict(docs, ecoc_lang.fit(docs))
    return found.where(F.coalesce(F.col("lang_pred"), F.lit("")) != ecoc_lang.UNKNOWN).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that stand elsewhere before."""
    found = line_chunks.dedup(docs).where("removed = 0 OR trim(text) <> ''")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """Every row whole, as one column, with its id, its text and a key of the two: no other column's name can clash."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id; of rows with its id and text the first by the other columns."""
    keyed = _keyed(docs)
    groups = stored(gray_simhash.near_duplicates(keyed.select("doc_id", "text", "key"), **NEAR, carry=("key",)).select("doc_id", "key", "component"), "groups")
    first = F.min_by("key", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    staying = groups.groupBy("component").agg(first.alias("key")).select("key", F.lit(True).alias("stays"))
    keys = groups.groupBy("key").agg(F.count("*").alias("n")).join(staying, "key", "left")
    touched = stored(keys.where("stays IS NULL OR n > 1").select("key", F.lit(True).alias("touched"), "stays"), "touched")
    # rows that no group touches stay where they are; a filter tells most of them before the others are shuffled
    maybe = bloom.maybe_in(touched, "key")(F.col("key"))
    marked = keyed.withColumn("maybe", maybe)
    met = marked.where("maybe").join(touched, "key", "left").where("touched IS NULL OR stays")
    others = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    kept = met.groupBy("key").agg(F.min_by("row", F.to_json(F.struct(*others)) if others else F.lit("")).alias("row"))
    return marked.where("NOT maybe").select("row.*").unionAll(kept.select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = _keyed(docs)
    found = window_decontam.contaminated(keyed.select(F.col("key").alias("doc_id"), "text"), benchmark)
    return keyed.join(found.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: one row per piece, with its ids."""
    return cost_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
