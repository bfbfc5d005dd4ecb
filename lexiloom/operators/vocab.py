"""Vocabulary table, encoding against it, and line-by-line encoding."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import fit_length, fit_mask, special_mask
from ..functions.text import is_blank, words
from ..session import stored
from .ordered import lookup

# characters that a caller's tokenizer gets at once
BATCH_CHARS = 1 << 20
# tokens and rows that are encoded as one
PACK_TOKENS = 1 << 19


def tokenize(df: DataFrame, keys: Sequence[str], text: str = "text", out: str = "tokens") -> DataFrame:
    """Token arrays of every text; other columns are dropped. No shuffle."""
    return df.select(*keys, words(F.col(text)).alias(out))


def tokenize_with(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
                  schema: str) -> DataFrame:
    """Tokenize with the caller's own batch function (a sub-word library), in Arrow batches.

    The function gets a batch in pieces of up to ``BATCH_CHARS`` characters, as tokens take many times the room of a text.
    """
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = np.zeros(len(batch), np.int64)
            for name in batch.columns:
                size += np.array([len(v) if isinstance(v, str) else 0 for v in batch[name]], np.int64)
            part = (np.cumsum(size) // BATCH_CHARS) if len(batch) else size
            ends = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(batch)]
            for a, b in zip(ends[:-1], ends[1:]):
                if b > a or not len(batch):
                    yield batch.iloc[a:b].reset_index(drop=True)

    return df.mapInPandas(lambda batches: fn(pieces(batches)), schema)


def token_counts(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``(token, count)``; counted in the map tasks first, so a frequent token costs one row per task.

    The outer form of ``explode``: the plain one adds a filter on the array's size, which is pushed down to the
    scan and tokenizes every text once more.
    """
    occurrences = df.select(F.explode_outer(tokens).alias("token")).where("token IS NOT NULL")
    return occurrences.groupBy("token").agg(F.count("*").alias("count"))


def build_vocab(counts: DataFrame, first_id: int = 0, size: int | None = None) -> DataFrame:
    """``(token, count, id)``: dense ids by falling count, ties by a hash bucket and then by token.

    Most tokens share the lowest counts, so ties are first spread over 4,096 hash buckets. A row's id is
    its rank in its (count, bucket) group plus the sizes of the groups before it. Distinct counts are at
    most the square root of twice the number of tokens: the last window is over a small table.
    """
    # never NULL, or the joins would test it on every occurrence of a token
    place = F.coalesce(F.conv(F.substring(F.md5("token"), 1, 3), 16, 10).cast("int"), F.lit(0))
    spread = counts.withColumn("__h", place)
    group = Window.partitionBy("count", "__h").orderBy("token")
    ranked = spread.withColumn("__r", F.row_number().over(group))
    groups = spread.groupBy("count", "__h").agg(F.count("*").alias("__n"))
    in_count = groups.withColumn("__before", F.coalesce(F.sum("__n").over(
        Window.partitionBy("count").orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    levels = spread.groupBy("count").agg(F.count("*").alias("__m")).select("count", F.coalesce(
        F.sum("__m").over(Window.orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("__above"))
    offsets = in_count.join(levels, "count").drop("__n")
    vocab = (ranked.join(offsets, ["count", "__h"])
             .select("token", "count",
                     (F.col("__above") + F.col("__before") + F.col("__r") - 1 + first_id).alias("id")))
    return vocab if size is None else vocab.where(F.col("id") < first_id + size)


def encode(df: DataFrame, vocab: DataFrame, keys: Sequence[str] = ("row_id",), tokens: str = "tokens",
           out: str = "input_ids", unk_id: int = -1) -> DataFrame:
    """``(*keys, out)``: token arrays as id arrays, tokens outside ``vocab`` as ``unk_id``.

    The table decides alone which tokens have ids; a cut is made in :func:`build_vocab`. ``keys`` name a row: rows
    of one key become one. Rows are packed, each distinct token of a pack is looked up once (see :func:`lookup`), and the
    pack's ids go back to its rows, so that what is joined grows with the distinct tokens of the packs, not with the text.
    """
    packs = packed(df, keys, tokens)
    distinct = packs.select("__pack", F.posexplode("__distinct").alias("__code", "token"))
    found = lookup(distinct, vocab.select("token", "id", F.col("count")), ["token"], "count", spread=["__pack", "__code"], how="left")
    value = F.coalesce("id", F.lit(unk_id)).cast("bigint")
    ids = found.groupBy("__pack").agg(F.collect_list(F.struct("__code", value.alias("id"))).alias("__ids"))
    whole = packs.select("__pack", "__keys", "__sizes", "__codes").join(ids, "__pack", "left").drop("__pack")
    single = whole.mapInArrow(_unpacked, T.StructType([T.StructField("__key", packs.schema["__keys"].dataType.elementType), T.StructField("__l", T.ArrayType(T.LongType()))]))
    each = single.select("__key.*", "__l").groupBy(*keys).agg(F.collect_list("__l").alias("__l"))
    placed = F.flatten(F.transform("__l", lambda l: F.transform(l, lambda i, p: F.struct(p.alias("p"), i.alias("i")))))
    merged = F.sort_array(F.filter(placed, lambda x: x["i"].isNotNull()))["i"]
    return each.select(*keys, F.when(F.size("__l") == 1, F.array_compact(F.col("__l")[0])).otherwise(merged).alias(out))


def packed(df: DataFrame, keys: Sequence[str], tokens: str) -> DataFrame:
    """Rows in packs, stored: each has its rows' keys and sizes, its distinct tokens, and the place there of every token."""
    rows = df.select(F.struct(*keys).alias("__key"), F.col(tokens).alias("__tokens"))
    kind = T.StructType([T.StructField("__pack", T.StringType()), T.StructField("__keys", T.ArrayType(rows.schema["__key"].dataType)),
                         T.StructField("__sizes", T.ArrayType(T.IntegerType())), T.StructField("__codes", T.ArrayType(T.IntegerType())),
                         T.StructField("__distinct", T.ArrayType(T.StringType()))])
    return stored(rows.mapInArrow(_packed, kind), "packs")  # a pack's name is drawn: it must be made once


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about ``PACK_TOKENS`` tokens as one: their keys, numbers of tokens, distinct tokens, and each token's place there (-1: null)."""
    def pack(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        tokens = rows.column("__tokens").combine_chunks()
        coded = pc.list_flatten(tokens).dictionary_encode()
        codes = pc.fill_null(coded.indices, -1).cast(pa.int32())
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).cast(pa.int32())
        keys = rows.column("__key").combine_chunks()
        columns = [pa.array([uuid.uuid4().hex]), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                                                   for x in (keys, sizes, codes, coded.dictionary.cast(pa.string())))]
        return pa.RecordBatch.from_arrays(columns, names=["__pack", "__keys", "__sizes", "__codes", "__distinct"])

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("__tokens")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        for end in range(1, batch.num_rows + 1):
            n += sizes[end - 1] + 1
            if n >= PACK_TOKENS:
                yield pack([*held, batch.slice(at, end - at)])
                held, n, at = [], 0, end
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if held:
        yield pack(held)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the packs, with the ids of their tokens (null for a null token)."""
    for batch in batches:
        for k in range(batch.num_rows):
            keys, sizes, codes, ids = (batch.column(c)[k].values for c in ("__keys", "__sizes", "__codes", "__ids"))
            place = codes.to_numpy(zero_copy_only=False)
            table = np.zeros(0 if ids is None else len(ids), np.int64)
            if ids is not None:
                table[ids.field("__code").to_numpy()] = ids.field("id").to_numpy()
            values = pa.array(table).take(pa.array(place, pa.int32(), mask=place < 0))
            offsets = np.append(0, np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), values)], names=["__key", "__l"])


def encode_lines(df: DataFrame, vocab: DataFrame, length: int, keys: Sequence[str] = ("row_id",),
                 text: str = "text", pad_id: int | None = None, special: Sequence[int] = (),
                 unk_id: int = -1) -> DataFrame:
    """Line by line: blank lines dropped, ids cut to ``length``, padded only when ``pad_id`` is given."""
    lines = tokenize(df.where(~is_blank(F.col(text))), keys, text)
    ids = encode(lines, vocab, keys, "tokens", "__ids", unk_id)
    if pad_id is None:
        cut = F.slice("__ids", 1, length)
        mask = F.array_repeat(F.lit(1), F.least(F.size("__ids"), F.lit(length)))
    else:
        cut = fit_length(F.col("__ids"), length, F.lit(pad_id).cast("bigint"))
        mask = fit_mask(F.col("__ids"), length)
    shaped = ids.select(*keys, cut.alias("input_ids"), mask.alias("attention_mask"))
    marks = special_mask(F.col("input_ids"), special) if special else F.transform("input_ids", lambda i: F.lit(0))
    return shaped.withColumn("special_tokens_mask", marks)
