"""Token ids on disk in a word-aligned code (Simple-8b).

A 64-bit word holds a selector in its top four bits and, below, as many ids as fit at the selector's width: 60 ids of
one bit to one id of 60 bits. The code is greedy: the most ids that fit. Selector 15 is the escape: the word's payload
is a position in the segment's list of raw 64-bit values. Ids are cut into blocks that begin on a word of their own,
and a segment lists the first word of every block, so a reader decodes any block, or all words of one selector at
once, without walking through the others.

``write`` sorts documents by id over ranges, and every task writes segments of about a million ids; a segment's row
holds the coded bytes beside the ids and lengths of its documents, so any store that Spark writes to will do, and
readers prune by ``first_doc`` and ``last_doc``. ``read`` decodes.

Cases: a null text is an empty one, an empty text has the end id alone, a null ``doc_id`` comes first, equal rows are
each kept (ties by text), an empty table writes no segment, and other columns are ignored. Texts of any length go
into one segment; ids up to 64 bits are coded.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .texts import pieces, ragged, returned
from .tokens import encoder

#: fixed values of the code: ids per word for selectors 0 to 13, and the bits of each
PER_WORD = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
MAGIC = b"LXS8"
HEAD = struct.Struct("<4sIQIII")
BLOCK = 256
SEGMENT_IDS = 1 << 20

SEGMENTS = ("part int, seq int, before long, n_ids long, first_doc long, last_doc long, doc_ids array<long>, "
            "lengths array<long>, payload binary")


def widths(values: np.ndarray) -> np.ndarray:
    """Bits of every value, at least one."""
    out = np.ones(len(values), np.uint8)
    rest = values.copy()
    for step in (32, 16, 8, 4, 2, 1):
        more = rest >> np.uint64(step) > 0
        out[more] += step
        rest[more] >>= np.uint64(step)
    return out


def encode(values: np.ndarray, block: int = BLOCK) -> bytes:
    """One segment: header, first word of every block, words, escaped values."""
    values = values.astype(np.uint64)
    n = len(values)
    n_blocks = -(-n // block)
    last, reach = max(PER_WORD), block + max(PER_WORD)
    width = np.zeros((n_blocks, reach), np.uint8)
    flat = np.zeros(n_blocks * block, np.uint8)
    flat[:n] = widths(values)
    width[:, :block] = flat.reshape(n_blocks, block)
    choice = np.full((n_blocks, block), ESCAPE, np.uint8)
    most, done = width[:, :block].copy(), 1
    for selector in range(len(PER_WORD) - 1, -1, -1):
        for k in range(done, PER_WORD[selector]):
            np.maximum(most, width[:, k : k + block], out=most)
        done = PER_WORD[selector]
        choice[most <= BITS[selector]] = selector
    step = np.array([*PER_WORD, 0, 1])
    length = np.minimum(block, n - np.arange(n_blocks) * block)
    at, live, trail = np.zeros(n_blocks, np.int64), np.arange(n_blocks), []
    while len(live):
        pick = choice[live, at[live]]
        trail.append((live, at[live], pick))
        at[live] += step[pick]
        live = live[at[live] < length[live]]
    words, first, escaped = np.zeros(0, np.uint64), np.zeros(n_blocks, np.uint32), np.zeros(0, np.uint64)
    if trail:
        of, pos, pick = (np.concatenate(x) for x in zip(*trail, strict=True))
        order = np.lexsort((pos, of))
        of, pos, pick = of[order], pos[order], pick[order]
        first = np.searchsorted(of, np.arange(n_blocks)).astype(np.uint32)
        words = pick.astype(np.uint64) << np.uint64(60)
        padded = np.zeros(n_blocks * block + last, np.uint64)
        padded[:n] = values
        place = of * block + pos
        for selector, (count, bits) in enumerate(zip(PER_WORD, BITS, strict=True)):
            if len(mine := np.flatnonzero(pick == selector)):
                ids = padded[place[mine][:, None] + np.arange(count)]
                ids[pos[mine][:, None] + np.arange(count) >= length[of[mine]][:, None]] = 0
                words[mine] |= np.bitwise_or.reduce(ids << (np.arange(count) * bits).astype(np.uint64), axis=1)
        raw = np.flatnonzero(pick == ESCAPE)
        escaped = padded[place[raw]]
        words[raw] |= np.arange(len(raw), dtype=np.uint64)
    head = HEAD.pack(MAGIC, block, n, n_blocks, len(words), len(escaped))
    return head + first.astype("<u4").tobytes() + words.astype("<u8").tobytes() + escaped.astype("<u8").tobytes()


def decode(segment: bytes, from_block: int = 0, to_block: int | None = None) -> np.ndarray:
    """The values of a segment, or of a run of its blocks."""
    magic, block, n, n_blocks, n_words, n_escaped = HEAD.unpack_from(segment)
    if magic != MAGIC:
        raise ValueError("not a coded segment")
    to_block = n_blocks if to_block is None else min(to_block, n_blocks)
    first = np.frombuffer(segment, "<u4", n_blocks, HEAD.size).astype(np.int64)
    base = HEAD.size + 4 * n_blocks
    if from_block >= to_block:
        return np.zeros(0, np.uint64)
    begin, stop = first[from_block], n_words if to_block == n_blocks else first[to_block]
    words = np.frombuffer(segment, "<u8", stop - begin, base + 8 * begin)
    escaped = np.frombuffer(segment, "<u8", n_escaped, base + 8 * n_words)
    pick = (words >> np.uint64(60)).astype(np.int64)
    count = np.array([*PER_WORD, 0, 1])[pick]
    of = np.searchsorted(first, np.arange(begin, stop), "right") - 1
    length = np.minimum(block, n - np.arange(from_block, to_block) * block)
    # a block's last word may hold fewer ids than its selector allows
    held = np.add.reduceat(count, first[from_block:to_block] - begin)
    count[np.append(first[from_block + 1 : to_block], stop) - begin - 1] -= held - length
    end = np.cumsum(count)
    out = np.zeros(int(end[-1]), np.uint64)
    for selector, bits in enumerate(BITS):
        if len(mine := np.flatnonzero(pick == selector)):
            shift = (np.arange(PER_WORD[selector]) * bits).astype(np.uint64)
            ids = words[mine][:, None] >> shift & np.uint64((1 << bits) - 1)
            full = np.arange(PER_WORD[selector]) < count[mine][:, None]
            out[ragged(count[mine], end[mine] - count[mine])] = ids[full]
    raw = np.flatnonzero(pick == ESCAPE)
    out[end[raw] - 1] = escaped[(words[raw] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


def _encode_task(path: str, spaceless: bool, end_id: int, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, spaceless)
        held: list[tuple[np.ndarray, np.ndarray, list]] = []
        seq = before = n_held = 0
        part = 0

        def segment() -> pa.RecordBatch:
            nonlocal seq, before, n_held
            ids = np.concatenate([x[0] for x in held])
            docs = [d for x in held for d in x[2]]
            known = [d for d in docs if d is not None]
            row = {"part": part, "seq": seq, "before": before, "n_ids": len(ids), "first_doc": min(known, default=None),
                   "last_doc": max(known, default=None), "doc_ids": docs,
                   "lengths": np.concatenate([x[1] for x in held]).tolist(), "payload": encode(ids)}
            seq, before, n_held = seq + 1, before + len(ids), 0
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=SCHEMA)

        for batch in batches:
            for rows in pieces(batch, limit=4 << 20):
                part = rows.column("part")[0].as_py()
                ids, per = coder.encode_ended(rows.column("text"), end_id)
                held.append((ids, per, rows.column("doc_id").to_pylist()))
                n_held += len(ids)
                if n_held >= segment_ids:
                    yield segment()
        if held:
            yield segment()

    return returned(run, keeps=True)


SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()),
                    ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                    ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, *, spaceless: bool = False,
          segment_ids: int = SEGMENT_IDS) -> None:
    """Encode all texts and write the coded segments to ``path``, in ascending ``doc_id`` order over its parts."""
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
               .withColumn("row", F.monotonically_increasing_id())  # rows of one id, and equal rows, spread over tasks too
               .repartitionByRange("doc_id", F.xxhash64("text"), "row").sortWithinPartitions("doc_id", F.xxhash64("text"), "row")
               .select("doc_id", "text", F.spark_partition_id().alias("part")))
    coded = ordered.mapInArrow(_encode_task(tokenizer, spaceless, end_id, segment_ids), SEGMENTS)
    coded.write.option("compression", "uncompressed").parquet(path)


def _decode_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode(row["payload"]).astype("<u4")
            stop = np.cumsum(np.array(row["lengths"], np.int64))
            start = stop - row["lengths"]
            for at in range(0, len(stop), 256):
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_ids"][at : at + 256], pa.int64()),
                    "start": pa.array(start[at : at + 256] + row["before"] + row["offset"]),
                    "n_tokens": pa.array(row["lengths"][at : at + 256], pa.int64()),
                    "ids": pa.array([ids[a:b].tobytes() for a, b in zip(start[at : at + 256], stop[at : at + 256], strict=True)],
                                    pa.binary())})


def read(spark: SparkSession, path: str, only: Column | None = None) -> DataFrame:
    """One row per document from the files: doc_id, start (ids before it in the whole output), n_tokens, ids.

    ``ids`` are little-endian unsigned 32-bit integers. ``only`` may restrict segments, on ``first_doc`` and
    ``last_doc``. The offsets of parts come from one narrow row per part.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("offset"))
    kept = segments if only is None else segments.where(only)
    # one row per part: as many as the writing job had tasks
    return (kept.join(F.broadcast(offsets), "part").select("before", "offset", "doc_ids", "lengths", "payload")
            .mapInArrow(_decode_task, "doc_id long, start long, n_tokens long, ids binary"))
