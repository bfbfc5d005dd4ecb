"""Benchmark passages in documents, found by SimHash over windows of an item's size.

A window has as many shingles as an item (five words each). Window and item fingerprints are weighted SimHashes: a
shingle's 64-bit hash votes with its length in bytes. A multi-index over ``radius + 1`` blocks of bits finds every
item whose fingerprint lies within ``radius`` of a window's: two such codes agree in at least one block. Each pair found
is then verified by the exact weighted similarity of its shingles (sum of least over sum of greatest weights, with
repeats), and reported at ``similarity`` or more.

An item with more shingles than a document has no window in it: there the whole document is the window. Such items are met by
any shared shingle, not by fingerprint, and verified in the same way, so ``distance`` may lie beyond the radius.

Windows that cannot reach the similarity are not fingerprinted: a window scores at most the weight of its shingles
that occur in some item, over its whole weight. That bound comes from prefix sums and loses nothing.

Items go to the tasks by broadcast in blocks of about ``BLOCK_BYTES`` of text, dealt by hash; a larger benchmark takes one
pass over the documents per block. Documents are neither shuffled nor collected.

Cases: null and blank texts and items match nothing; items without an id are searched and reported with a null id, a row for
each text; items with fewer words than a shingle are too short to tell and
are not searched; equal rows are reported alike; an empty benchmark or table gives no row; ties between windows of a
document take the first; other columns are ignored. A document of any length is searched whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import U64, bytes_of, ngrams, pieces, ragged, returned, words

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 15
BLOCK_BYTES = 8 << 20
SIEVE = 1 << 22
HITS = "doc_id long, item_id long, first_word long, n_words long, similarity double, distance int"


class Index(NamedTuple):
    """One block of items, by the number of their shingles."""

    item: list[int | None]  # ids
    size: np.ndarray  # shingles
    code: np.ndarray  # fingerprints
    grams: list[dict[int, int]]  # weight by shingle
    known: np.ndarray  # all shingles, sorted
    owner: np.ndarray  # items of each shingle, one shingle after the other
    owned: np.ndarray  # where a shingle's items begin, one more at the end
    weight: np.ndarray  # of all shingles of an item
    sieve: np.ndarray
    tables: dict[int, list[tuple[np.ndarray, np.ndarray]]]  # by size: per block of bits, sorted keys and their items


def bit_blocks(n: int) -> list[tuple[int, int]]:
    """(first bit, bits) of n blocks of a 64-bit code."""
    cut = np.linspace(0, 64, n + 1).astype(int)
    return list(zip(cut[:-1].tolist(), np.diff(cut).tolist(), strict=True))


def keys(code: np.ndarray, radius: int) -> list[np.ndarray]:
    return [code >> U64(a) & U64((1 << n) - 1) for a, n in bit_blocks(radius + 1)]


def votes(grams: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Plus or minus the weight for every bit of every shingle."""
    bits = np.unpackbits(grams.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return (2 * bits.astype(np.int64) - 1) * weight[:, None]


def codes(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8")[:, 0]


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document, first word within the document and weight of every shingle."""
    w = words(*bytes_of(texts))
    grams, at = ngrams(w.hash, w.doc, SHINGLE)
    first = np.searchsorted(w.doc, w.doc[at])
    size = np.concatenate([[0], np.cumsum(w.end - w.start)])
    return grams, w.doc[at], at - first, size[at + SHINGLE] - size[at]


def build(ids: list[int | None], texts: list[str], radius: int = RADIUS) -> Index:
    grams, doc, _, weight = shingles(pa.array(texts, pa.string()))
    item, size, code, bags = [], [], [], []
    for i in np.unique(doc).tolist():
        mine = doc == i
        bag: Counter = Counter()
        for g, v in zip(grams[mine].tolist(), weight[mine].tolist(), strict=True):
            bag[g] += v
        item.append(ids[i])
        size.append(int(mine.sum()))
        code.append(codes(votes(grams[mine], weight[mine]).sum(0)[None])[0])
        bags.append(dict(bag))
    sieve = np.zeros(SIEVE, bool)
    sieve[grams & U64(SIEVE - 1)] = True
    size, code = np.array(size, np.int64), np.array(code, np.uint64)
    tables = {}
    for n in np.unique(size).tolist():
        of = np.flatnonzero(size == n)
        tables[n] = []
        for k in keys(code[of], radius):
            order = np.argsort(k, kind="stable")
            tables[n].append((k[order], of[order]))
    held = np.concatenate([np.zeros(0, np.uint64), *(np.fromiter(bag, np.uint64, len(bag)) for bag in bags)])
    owner = np.repeat(np.arange(len(bags)), [len(bag) for bag in bags])
    order = np.argsort(held, kind="stable")
    known, first = np.unique(held[order], return_index=True)
    total = np.array([sum(bag.values()) for bag in bags], np.int64)
    return Index(item, size, code, bags, known, owner[order], np.append(first, len(held)), total, sieve, tables)


def near(index: Index, size: int, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, item, distance) of all items of a size within the radius of the windows' codes."""
    windows, items = [], []
    for (sorted_keys, of), k in zip(index.tables[size], keys(code, radius), strict=True):
        low, high = np.searchsorted(sorted_keys, k), np.searchsorted(sorted_keys, k, "right")
        windows.append(np.repeat(np.arange(len(code)), high - low))
        items.append(of[ragged(high - low, low)])
    w, i = np.concatenate(windows), np.concatenate(items)
    apart = np.bitwise_count(code[w] ^ index.code[i])
    ok = apart <= radius
    pair = np.unique(np.stack([w[ok], i[ok], apart[ok]]), axis=1)
    return pair[0], pair[1], pair[2]


def overlap(bag: dict[int, int], grams: np.ndarray, weight: np.ndarray) -> float:
    """Weighted similarity of a window and an item's shingles."""
    own: Counter = Counter()
    for g, v in zip(grams.tolist(), weight.tolist(), strict=True):
        own[g] += v
    common = sum(min(v, bag.get(g, 0)) for g, v in own.items())
    return common / (sum(own.values()) + sum(bag.values()) - common)


def search(index: Index, grams: np.ndarray, weight: np.ndarray, hit: np.ndarray, radius: int, similarity: float) -> dict[int, tuple[float, int, int, int]]:
    """Best window per item among the shingles of one stretch: (similarity, first, size, distance) by item position."""
    best: dict[int, tuple[float, int, int, int]] = {}
    total = np.concatenate([[0], np.cumsum(weight)])
    known = np.concatenate([[0], np.cumsum(np.where(hit, weight, 0))])
    sums = None
    for size in index.tables:
        if size > len(grams):
            continue
        first = np.arange(len(grams) - size + 1)
        first = first[known[first + size] - known[first] >= similarity * (total[first + size] - total[first])]
        if not len(first):
            continue
        if sums is None:
            sums = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(votes(grams, weight), axis=0)])
        w, items, apart = near(index, size, codes(sums[first + size] - sums[first]), radius)
        order = np.lexsort((w, apart))
        for k in order.tolist():
            i, s = int(items[k]), int(first[w[k]])
            if i in best and best[i][0] >= 1:
                continue
            score = overlap(index.grams[i], grams[s : s + size], weight[s : s + size])
            if score >= similarity and (i not in best or score > best[i][0]):
                best[i] = (score, s, size, int(apart[k]))
    return best


def search_whole(index: Index, grams: np.ndarray, weight: np.ndarray, hit: np.ndarray, similarity: float) -> dict[int, tuple[float, int, int, int]]:
    """The whole document against the items with more shingles, as ``search`` gives it."""
    total = int(weight.sum())
    if weight[hit].sum() < similarity * total:
        return {}
    place = np.unique(np.searchsorted(index.known, grams[hit]))
    items = np.unique(index.owner[ragged(index.owned[place + 1] - index.owned[place], index.owned[place])])
    items = items[(index.size[items] > len(grams)) & (similarity * index.weight[items] <= total)]
    out: dict[int, tuple[float, int, int, int]] = {}
    if len(items):
        code = codes(votes(grams, weight).sum(0)[None])[0]
    for i in items.tolist():
        score = overlap(index.grams[i], grams, weight)
        if score >= similarity:
            out[i] = (score, 0, len(grams), int(np.bitwise_count(code ^ index.code[i])))
    return out


def _search_task(shared, radius: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        widest = max(index.tables, default=0)
        for batch in batches:
            for rows in pieces(batch, limit=4 << 20):
                grams, doc, first, weight = shingles(rows.column("text"))
                hit = index.sieve[grams & U64(SIEVE - 1)]
                at = np.flatnonzero(hit)
                if not len(at):
                    continue
                place = np.minimum(np.searchsorted(index.known, grams[at]), len(index.known) - 1)
                hit[at] = index.known[place] == grams[at]
                at = np.flatnonzero(hit)
                if not len(at):
                    continue
                out = []
                # stretches of hits closer than the widest item, within one document
                cut = np.flatnonzero((doc[at[1:]] != doc[at[:-1]]) | (at[1:] - at[:-1] > widest)) + 1
                for run_ in np.split(at, cut):
                    d = int(doc[run_[0]])
                    a, b = np.searchsorted(doc, d), np.searchsorted(doc, d, "right")
                    a, b = max(a, run_[0] - widest), min(b, run_[-1] + widest + 1)
                    found = search(index, grams[a:b], weight[a:b], hit[a:b], radius, similarity)
                    out += [(d, i, int(first[a + s]), size, score, apart) for i, (score, s, size, apart) in found.items()]
                for d in np.unique(doc[at]).tolist():
                    a, b = np.searchsorted(doc, d), np.searchsorted(doc, d, "right")
                    if b - a < widest:
                        found = search_whole(index, grams[a:b], weight[a:b], hit[a:b], similarity)
                        out += [(d, i, 0, size, score, apart) for i, (score, _, size, apart) in found.items()]
                best: dict[tuple[int, int], tuple] = {}
                for d, i, s, size, score, apart in out:
                    if (d, i) not in best or score > best[d, i][2]:
                        best[d, i] = (s, size, score, apart)
                if best:
                    ids = rows.column("doc_id").to_pylist()
                    yield pa.RecordBatch.from_pylist(
                        [{"doc_id": ids[d], "item_id": index.item[i], "first_word": s, "n_words": size + SHINGLE - 1,
                          "similarity": score, "distance": apart} for (d, i), (s, size, score, apart) in best.items()],
                        schema=_HITS)

    return run


_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()),
                   ("similarity", pa.float64()), ("distance", pa.int32())])


def contaminated(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity, distance: every document's best window for every item it holds."""
    spark = docs.sparkSession
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0]
    n_blocks = -(-(total or 0) // block_bytes)
    blocks = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n_blocks))))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    passes = []
    for b in range(n_blocks):
        rows = blocks.where(F.col("block") == b).select("item_id", "text").collect()
        index = build([r["item_id"] for r in rows], [r["text"] for r in rows], radius)
        if len(index.item):
            shared = spark.sparkContext.broadcast(index)
            passes.append(plain.mapInArrow(returned(_search_task(shared, radius, similarity)), HITS))
    return reduce(DataFrame.unionAll, passes) if passes else spark.createDataFrame([], HITS)
