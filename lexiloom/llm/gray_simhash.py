"""SimHash near-duplicates by a Gray-ordered hierarchical index.

A text's fingerprint has 64 bits, or several words of 64; a bit is set if more than half of its shingles' XXH64
hashes have it. Equal fingerprints are one entry. Two codes that differ in at most ``radius`` of the first word's bits
agree in two of ``radius + 2`` blocks of it, so every entry goes to one bucket per pair of blocks. A bucket is sorted
by Gray rank (neighbours in that order differ in few bits) and searched from upper nodes down: a node is a run of
entries with the bits that all of them share; two nodes are compared on the bits both share, and the whole pair of
groups is dropped as soon as more than ``limit`` of these differ. Groups that are already one component are not
opened. A bucket gives back links to one member of each component found, never all pairs. Components come from rounds
of star contraction, each written to the shared folder.

With one word, ``limit`` is ``radius`` and the result is exact. With more words, ``limit`` counts differing bits of
the whole code, whose share estimates the angle between two texts, and buckets come from ``MASKS`` masks of ``MASK_BITS`` bits
drawn from all words: a pair with a share p of differing bits is met with probability 1 - (1 - (1-p)^16)^64, which is 0.99 for
p = 0.15 (a similarity of 0.8) and above 0.9999 for p = 0.1 (0.9). ``radius`` then plays no part.

With ``similarity``, codes only say which texts meet, and a link is a pair whose sets of shingles have at least that
Jaccard similarity. Bits are then votes of distinct shingles and equal sets, not equal codes, are one entry. First the links of
the search above are compared by their shingles, joined by entry in Spark. Groups of entries that met but did not become one
component are then searched again: every entry beside the nearest entry of each other component in its buckets, then all
pairs of different components, so no pair that met is left out. In the first search a bucket's entries are linked to the most
central of them, which the copies of one text resemble more than each other. In the others, pairs go only if they can be
similar enough: each group's sets are laid beside one set of reference; two sets share what both hold of it, and beyond it
no more than the smaller remainder. What a set holds beyond the reference also goes to one of some bits by its hash, and a bit
is the parity of its elements: two sets differ by at least as many elements as bits, so hardly a pair goes that is not similar.

Buckets larger than ``split`` entries are dealt out again by blocks of bits they have not used yet, one more than a pair may
differ in, so that the pair agrees in one of them.

Cases: null and blank texts have fingerprint 0 and are linked like any other; texts of fewer words than a shingle are
one shingle; equal rows are linked; a null ``doc_id`` does not name a component unless nothing else does; an empty
table gives no row. Long texts are hashed in runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .bloom import maybe_in
from .texts import mix, pieces, returned

SHINGLE, SEED, RADIUS = 4, 42, 4
SPLIT = 1 << 16
#: buckets of up to FEW entries are compared many at a time, those of up to SMALL pair by pair, others node by node
FEW, SMALL, FAN = 32, 1024, 16
SPREAD = np.uint64(0x9E3779B97F4A7C15)
RUN = 1 << 16
LANES = np.uint64(0x0101010101010101)
#: of codes of several words: masks, a multiple of the words times 64 over the bits of a mask
MASK_BITS, MASKS = 16, 64
#: masks when the pairs met are verified
VERIFIED_MASKS = 96
#: elements of a set of reference that others are laid beside, one bit each
REFERENCE = 384
REFERENCE_BITS = [f"b{k}" for k in range(REFERENCE // 64)]
#: bits of parity of the elements beyond these
PARITY = 192
PARITY_BITS = [f"p{k}" for k in range(PARITY // 64)]
#: a set's size n and how many of the reference it holds m, as n << COUNTED | m, which of these, and the parities
COUNTED = 16
SUMMARY = ["nm", *REFERENCE_BITS, *PARITY_BITS]
#: share of the entries by which large buckets are told: one of more than SPLIT has some thousand of them
SAMPLED = 64


# ---- fingerprints


def shingle_hashes(text: str | None, width: int = SHINGLE, seed: int = SEED) -> Iterator[list[int]]:
    """XXH64 of every run of ``width`` words of the text (A-Z folded, joined by spaces), in lists of bounded length."""
    words = (text or "").encode().lower().split()
    if not words:
        return
    if len(words) <= width:
        yield [xxhash.xxh64_intdigest(b" ".join(words), seed)]
        return
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(words) - width + 1, RUN):
        part = words[at : at + RUN + width - 1]
        joined = b" ".join(part)
        size = np.fromiter(map(len, part), np.int64, len(part)) + 1
        end = np.cumsum(size) - 1
        start = end - size + 1
        n = len(part) - width + 1
        yield [digest(joined[a:b], seed) for a, b in zip(start[:n].tolist(), end[width - 1 :].tolist(), strict=True)]


def fingerprints(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Majority bits of runs of hashes, ``size`` hashes each (0: fingerprint 0)."""
    full = size > 0
    runs = size[full]
    out = np.zeros(len(size), np.uint64)
    if not len(runs):
        return out
    blocks = -(-runs // 255)
    first = np.cumsum(blocks) - blocks
    at = np.repeat(np.cumsum(runs) - runs, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    count = np.empty((len(runs), 8, 8), np.int64)
    for k in range(8):  # bits k, 8 + k, ... counted in the eight bytes of one word
        lanes = np.add.reduceat(hashes >> np.uint64(k) & LANES, at)
        count[:, :, k] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    bits = 2 * count.reshape(len(runs), 64) > runs[:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def wide_fingerprints(hashes: np.ndarray, size: np.ndarray, words: int) -> list[np.ndarray]:
    """The fingerprint's words; those after the first come from the mixed hashes."""
    out = [fingerprints(hashes, size)]
    for _ in range(1, words):
        hashes = mix(hashes + SPREAD)
        out.append(fingerprints(hashes, size))
    return out


def _set_of(parts: Iterator[list[int]]) -> np.ndarray:
    """The distinct hashes, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.array(part, np.uint64) for part in parts)]))


def _set_fingerprint_task(width: int, seed: int, words: int):
    """Fingerprints by distinct shingles, and the entry v: a hash of their set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces(batch, limit=2 << 20):
                sets = [_set_of(shingle_hashes(text, width, seed)) for text in rows.column("text").to_pylist()]
                size = np.array([len(x) for x in sets], np.int64)
                fps = wide_fingerprints(np.concatenate(sets), size, words)
                v = np.array([xxhash.xxh64_intdigest(x.tobytes(), seed) for x in sets], np.uint64)
                kept = [i for i, name in enumerate(rows.schema.names) if name != "text"]
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in kept), *(pa.array(x.view(np.int64)) for x in [*fps, v])],
                                                 names=[*(rows.schema.names[i] for i in kept), *word_names(words), "v"])

    return run


def _shingle_set_task(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces(batch, limit=2 << 20):
                sets = [_set_of(shingle_hashes(text, width, seed)).view(np.int64) for text in rows.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("v"), pa.array(sets, pa.list_(pa.int64()))], names=["v", "grams"])

    return run


def _fingerprint_task(width: int, seed: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces(batch, limit=2 << 20):
                found: list[np.ndarray] = []
                size = np.zeros(rows.num_rows, np.int64)
                for i, text in enumerate(rows.column("text").to_pylist()):
                    for part in shingle_hashes(text, width, seed):
                        found.append(np.array(part, np.uint64))
                        size[i] += len(part)
                fps = wide_fingerprints(np.concatenate(found) if found else np.zeros(0, np.uint64), size, words)
                kept = [i for i, name in enumerate(rows.schema.names) if name != "text"]
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in kept), *(pa.array(fp.view(np.int64)) for fp in fps)],
                                                 names=[*(rows.schema.names[i] for i in kept), *word_names(words)])

    return run


def word_names(words: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, words))]


def with_fingerprint(docs: DataFrame, width: int = SHINGLE, seed: int = SEED, words: int = 1, sets: bool = False) -> DataFrame:
    """The columns of ``docs`` but the text, and the fingerprint's words fp, fp1, ... as signed longs.

    ``sets``: of distinct shingles, and with a key v of their set.
    """
    names = [*word_names(words), *(["v"] if sets else [])]
    plain = docs.drop(*names).withColumn("text", F.col("text").cast("string"))
    fields = [f for f in plain.schema.fields if f.name != "text"]
    schema = T.StructType([*fields, *(T.StructField(name, T.LongType()) for name in names)])
    return plain.mapInArrow(returned((_set_fingerprint_task if sets else _fingerprint_task)(width, seed, words)), schema)


# ---- buckets


def blocks(bits: list[int], n: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(np.array(bits), n)]


def drawn_masks(words: int, masks: int = MASKS) -> list[list[int]]:
    """``masks`` sets of MASK_BITS bits of codes of several words; every round of them uses each bit once."""
    rng = np.random.Generator(np.random.PCG64(2))
    rounds = masks * MASK_BITS // (64 * words)
    return [sorted(map(int, bits)) for _ in range(rounds) for bits in rng.permutation(64 * words).reshape(-1, MASK_BITS)]


def _masks(bits: list[int], words: int) -> list[int]:
    """The bits as one signed long per word."""
    values = [sum(1 << b % 64 for b in bits if b // 64 == w) for w in range(words)]
    return [v - (1 << 64) if v >> 63 else v for v in values]


def gray_rank(fp: Column) -> Column:
    """The place of a code in Gray order: each bit is the parity of the bits at and above it."""
    return reduce(lambda x, s: x.bitwiseXOR(F.shiftrightunsigned(x, s)), (1, 2, 4, 8, 16, 32), fp)


def _near(a: np.ndarray, b: np.ndarray, limit: int, seen: np.ndarray | None = None) -> np.ndarray:
    """Rows of codes in which a and b differ in at most ``limit`` bits, added up word by word.

    ``seen``: bits to compare (default: all).
    """
    at = np.arange(len(a))
    far = np.zeros(len(a), np.int64)
    for w in range(a.shape[1]):
        apart = a[at, w] ^ b[at, w]
        far = far + np.bitwise_count(apart if seen is None else apart & seen[at, w])
        keep = far <= limit
        at, far = at[keep], far[keep]
    return at


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking entries a[i] and b[i]: the least entry of each component."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


def search(codes: np.ndarray, limit: int) -> np.ndarray:
    """Component labels of codes (rows of words) in Gray order, by a search over pairs of nodes."""
    n = len(codes)
    label = np.arange(n)
    for k in range(1, min(9, n)):
        ok = _near(codes[k:], codes[:-k], limit)
        label = _join(label, ok + k, ok)
    first, varies = [codes], [np.zeros_like(codes)]
    while len(first[-1]) > FAN:
        starts = np.arange(0, len(first[-1]), FAN)
        head = first[-1][starts]
        apart = first[-1] ^ np.repeat(head, FAN, axis=0)[: len(first[-1])]
        first.append(head)
        varies.append(np.bitwise_or.reduceat(apart | varies[-1], starts, axis=0))
    top = len(first) - 1
    todo = [(top, *np.triu_indices(len(first[top])))]
    while todo:
        level, i, j = todo.pop()
        if len(i) > 4096:
            todo += [(level, i[k : k + 4096], j[k : k + 4096]) for k in range(0, len(i), 4096)]
            continue
        keep = _near(first[level][i], first[level][j], limit, ~(varies[level][i] | varies[level][j]))
        i, j = i[keep], j[keep]
        starts = np.arange(0, n, FAN**level)
        low, high = np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)
        open_ = ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))
        i, j = i[open_], j[open_]
        if level == 0:
            label = _join(label, i, j)
        elif len(i):
            below, fan = len(first[level - 1]), np.arange(FAN)
            a = np.repeat((i[:, None] * FAN + fan).ravel(), FAN)
            b = np.repeat(j[:, None] * FAN + fan, FAN, axis=0).ravel()
            real = (a < below) & (b < below) & (a <= b if level > 1 else a < b)
            todo.append((level - 1, a[real], b[real]))
    return label


def _direct(codes: np.ndarray, limit: int) -> np.ndarray:
    """Component labels of a moderate number of codes, all pairs compared."""
    i, j = np.nonzero(np.triu(np.bitwise_count(codes[:, None, 0] ^ codes[None, :, 0]) <= limit, 1))
    if codes.shape[1] > 1 and len(i):
        ok = _near(codes[i], codes[j], limit)
        i, j = i[ok], j[ok]
    return _join(np.arange(len(codes)), i, j)


def bucket_links(bucket: np.ndarray, codes: np.ndarray, limit: int) -> np.ndarray:
    """For entries sorted by bucket and Gray rank, an entry of the same component in the bucket."""
    n = len(codes)
    label = np.arange(n)
    if not n:
        return label
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    size = np.diff(start, append=n)
    few = np.flatnonzero(np.repeat(size <= FEW, size))
    for k in range(1, min(FEW, int(size.max()))):
        few = few[few + k < n]
        few = few[bucket[few] == bucket[few + k]]
        ok = few[_near(codes[few], codes[few + k], limit)]
        label = _join(label, ok, ok + k)
    for s, m in zip(start[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
        label[s : s + m] = s + (_direct if m <= SMALL else search)(codes[s : s + m], limit)
    return label


def central(label: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For every entry the one of its component that is nearest to the majority of the component's bits."""
    order = np.argsort(label, kind="stable")
    start = np.flatnonzero(np.append(True, label[order][1:] != label[order][:-1]))
    size = np.diff(start, append=len(order))
    bits = np.unpackbits(codes[order].view(np.uint8), axis=1)
    most = np.packbits(2 * np.add.reduceat(bits, start, axis=0, dtype=np.int64) > size[:, None], axis=1).view(np.uint64)
    far = np.bitwise_count(codes[order] ^ np.repeat(most, size, axis=0)).sum(1, dtype=np.int64)
    group = np.repeat(np.arange(len(start)), size)
    best = np.lexsort((order, far, group))[start]
    out = np.empty(len(label), np.int64)
    out[order] = np.repeat(order[best], size)
    return out


def may_be_similar(n: np.ndarray, m: np.ndarray, bits: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float,
                   parity: np.ndarray | None = None) -> np.ndarray:
    """Whether sets i and j can reach the similarity, from their sizes ``n`` and what they share with one set of reference.

    ``bits`` says which of its first elements they hold, ``m`` how many: two sets share what both hold of these, and of the
    rest at most the smaller remainder. ``parity`` counts the rest by hash, modulo two: an element that both hold changes the
    same bit of both, so the rests differ by at least one element for each bit that differs.
    """
    rest = np.minimum(n[i] - m[i], n[j] - m[j])
    if parity is not None:
        apart = np.bitwise_count(parity[i] ^ parity[j]).sum(1, dtype=np.int64)
        rest = np.minimum(rest, (n[i] - m[i] + n[j] - m[j] - apart) // 2)
    common = np.bitwise_count(bits[i] & bits[j]).sum(1, dtype=np.int64) + rest
    common = np.minimum(common, np.minimum(n[i], n[j]))
    return common >= similarity * (n[i] + n[j] - common) - 1e-9


def cross_pairs(codes: np.ndarray, part: np.ndarray, limit: int, every: bool, can=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries of different parts that differ in at most ``limit`` bits: all, or for an entry and a part the nearest.

    ``can`` leaves out pairs that cannot be meant: from positions i and j to whether they can.
    """
    n = len(codes)
    step = max(1, (1 << 20) // max(n, 1))
    for at in range(0, n, step):
        apart = np.bitwise_count(codes[at : at + step, None, 0] ^ codes[None, :, 0]).astype(np.int64)
        for w in range(1, codes.shape[1]):
            apart += np.bitwise_count(codes[at : at + step, None, w] ^ codes[None, :, w])
        i, j = np.nonzero((apart <= limit) & (part[at : at + step, None] != part[None]))
        far = apart[i, j]
        i = i + at
        if can is not None and len(i):
            ok = can(i, j)
            i, j, far = i[ok], j[ok], far[ok]
        if every:
            yield i[i < j], j[i < j]
        elif len(i):
            order = np.lexsort((far, part[j], i))
            i, j = i[order], j[order]
            best = np.append(True, (i[1:] != i[:-1]) | (part[j[1:]] != part[j[:-1]]))
            yield i[best], j[best]


def _link_task(words: int, limit: int, every: bool | None = None, similarity: float = 0.0):
    """Links of the search, of several words to the component's most central entry; with ``every`` given, rows have a part, sizes
    and the bits of ``may_be_similar`` before the code, and all or the nearest cross pairs that can be similar count."""
    head = 2 if every is None else 3 + len(SUMMARY)
    known = 4 + len(REFERENCE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, words + head), np.int64)  # bucket, entry, part, code

        def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            codes = np.ascontiguousarray(rows[:, head:]).view(np.uint64)
            if every is None:
                label = bucket_links(rows[:, 0], codes, limit)
                label = central(label, codes) if words > 1 and len(label) else label
                far = np.flatnonzero(label != np.arange(len(label)))
                yield pa.RecordBatch.from_arrays([pa.array(rows[far, 1]), pa.array(rows[label[far], 1])], names=["a", "b"])
                return
            start = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
            for s, e in zip(start.tolist(), [*start[1:].tolist(), len(rows)], strict=True):
                n, m = rows[s:e, 3] >> COUNTED, rows[s:e, 3] & ((1 << COUNTED) - 1)
                bits, parity = (np.ascontiguousarray(x).view(np.uint64) for x in (rows[s:e, 4:known], rows[s:e, known:head]))
                can = lambda i, j: may_be_similar(n, m, bits, i, j, similarity, parity)  # noqa: B023, E731
                for i, j in cross_pairs(codes[s:e], rows[s:e, 2], limit, every, can) if e - s > 1 else ():
                    yield pa.RecordBatch.from_arrays([pa.array(rows[s + i, 1]), pa.array(rows[s + j, 1])], names=["a", "b"])

        for batch in batches:
            rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
            last = int(np.argmax(rows[:, 0] == rows[-1, 0])) if len(rows) else 0
            if last:
                yield from links(rows[:last])
            held = rows[last:]
        if len(held):
            yield from links(held)

    return run


def links(codes: DataFrame, words: int = 1, radius: int = RADIUS, limit: int | None = None, split: int = SPLIT,
          masks: int = MASKS, every: bool | None = None, similarity: float = 0.0) -> DataFrame:
    """Links a, b between entries ``v`` of codes fp, fp1, ...: enough of the near ones to join their components.

    With ``every`` given, of the entries' column ``part``: pairs of different parts, all or the nearest (see cross_pairs), which
    by the columns nm, b0, b1, ..., p0, p1, ... can have the similarity (see may_be_similar).
    """
    names = word_names(words)
    limit = radius if limit is None else limit
    if words == 1:
        parts = blocks(list(range(64)), radius + 2)
        first = [parts[i] + parts[j] for i, j in combinations(range(len(parts)), 2)]
    else:
        first = drawn_masks(words, masks)
    kept = ["v", *(["part", *SUMMARY] if every is not None else []), *names]
    finer = [blocks([b for b in range(64 * words) if b not in bits], limit + 1) for bits in first]
    masked = F.xxhash64(*[F.col(name).bitwiseAND(F.col("mask")[w]) for w, name in enumerate(names)])
    dealt = (codes.select(*kept, F.posexplode(F.lit([_masks(bits, words) for bits in first])).alias("t", "mask"))
             .select(*kept, "t", masked.alias("key")))
    # entries of one in SAMPLED say which buckets may be large; where a bucket is compared does not change what is found
    seen = dealt.where(F.pmod(F.xxhash64("v"), F.lit(SAMPLED)) == 0).groupBy("t", "key").agg(F.count("*").alias("n"))
    large = seen.where(F.col("n") > split // (2 * SAMPLED)).select("t", "key")
    again = codes.sparkSession.createDataFrame([(t, [_masks(bits, words) for bits in parts]) for t, parts in enumerate(finer)],
                                               "t int, again array<array<bigint>>")
    large = large.join(F.broadcast(again), "t")
    whole = F.lit([[0] * words]).cast("array<array<bigint>>")
    placed = (dealt.join(large, ["t", "key"], "left")
              .select(*kept, "t", "key", F.explode(F.coalesce("again", whole)).alias("mask"))
              .select(F.xxhash64("t", "key", "mask", masked).alias("bucket"), *kept))
    in_order = placed.repartition("bucket").sortWithinPartitions("bucket", gray_rank(F.col("fp")))
    return in_order.mapInArrow(returned(_link_task(words, limit, every, similarity)), "a long, b long").distinct()


# ---- verified links


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs a, b those whose sets (v, grams) reach the Jaccard similarity.

    Sizes come first, as narrow rows: sets whose sizes differ by more cannot be that similar. The joins are plain, so that
    adaptive execution splits the pairs of a hot a or b.
    """
    def beside(rows: DataFrame, this: str, value: str, name: str) -> DataFrame:
        return rows.join(sets.select(F.col("v").alias(this), F.expr(value).alias(f"{name}_{this}")), this)

    sized = beside(beside(pairs, "a", "size(grams)", "n"), "b", "size(grams)", "n")
    close = sized.where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9).select("a", "b")
    both = beside(beside(close, "a", "grams", "grams"), "b", "grams", "grams")
    common, total = F.size(F.array_intersect("grams_a", "grams_b")), F.size("grams_a") + F.size("grams_b")
    return both.where(common >= similarity * (total - common) - 1e-9).select("a", "b")


def _reference_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A set's size, how many of the first elements of its reference it holds, which, and the parities of its others."""
    for batch in batches:
        if not batch.num_rows:
            continue
        bits, odd = np.zeros((batch.num_rows, REFERENCE), np.uint8), np.zeros((batch.num_rows, PARITY), np.uint8)
        for i, (grams, others) in enumerate(zip(batch.column("grams"), batch.column("reference"), strict=True)):
            first, own = others.values.to_numpy()[:REFERENCE], grams.values.to_numpy()
            bits[i, : len(first)] = np.isin(first, own, assume_unique=True)
            rest = np.setdiff1d(own, first, assume_unique=True)
            odd[i] = np.bincount(rest % PARITY, minlength=PARITY) % 2
        words = np.concatenate([np.packbits(x, axis=1).view(np.int64) for x in (bits, odd)], axis=1)
        size = batch.column("grams").value_lengths().to_numpy().astype(np.int64) << COUNTED | bits.sum(1, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(size), *[pa.array(np.ascontiguousarray(w)) for w in words.T]],
                                         names=["v", *SUMMARY])


def against_reference(groups: DataFrame, met: DataFrame, sets: DataFrame) -> DataFrame:
    """v, nm, b0, b1, ..., p0, p1, ...: every entry (v, loose) beside its group's set of reference, the entry that most others met."""
    degree = met.groupBy(F.col("b").alias("v")).agg(F.count("*").alias("c"))
    reference = groups.join(degree, "v", "left").groupBy("loose").agg(F.max_by("v", F.struct(F.coalesce("c", F.lit(0)), "v")).alias("r"))
    grams = reference.join(sets.select(F.col("v").alias("r"), F.slice("grams", 1, REFERENCE).alias("reference")), "r").select("loose", "reference")
    both = groups.join(grams, "loose").join(sets, "v").select("v", "grams", "reference")
    return both.mapInArrow(returned(_reference_task), ", ".join(f"{name} long" for name in ["v", *SUMMARY]))


def roots_of(entries: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """The entries with the least entry of their component under ``name``."""
    return entries.join(components(edges).withColumnRenamed("root", name), "v", "left").withColumn(name, F.coalesce(name, "v"))


def verified_links(plain: DataFrame, prints: DataFrame, codes: DataFrame, width: int, seed: int, words: int, limit: int, split: int,
                   similarity: float) -> DataFrame:
    """Links between entries of at least the similarity: enough to join the components of all such pairs that met."""
    met = stored(links(codes, words, 0, limit, split, VERIFIED_MASKS), "met")
    ids = met.select(F.col("a").alias("v")).unionAll(met.select(F.col("b").alias("v"))).distinct()
    holders = prints.groupBy("v").agg(F.min("_at").alias("_at")).join(ids, "v")
    holders = stored(holders, "holders")
    # most texts have met no other: they are left out before the shuffle
    meant = plain.select("_at", "text").where(maybe_in(holders, "_at")(F.col("_at")))
    texts = meant.join(holders, "_at").dropDuplicates(["v"]).select("v", "text")
    sets = stored(texts.mapInArrow(returned(_shingle_set_task(width, seed)), "v long, grams array<long>"), "sets")
    good = stored(similar(met, sets, similarity), "similar")
    loose = None
    for every in (False, True):
        if loose is None:
            if good.count() == met.count():
                break
            loose = stored(roots_of(ids, met, "loose"), "loose")
            seen = stored(against_reference(loose, met, sets), "reference")
        parts = stored(roots_of(loose, good, "part"), "parts")
        open_ = parts.groupBy("loose").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("loose")
        left = stored(codes.join(parts.join(open_, "loose").select("v", "part"), "v").join(seen, "v"), "open")
        if left.isEmpty():
            break
        pairs = links(left, words, 0, limit, split, VERIFIED_MASKS, every, similarity)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        good = stored(good.unionAll(similar(pairs, sets, similarity)), "similar")
    return good


# ---- components


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges (a, b) but the roots: the least vertex of its component.

    Star contraction in rounds: every vertex hands its larger neighbours, then its smaller ones, to the least of them.
    """
    pairs = stored(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v <> m").distinct(), "links")
    before = None
    while True:
        both = pairs.select("v", "m").unionAll(pairs.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.least(F.min("m"), F.first("v")).alias("least"))
        large = both.where("m > v").join(least, "v").select(F.col("m").alias("v"), F.col("least").alias("m")).distinct()
        least = large.groupBy("v").agg(F.min("m").alias("least"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct("v", F.col("least").alias("m")), F.struct(F.col("m").alias("v"), F.col("least").alias("m")))).alias("x"))
        pairs = stored(small.select("x.v", "x.m").where("v <> m").distinct(), "stars")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if now == before:
            return pairs.select("v", F.col("m").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, words: int = 1,
                    limit: int | None = None, split: int = SPLIT, carry: tuple[str, ...] = (), similarity: float | None = None) -> DataFrame:
    """doc_id, fp, component (a key of the group), component_id (its smallest doc_id) and the columns of ``carry``.

    ``similarity``: of codes of several words, join only texts whose sets of shingles have it.
    """
    names = word_names(words)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, "text")
    if similarity is None:
        prints = stored(with_fingerprint(plain, width, seed, words), "fingerprints")
        entry = F.col("fp") if words == 1 else F.xxhash64(*names)
        codes = stored(prints.groupBy(*names).agg(F.min("doc_id").alias("first")).withColumn("v", entry), "codes")
        edges = links(codes, words, radius, limit, split)
    else:
        plain = plain.withColumn("_at", F.xxhash64("doc_id", "text"))
        prints = stored(with_fingerprint(plain, width, seed, words, sets=True), "fingerprints")
        entry = F.col("v")
        codes = stored(prints.groupBy("v", *names).agg(F.min("doc_id").alias("first")), "codes")
        edges = verified_links(plain, prints, codes, width, seed, words, limit, split, similarity)
    roots = components(edges)
    rooted = codes.join(roots, "v", "left").select("v", "first", F.coalesce("root", "v").alias("component"))
    least = rooted.groupBy("component").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "component").select("v", "component", "component_id")
    return prints.withColumn("v", entry).join(named, "v").select("doc_id", *carry, "fp", "component", "component_id")
