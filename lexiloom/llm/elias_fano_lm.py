"""A language model in Elias-Fano tries, and the scores of texts under it.

Tokens are words (A-Z folded) and one end per text. The model is a word bigram with a Dirichlet prior on the unigrams:

    P(w | p) = (c(p w) + mu P1(w)) / (c(p) + mu),   P1(w) = (c(w) - D) / N,   P1(unknown) = D V / N

with D the absolute discount n1 / (n1 + 2 n2). All unknown words together are one outcome. Numerator and denominator
add up separately, so a text's score is a sum over its tokens of a part that the trie of the token's word knows.

A trie holds, for a shard of the words, one level of words and one of their predecessors. Node keys of each level are a
monotone sequence in Elias-Fano code (high parts in unary, low bytes packed), pointers from a word to its run of
predecessors likewise, and smoothed log probabilities are quantised to 16 bits. Levels are flat byte ranges of one
buffer, read by views or by a memory map. A pair is found by a successor search relative to its context: only inside
the run of its word.

1. Words of the training texts are counted: each task adds up its own, shards add up the tasks'.
2. Tokens of all texts go to the shard of their word, packed in runs; a word of more than a ``HEAVY``-th of all tokens
   is dealt by its predecessor too, and its count, one of at most ``HEAVY``, is broadcast. A shard builds its trie from
   the training tokens, looks all tokens up, and returns one sum per text.
3. Sums meet by run of texts.

Words are told apart by 64-bit hashes, predecessors of one word by 32 bits. A shard holds about ``SHARD_TOKENS``
tokens, unless one pair of words has more: all occurrences of a pair stay in one shard.

Cases: null and blank texts are their end alone; without any training text every word is unknown and base_score and
score are null; equal rows are scored one by one; a null ``doc_id`` is held out if the caller's column says so (null:
no); an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .texts import U64, bytes_of, counts, pieces, returned, words

END = U64(0x5D1E9C7B3A482F61)
MU = 20.0
HEAVY = 2000
SHARD_TOKENS = 2_000_000
#: distinct words that a task gathers before it hands them on
GATHERED = 1_500_000
#: texts of a run: their numbers have 16 bits
RUN_ROWS = 1 << 16


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hash, text, and 32 bits of the word before (0: first) of every token."""
    w = words(*bytes_of(texts))
    per = counts(w.doc, len(texts)) + 1
    stop = np.cumsum(per)
    out = np.empty(int(per.sum()), np.uint64)
    inner = np.ones(len(out), bool)
    inner[stop - 1] = False
    out[inner], out[~inner] = w.hash, END
    before = np.zeros(len(out), np.uint32)
    before[1:] = np.maximum(out[:-1] >> U64(32), U64(1))
    before[stop - per] = 0
    return out, np.repeat(np.arange(len(texts)), per), before


# ---- Elias-Fano levels


def ef_encode(values: np.ndarray) -> bytes:
    """A monotone sequence of unsigned 64-bit integers: count, bytes per low part, high parts in unary, low parts."""
    n = len(values)
    top = int(values[-1]) if n else 0
    low_bytes = max(0, min(7, (max(1, top // max(n, 1)).bit_length() - 1) // 8))
    low = U64(8 * low_bytes)
    high = (values >> low).astype(np.int64) if n else np.zeros(0, np.int64)
    bits = np.zeros((int(high[-1]) if n else 0) + n + 1, np.uint8)
    bits[high + np.arange(n)] = 1
    lows = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low_bytes]
    unary = np.packbits(bits, bitorder="little").tobytes()
    return np.array([n, low_bytes, len(unary)], "<u8").tobytes() + unary + lows.tobytes()


class EliasFano:
    """A view of an encoded sequence: its buckets by high part, and search inside a range of positions."""

    def __init__(self, data: memoryview):
        n, low_bytes, size = np.frombuffer(data, "<u8", 3).tolist()
        self.n, self.low_bytes, self.bytes = n, low_bytes, 24 + size + n * low_bytes
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, 24), bitorder="little")
        ones = np.flatnonzero(bits)[:n]
        self.high = ones - np.arange(n)
        self.lows = np.frombuffer(data, np.uint8, n * low_bytes, 24 + size).reshape(n, low_bytes)

    def get(self, at: np.ndarray) -> np.ndarray:
        out = self.high[at].astype(np.uint64) << U64(8 * self.low_bytes)
        for b in range(self.low_bytes):
            out |= self.lows[at, b].astype(np.uint64) << U64(8 * b)
        return out

    def find(self, value: np.ndarray, start: np.ndarray | int = 0, stop: np.ndarray | None = None) -> np.ndarray:
        """Position of every value within its range of positions, or -1: the successor is sought by halving."""
        low = np.broadcast_to(np.asarray(start, np.int64), value.shape).copy()
        end = np.full(value.shape, self.n, np.int64) if stop is None else stop.astype(np.int64)
        high = end.copy()
        while len(live := np.flatnonzero(low < high)):
            mid = (low[live] + high[live]) >> 1
            less = self.get(mid) < value[live]
            low[live] = np.where(less, mid + 1, low[live])
            high[live] = np.where(less, high[live], mid)
        inside = low < end
        hit = np.zeros(value.shape, bool)
        hit[inside] = self.get(low[inside]) == value[inside]
        return np.where(hit, low, -1)


def quantise(values: np.ndarray) -> bytes:
    """Least, step and 16-bit codes."""
    least = float(values.min()) if len(values) else 0.0
    step = (float(values.max()) - least) / 65535 if len(values) else 0.0
    codes = np.rint((values - least) / (step or 1.0)).astype("<u2")
    return np.array([least, step], "<f8").tobytes() + codes.tobytes()


class Trie:
    """Words, pointers and predecessors with their values, over one buffer."""

    def __init__(self, data: bytes | memoryview | np.memmap):
        data = memoryview(data)
        self.words = EliasFano(data)
        data = data[self.words.bytes :]
        self.word_value, data = self._values(data, self.words.n)
        self.pointers = EliasFano(data)
        data = data[self.pointers.bytes :]
        self.before = EliasFano(data)
        data = data[self.before.bytes :]
        self.pair_value, data = self._values(data, self.before.n)

    @staticmethod
    def _values(data: memoryview, n: int) -> tuple[tuple[float, float, np.ndarray], memoryview]:
        least, step = np.frombuffer(data, "<f8", 2).tolist()
        return (least, step, np.frombuffer(data, "<u2", n, 16)), data[16 + 2 * n :]

    @staticmethod
    def build(word: np.ndarray, word_value: np.ndarray, first: np.ndarray, before: np.ndarray, pair_value: np.ndarray) -> bytes:
        """Sorted words; the first pair of each (one more entry at the end); predecessors ascending within a word."""
        # the predecessors of all words make one ascending sequence: the word's number goes above
        owner = np.repeat(np.arange(len(word), dtype=np.uint64), np.diff(first))
        return b"".join([ef_encode(word), quantise(word_value), ef_encode(first.astype(np.uint64)),
                         ef_encode(owner << U64(32) | before.astype(np.uint64)), quantise(pair_value)])

    def log_numerator(self, word: np.ndarray, before: np.ndarray, absent: float) -> np.ndarray:
        """log10 of every token's numerator; ``absent`` for words that the trie does not hold."""
        distinct, back = np.unique(word, return_inverse=True)
        node = self.words.find(distinct)[back]
        known = np.flatnonzero(node >= 0)
        least, step, codes = self.word_value
        out = np.full(len(word), absent)
        out[known] = least + step * codes[node[known]]
        start, stop = self.pointers.get(node[known]), self.pointers.get(node[known] + 1)
        key = node[known].astype(np.uint64) << U64(32) | before[known].astype(np.uint64)
        pair = self.before.find(key, start.astype(np.int64), stop)
        found = pair >= 0
        least, step, codes = self.pair_value
        out[known[found]] = least + step * codes[pair[found]]
        return out


# ---- counting words


class Totals(NamedTuple):
    tokens: int
    types: int
    discount: float
    texts: int
    heavy: np.ndarray  # sorted
    heavy_count: np.ndarray


def _count_task(n_shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def emit() -> pa.RecordBatch:
            word, n = _add_up(held)
            held.clear()
            shard = (word % U64(n_shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            found, first = np.unique(shard[order], return_index=True)
            cut = [order[a:b] for a, b in zip(first, np.append(first[1:], len(order)), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([word[c].tobytes() for c in cut], pa.binary()),
                                               pa.array([n[c].astype("<u4").tobytes() for c in cut], pa.binary())],
                                              names=["shard", "words", "n"])

        for batch in batches:
            for rows in pieces(batch):
                held.append(np.unique(tokens(rows.column("text"))[0], return_counts=True))
                if sum(len(x[0]) for x in held) > GATHERED:
                    held[:] = [_add_up(held)]
                    if len(held[0][0]) > GATHERED // 2:
                        yield emit()
        if held:
            yield emit()

    return run


def _add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    word = np.concatenate([p[0] for p in parts])
    order = np.argsort(word, kind="stable")
    word, n = word[order], np.concatenate([p[1] for p in parts]).astype(np.int64)[order]
    if not len(word):
        return word, n
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    return word[first], np.add.reduceat(n, first)


UNIGRAMS = ("shard int, words binary, n binary, tokens long, types long, once long, twice long, ends long, "
            "large array<struct<word:long,n:long>>")
_UNIGRAMS = pa.schema([("shard", pa.int32()), ("words", pa.binary()), ("n", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64()),
                       ("once", pa.int64()), ("twice", pa.int64()), ("ends", pa.int64()),
                       ("large", pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())])))])


def _shard_counts(table: pa.Table) -> pa.Table:
    parts = [(np.frombuffer(w, "<u8"), np.frombuffer(n, "<u4")) for w, n in zip(table["words"].to_pylist(), table["n"].to_pylist(), strict=True)]
    word, n = _add_up(parts)
    large = np.flatnonzero(n * HEAVY >= n.sum())  # at most HEAVY of them
    return pa.Table.from_pylist([{
        "shard": table["shard"][0].as_py(), "words": word.tobytes(), "n": n.astype("<u8").tobytes(), "tokens": int(n.sum()),
        "types": len(word), "once": int((n == 1).sum()), "twice": int((n == 2).sum()), "ends": int(n[word == END].sum()),
        "large": [{"word": int(w), "n": int(c)} for w, c in zip(word[large].view(np.int64), n[large], strict=True)]}], schema=_UNIGRAMS)


def count_words(training: DataFrame, n_shards: int) -> tuple[DataFrame, Totals]:
    """Sorted word hashes and counts per shard, and the corpus's totals."""
    plain = training.select(F.col("text").cast("string").alias("text"))
    parts = plain.mapInArrow(returned(_count_task(n_shards)), "shard int, words binary, n binary")
    unigrams = stored(parts.groupBy("shard").applyInArrow(_shard_counts, UNIGRAMS), "unigrams")
    row = unigrams.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "once", "twice", "ends"))).first()
    heavy = (unigrams.select(F.explode("large").alias("x")).select("x.*")
             .where(F.col("n") * HEAVY >= row["tokens"]).collect())  # at most HEAVY rows
    word = np.array([r["word"] for r in heavy], np.int64).view(np.uint64)
    order = np.argsort(word)
    discount = (row["once"] + 0.5) / (row["once"] + 2 * row["twice"] + 1)
    return unigrams, Totals(row["tokens"], row["types"], discount, row["ends"], word[order], np.array([r["n"] for r in heavy], np.int64)[order])


# ---- tokens to shards


EVENTS = "shard int, piece long, n_train int, n_docs int, payload binary, doc_ids array<long>, n_tokens binary"
_EVENTS = pa.schema([("shard", pa.int32()), ("piece", pa.int64()), ("n_train", pa.int32()), ("n_docs", pa.int32()), ("payload", pa.binary()),
                     ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.binary())])


def _pack_run(word: np.ndarray, before: np.ndarray, doc: np.ndarray) -> bytes:
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    size = np.diff(first, append=len(word))
    return b"".join([np.array([len(first), len(word)], "<u4").tobytes(), word[first].tobytes(), size.astype("<u4").tobytes(),
                     before.astype("<u4").tobytes(), doc.astype("<u2").tobytes()])


def _unpack_run(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of the run, tokens of each, and every token's predecessor and text."""
    u, n = np.frombuffer(data, "<u4", 2).tolist()
    return (np.frombuffer(data, "<u8", u, 8), np.frombuffer(data, "<u4", u, 8 + 8 * u).astype(np.int64),
            np.frombuffer(data, "<u4", n, 8 + 12 * u), np.frombuffer(data, "<u2", n, 8 + 12 * u + 4 * n))


def _event_task(n_shards: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = shared.value.heavy
        base, number = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for rows in pieces(batch, rows=RUN_ROWS):
                train = rows.column("train").to_numpy(zero_copy_only=False)
                order = np.argsort(~train, kind="stable")  # training texts first
                rows = rows.take(pa.array(order))
                word, doc, before = tokens(rows.column("text"))
                shard = word % U64(n_shards)
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, word), len(heavy) - 1)
                    wide = heavy[at] == word
                    shard[wide] = ((word[wide] >> U64(7)) + before[wide].astype(np.uint64) * U64(0x9E3779B1)) % U64(n_shards)
                by = np.argsort(shard << U64(40) | word >> U64(24), kind="stable")
                word, doc, before, shard = word[by], doc[by], before[by], shard[by].astype(np.int64)
                found, first = np.unique(shard, return_index=True)
                blobs = [_pack_run(word[a:b], before[a:b], doc[a:b]) for a, b in zip(first, np.append(first[1:], len(shard)), strict=True)]
                n = len(found) + 1
                shards = [*found.tolist(), (base + number) % n_shards]
                nothing = [None] * len(found)
                yield pa.RecordBatch.from_arrays([
                    pa.array(shards, pa.int32()), pa.array([base + number] * n, pa.int64()), pa.array([int(train.sum())] * n, pa.int32()),
                    pa.array([rows.num_rows] * n, pa.int32()), pa.array([*blobs, None], pa.binary()),
                    pa.array([*nothing, rows.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([*nothing, np.bincount(doc, minlength=rows.num_rows).astype("<i8").tobytes()], pa.binary())], schema=_EVENTS)
                number += 1

    return run


SUMS = "piece long, n_train int, n_docs int, doc_ids array<long>, n_tokens binary, n_known binary, base binary, score binary"
_SUMS = pa.schema([("piece", pa.int64()), ("n_train", pa.int32()), ("n_docs", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
                   ("n_tokens", pa.binary()), ("n_known", pa.binary()), ("base", pa.binary()), ("score", pa.binary())])


def _word_counts(word: np.ndarray, unigrams: tuple[np.ndarray, np.ndarray], totals: Totals) -> np.ndarray:
    out = np.zeros(len(word), np.int64)
    for known, n in (unigrams, (totals.heavy, totals.heavy_count)):
        if len(known):
            at = np.minimum(np.searchsorted(known, word), len(known) - 1)
            out = np.where(known[at] == word, n[at], out)
    return out


def build_trie(word: np.ndarray, size: np.ndarray, before: np.ndarray, train: np.ndarray, count: np.ndarray, totals: Totals, mu: float) -> bytes:
    """The trie of a shard's training tokens: words ``word`` (sorted, distinct) with counts, tokens by (word number, predecessor)."""
    owner = np.repeat(np.arange(len(word), dtype=np.uint64), size)
    pair, n = np.unique((owner << U64(32) | before.astype(np.uint64))[train], return_counts=True)
    of = (pair >> U64(32)).astype(np.int64)
    used = count > 0
    prior = mu * (count - totals.discount) / max(totals.tokens, 1)
    first = np.searchsorted(of, np.arange(len(word) + 1))
    keep = np.flatnonzero(used)
    # words without a training token have no pairs, so dropping them leaves the runs of the others as they are
    return Trie.build(word[keep], np.log10(prior[keep]), np.append(first[keep], len(pair)), (pair & U64(0xFFFFFFFF)).astype(np.uint32),
                      np.log10(n + prior[of]))


def _score_task(shared, mu: float):
    def run(events: pa.Table, unigrams: pa.Table) -> pa.Table:
        totals: Totals = shared.value
        listed = events.filter(events["payload"].is_null())
        out = [r | {"n_known": None, "base": None, "score": None} for r in listed.drop_columns(["shard", "payload"]).to_pylist()]
        runs = events.filter(events["payload"].is_valid())
        if runs.num_rows:
            known = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            if unigrams.num_rows:
                known = (np.frombuffer(unigrams["words"][0].as_py(), "<u8"), np.frombuffer(unigrams["n"][0].as_py(), "<u8").astype(np.int64))
            parts = [_unpack_run(x.as_py()) for x in runs["payload"]]
            n_train, n_docs = runs["n_train"].to_numpy(), runs["n_docs"].to_numpy().astype(np.int64)
            base = np.cumsum(n_docs) - n_docs
            # one ascending list of words; tokens in its order
            at = np.cumsum([0] + [len(p[2]) for p in parts])
            run_word, run_size = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            run_first = np.cumsum(run_size) - run_size
            by = np.argsort(run_word, kind="stable")
            token = _spread(run_first[by], run_size[by])
            before = np.concatenate([p[2] for p in parts])[token]
            part = np.repeat(np.arange(len(parts), dtype=np.int32), np.diff(at))
            text = np.concatenate([p[3] for p in parts]).astype(np.int32)
            train = (text < n_train[part])[token]
            text = (text + base.astype(np.int32)[part])[token]
            del part, token
            sorted_word = run_word[by]
            first = np.flatnonzero(np.append(True, sorted_word[1:] != sorted_word[:-1]))
            word, size = sorted_word[first], np.add.reduceat(run_size[by], first)
            count = _word_counts(word, known, totals)
            n = int(n_docs.sum())
            trie = Trie(build_trie(word, size, before, train, count, totals, mu))
            absent = np.log10(mu * totals.discount * totals.types / totals.tokens) if totals.tokens else 0.0
            score = np.zeros(n)
            step = 1 << 20
            ends = np.cumsum(size)
            for a in range(0, len(before), step):
                owner = np.searchsorted(ends, np.arange(a, min(a + step, len(before))), "right")
                score += np.bincount(text[a : a + step], trie.log_numerator(word[owner], before[a : a + step], absent), n)
            # a word's denominator is due where it is the word before the next token; the first token's, at the end
            context = np.log10(np.where(word == END, totals.texts, count) + mu)
            score -= np.bincount(text, np.repeat(context, size), n)
            plain = np.bincount(text, np.repeat(np.log10(count + 0.1), size), n)
            seen = np.bincount(text, np.repeat(count > 0, size), n).astype("<i4")
            for piece, t, m, a in zip(runs["piece"].to_pylist(), n_train.tolist(), n_docs.tolist(), base.tolist(), strict=True):
                out.append({"piece": piece, "n_train": t, "n_docs": m, "doc_ids": None, "n_tokens": None, "n_known": seen[a : a + m].tobytes(),
                            "base": plain[a : a + m].astype("<f8").tobytes(), "score": score[a : a + m].astype("<f4").tobytes()})
        return pa.Table.from_pylist(out, schema=_SUMS)

    return run


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)


SCORES = "doc_id long, trained boolean, n_tokens long, n_known long, base_sum double, score double"


def _gather(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    listed = next(r for r in rows if r["n_tokens"] is not None)
    n = listed["n_docs"]
    known, base, score = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    for r in rows:
        if r["base"] is not None:
            known += np.frombuffer(r["n_known"], "<i4")
            base += np.frombuffer(r["base"], "<f8")
            score += np.frombuffer(r["score"], "<f4")
    return pa.table({"doc_id": pa.array(listed["doc_ids"], pa.int64()), "trained": pa.array(np.arange(n) < listed["n_train"]),
                     "n_tokens": pa.array(np.frombuffer(listed["n_tokens"], "<i8")), "n_known": known, "base_sum": base, "score": score})


def score(docs: DataFrame, training: Column, mu: float = MU, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, trained, n_tokens, n_known, train_tokens, base_score, score of every text; the model learns from rows where ``training``."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.coalesce(training, F.lit(False)).alias("train"))
    size = plain.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    n_shards = max(1, -(-size // (6 * shard_tokens)))  # about six bytes a token
    unigrams, totals = count_words(plain.where("train"), n_shards)
    shared = docs.sparkSession.sparkContext.broadcast(totals)
    events = plain.mapInArrow(returned(_event_task(n_shards, shared)), EVENTS)
    sums = events.groupBy("shard").cogroup(unigrams.select("shard", "words", "n").groupBy("shard")).applyInArrow(_score_task(shared, mu), SUMS)
    found = sums.groupBy("piece").applyInArrow(_gather, SCORES)
    whole = np.log10(totals.tokens + 0.1 * (totals.types + 1))
    learned = F.lit(totals.tokens > 0)
    return found.select("doc_id", "trained", "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"),
                        F.when(learned, F.col("base_sum") - F.col("n_tokens") * float(whole)).alias("base_score"),
                        F.when(learned, F.col("score")).alias("score"))
