"""Cross-tokenizer alignment: which token occurrences of two tokenizers cover the same bytes, and how usual each pair is.

Both tokenizers' tokens tile the bytes of a space and the text. All tokens of a run of texts are sorted by their start;
a group ends where a start reaches the running maximum of the ends before it, that is where tokens of both end. Inside
its group every A token is linked with the B tokens whose byte ranges overlap its own; as both sides tile, these are a
run of neighbours, so that links are expanded one by one and a long group costs no more than its links.

A pair of ids counts the documents that hold it linked. Every document's distinct pairs with their multiplicity are
stored with the document; counts are added up in the tasks before they are shuffled. To score documents, the pairs that
most documents hold (at most ``HEAD``) and the highest count of every A id (at most its vocabulary) are broadcast and
answered in place; the other pairs of a document join their counts by shuffle, where none is frequent any more.

Cases: a null or empty text, and one whose joined A or B bytes are not a space and the text, has no tokens: zeros and
''. A null id stays null, equal rows are documents of their own, an empty table gives no row, and other columns do not
come along. Texts of any length are read whole; runs of about ``RUN`` bytes are aligned at once, a longer text alone.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .texts import bytes_of, counts, pieces, ragged, returned
from .tokens import KEPT, Encoder, _keys, _Known

RUN = 1 << 20
#: pairs whose counts are broadcast: 16 bytes each
HEAD = 1 << 19
#: distinct pairs that a task adds up before it hands them on
HELD = 1 << 21
ID_BITS = 20
SPACE = "▁"

_DOC = ("rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


class Bytes:
    """Byte strings by id: one pool, and where each one lies in it."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.pool[ragged(self.size[ids], self.start[ids])]


def byte_values() -> dict[str, int]:
    """The byte for every character of a byte-level vocabulary: printable bytes stand for themselves, the others, in order, for U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel(Encoder):
    """A byte-level tokenizer file; special tokens inside texts are plain text."""

    def __init__(self, path: str):
        super().__init__(path, spaceless=False)
        self.tokenizer.encode_special_tokens = True
        value = byte_values()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.bytes = Bytes([bytes(value.get(c, 0) for c in name) for name in names])


class Pieces:
    """A piece model with byte fallback. Words between single spaces are encoded once, if no piece runs over a space."""

    def __init__(self, path: str, kept: int = KEPT):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = Bytes([bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)])
        self.words_apart = not any(re.search(f"[^{SPACE}]{SPACE}", n) for n in names)
        self.kept, self.known = kept, _Known()

    def _raw(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode(texts, num_threads=1)
        size = np.array([len(x) for x in found], np.int64)
        flat = [i for x in found for i in x]
        return np.array(flat, np.uint32), size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and the number of ids of each."""
        texts = texts.cast(pa.large_string())
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        whole = pc.match_substring_regex(texts, "  |^ | $|^$").to_numpy(zero_copy_only=False) | (not self.words_apart)
        cut = texts.filter(pa.array(~whole))
        ids, per = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(cut):
            lists = pc.split_pattern(cut, " ")
            off = lists.offsets.to_numpy().astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            if self.known.size_in_bytes() > self.kept:
                self.known = _Known()
            keys = _keys(coded.dictionary, True)
            new = self.known.find(keys) < 0
            if new.any():
                found, size = self._raw(coded.dictionary.filter(pa.array(new)).to_pylist())
                self.known.add(keys[new], size, found)
            at = self.known.find(keys)[coded.indices.to_numpy()]
            size = self.known.size[at].astype(np.int64)
            ids = self.known.pool[ragged(size, self.known.start[at])]
            per = np.add.reduceat(size, off[:-1] - off[0])
        if not whole.any():
            return ids, per
        raw, raw_per = self._raw(texts.filter(pa.array(whole)).to_pylist())
        size = np.zeros(len(texts), np.int64)
        size[whole], size[~whole] = raw_per, per
        marks = np.repeat(whole, size)
        out = np.empty(len(marks), np.uint32)
        out[marks], out[~marks] = raw, ids
        return out, size


def _differing(buf: np.ndarray, off: np.ndarray, strings: Bytes, ids: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Whether a text's joined token bytes are not its bytes."""
    n = len(per)
    size = np.bincount(np.repeat(np.arange(n), per), strings.size[ids], n).astype(np.int64)
    bad = size != np.diff(off)
    some = np.flatnonzero(~bad)
    keep = ~np.repeat(bad, per)
    mine = buf[ragged(np.diff(off)[some], off[:-1][some])]
    unequal = np.flatnonzero(strings.joined(ids[keep]) != mine)
    if len(unequal):
        ends = np.cumsum(np.diff(off)[some])
        bad[some[np.searchsorted(ends, unequal, "right")]] = True
    return bad


def groups(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The group of every interval: intervals sorted by start, cut where a start reaches the running maximum of the ends."""
    order = np.lexsort((end, start))
    s, reach = start[order], np.maximum.accumulate(end[order])
    cut = np.ones(len(s), bool)
    cut[1:] = s[1:] >= reach[:-1]
    out = np.empty(len(s), np.int64)
    out[order] = np.cumsum(cut) - 1
    return out


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A index, B index) of all overlapping pairs, for two tilings of the same range."""
    first = np.searchsorted(b_end, a_start, "right")
    n = np.searchsorted(b_start, a_end, "left") - first
    return np.repeat(np.arange(len(a_start)), n), ragged(n, first)


_DECIMALS: list[Bytes] = []


def _decimals(n: int) -> Bytes:
    if not _DECIMALS or len(_DECIMALS[0].size) < n:
        _DECIMALS[:] = [Bytes([b"%d " % i for i in range(n)])]
    return _DECIMALS[0]


def _digests(ids: np.ndarray, side: np.ndarray, group: np.ndarray, doc: np.ndarray, n_docs: int, vocabulary: int) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for every text; '' without tokens. Tokens come by text, then start, A before B."""
    order = np.lexsort((side, group))  # stable: starts ascend on each side
    ids, side, group, doc = ids[order], side[order], group[order], doc[order]
    numbers = _decimals(vocabulary)
    size = numbers.size[ids]
    text = numbers.joined(ids)
    mark = np.full(len(ids), ord(";"), np.uint8)
    same = group[1:] == group[:-1]
    mark[:-1][same] = np.where(side[1:] == side[:-1], ord(","), ord("|"))[same]
    ends = np.cumsum(size)
    text[ends - 1] = mark
    stop = np.cumsum(np.bincount(doc, size, n_docs).astype(np.int64))
    view = memoryview(text)
    return [hashlib.sha256(view[a : b - 1]).hexdigest() if b > a else "" for a, b in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]


def align(texts: pa.Array, a: ByteLevel, b: Pieces) -> dict[str, object]:
    """Columns n_a, n_b, n_groups, n_links, groups_sha256, pairs, times of every text."""
    n = len(texts)
    there = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False)
    row = np.flatnonzero(there)
    texts = texts.filter(pa.array(there)).cast(pa.large_string())
    spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
    buf, off = bytes_of(spaced)
    ids_a, per_a = a.encode(spaced)
    ids_b, per_b = b.encode(texts)
    bad = _differing(buf, off, a.bytes, ids_a, per_a) | _differing(buf, off, b.bytes, ids_b, per_b)
    if bad.any():
        ids_a, ids_b = ids_a[~np.repeat(bad, per_a)], ids_b[~np.repeat(bad, per_b)]
        row, per_a, per_b = row[~bad], per_a[~bad], per_b[~bad]
    doc_a, doc_b = np.repeat(np.arange(len(row)), per_a), np.repeat(np.arange(len(row)), per_b)
    end_a, end_b = np.cumsum(a.bytes.size[ids_a]), np.cumsum(b.bytes.size[ids_b])
    start_a, start_b = end_a - a.bytes.size[ids_a], end_b - b.bytes.size[ids_b]
    group = groups(np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b]))
    at_a, at_b = overlaps(start_a, end_a, start_b, end_b)
    out = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
    out["n_a"][row], out["n_b"][row] = per_a, per_b
    out["n_links"][row] = counts(doc_a[at_a], len(row))
    _, first = np.unique(group[: len(ids_a)], return_index=True)  # every group holds an A token
    out["n_groups"][row] = counts(doc_a[first], len(row))
    sha = np.full(n, "", object)
    side = np.repeat(np.array([0, 1], np.int8), [len(ids_a), len(ids_b)])
    sha[row] = _digests(np.concatenate([ids_a, ids_b]), side, group, np.concatenate([doc_a, doc_b]), len(row),
                        max(len(a.bytes.size), len(b.bytes.size)))
    key = doc_a[at_a].astype(np.uint64) << np.uint64(2 * ID_BITS) | ids_a[at_a].astype(np.uint64) << np.uint64(ID_BITS) | ids_b[at_b].astype(np.uint64)
    key, times = np.unique(key, return_counts=True)
    per = np.zeros(n, np.int64)
    per[row] = counts((key >> np.uint64(2 * ID_BITS)).astype(np.int64), len(row))
    lists = pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32())
    pair = (key & np.uint64((1 << 2 * ID_BITS) - 1)).astype(np.int64)
    return out | {"groups_sha256": sha, "pairs": pa.ListArray.from_arrays(lists, pa.array(pair)),
                  "times": pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int32)))}


def _align_task(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        a, b = ByteLevel(path_a), Pieces(path_b)  # the task's own: what they keep goes with it
        if max(len(a.bytes.size), len(b.bytes.size)) > 1 << ID_BITS:
            raise ValueError(f"a vocabulary has more than {1 << ID_BITS} ids")
        for batch in batches:
            for part in pieces(batch, limit=RUN):
                found = align(part.column("text"), a, b)
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid"), part.column("doc_id"), *[pa.array(found[k]) for k in ("n_a", "n_b", "n_groups", "n_links")],
                     pa.array(found["groups_sha256"], pa.string()), found["pairs"], found["times"]],
                    names=["rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return returned(run)


def _merged(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(n), len(key)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, documents) of a task's documents; what is held is handed on when it grows beyond ``HELD`` pairs."""
    keys, n, waiting = [], [], 0

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"pair": pa.array(keys[0], pa.int64()), "n": pa.array(n[0], pa.int64())})

    for batch in batches:
        if not batch.num_rows:
            continue
        found = batch.column("pairs").flatten().to_numpy()
        keys.append(found)
        n.append(np.ones(len(found)))
        waiting += len(found)
        if waiting > HELD:
            merged = _merged(keys, n)
            keys, n, waiting = [merged[0]], [merged[1]], 0
            if len(keys[0]) > HELD:
                yield rows()
                keys, n = [], []
    if keys:
        merged = _merged(keys, n)
        keys, n = [merged[0]], [merged[1]]
        yield rows()


def _score_task(shared):
    """A row of sums per document for the broadcast pairs, and a row for every other pair of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rid, lists = batch.column("rid").to_numpy(), batch.column("pairs")
            pair, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(rid)), np.diff(lists.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            count = np.where(hit, n[at], 0) if len(known) else np.zeros(len(pair), np.int64)
            top = hit & (count == best[pair >> ID_BITS])
            sums = np.zeros((2, len(rid)), np.int64)
            np.add.at(sums[0], doc[top], times[top])
            np.add.at(sums[1], doc, times * count)
            none = np.zeros((~hit).sum(), np.int64)
            yield pa.RecordBatch.from_pydict({
                "rid": np.concatenate([rid, rid[doc[~hit]]]), "pair": np.concatenate([-1 - rid, pair[~hit]]),  # -1 - rid: no pair
                "times": np.concatenate([np.zeros(len(rid), np.int64), times[~hit]]),
                "n_best": np.concatenate([sums[0], none]), "count_sum": np.concatenate([sums[1], none])})

    return run


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many documents hold a pair linked. A pair is ``A id << 20 | B id``."""
    return aligned.select("pairs").mapInArrow(_count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _head_level(counted: DataFrame, head: int) -> int:
    """The lowest level of counts (eighths of a power of two) such that at most ``head`` pairs are on it or above."""
    levels = {r["level"]: r["m"] for r in counted.groupBy(_level().alias("level")).agg(F.count("*").alias("m")).collect()}
    level, total = max(levels, default=0) + 1, 0
    for k in sorted(levels, reverse=True):
        total += levels[k]
        if total > head:
            break
        level = k
    return level


def _level():
    return F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")


def score(docs: DataFrame, path_a: str, path_b: str, *, doc_id: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    aligned = stored(rows.mapInArrow(_align_task(path_a, path_b), _DOC), "aligned")
    counted = stored(pair_counts(aligned), "pair-counts")
    a_id = F.shiftright("pair", ID_BITS)
    tops = counted.groupBy(a_id.alias("a")).agg(F.max("n").alias("top"))
    top = tops.toArrow()  # one row per id of A at most
    best = np.zeros(1 << ID_BITS, np.int64)
    best[top["a"].to_numpy()] = top["top"].to_numpy()
    level = _head_level(counted, head)
    usual = counted.where(_level() >= level).toArrow()  # at most `head` rows
    order = np.argsort(usual["pair"].to_numpy())
    shared = spark.sparkContext.broadcast((usual["pair"].to_numpy()[order], usual["n"].to_numpy()[order], best))
    found = aligned.select("rid", "pairs", "times").mapInArrow(_score_task(shared), "rid long, pair long, times long, n_best long, count_sum long")
    rare = (counted.where(_level() < level).withColumn("a", a_id).join(F.broadcast(tops), "a")
            .select("pair", "n", (F.col("n") == F.col("top")).alias("is_best")))
    n = F.coalesce("n", F.lit(0))
    sums = found.join(rare, "pair", "left").groupBy("rid").agg(
        F.sum(F.col("n_best") + F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("count_sum") + F.col("times") * n).alias("count_sum"))
    main = aligned.select("rid", F.col("doc_id").alias(doc_id), "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return main.join(sums, "rid").select(doc_id, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
