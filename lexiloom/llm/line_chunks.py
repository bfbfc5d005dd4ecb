"""Removal of repeated runs of lines, cut at content-defined places.

A rolling hash over the hashes of the last ``WINDOW`` lines ends a chunk wherever it is divisible by ``DIVISOR``, so
chunks inside a passage are the same wherever the passage stands; a line of ``LONG`` words or more is a chunk of its
own. Chunks of at least two lines and ``LEAST`` words, and long lines, count. Such chunks miss a passage that is too short to
hold two cuts, so from every line on there is also the shortest run of lines with ``LONG`` words: where it ends depends on
its own lines only. A passage of ``LONG`` words in whole lines holds the one that begins at its first line.

Of chunks with equal bytes in the whole table the first one (by doc_id, then text, then line) stays and the lines of the
others go. Chunks overlap: where a text repeats itself, the lines of its first chunk stay whatever later ones hold of them; a
line that an earlier document holds in an equal chunk goes in any case. So every line that goes still stands somewhere. A
document whose whole text is that of the first one keeps its chunks, for a caller who removes whole copies afterwards. With
``copies`` it loses the lines of all of them: of equal texts the first row keeps what it would keep alone.

Hashes of all chunks are counted first, as narrow rows; only documents that hold a repeated one send the texts of these.
They are dealt out by hash and bytes are compared there: a task reads the rows of one hash in order, holding one
text. Before, each run of rows of a task adds up equal chunks after comparing their bytes, so a chunk that fills a
third of all documents is sent once per run. Documents meet the list of their chunks in one join before and one after.
Copies are told by digests of whole texts, as narrow rows; their chunks are those of their first row, so none is sent for them.

Cases: null texts stay null, empty ones empty; a text of one short line never changes; equal rows have equal texts and
all stay (with ``copies`` the first by the other columns stays); a null ``doc_id`` comes last in the order; an empty table gives
no row; other columns pass through (``removed``, the number of lines that went, is replaced). Long texts are chunked whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import lookup
from .texts import IS_SPACE, U64, bytes_of, mix, pieces, returned, span_hashes

WINDOW, DIVISOR = 2, 3
LONG, LEAST = 50, 10


class Chunks:
    """The chunks of texts that count: document, first line in it, number of lines, first byte, end byte, hash."""

    def __init__(self, texts: pa.Array):
        self.buf, off = bytes_of(texts)
        buf, n_docs = self.buf, len(off) - 1
        breaks = np.flatnonzero(buf == 10)
        start = np.concatenate([off[:-1], breaks + 1])
        doc = np.concatenate([np.arange(n_docs), np.searchsorted(off, breaks, "right") - 1])
        order = np.lexsort((start, doc))
        start, doc = start[order], doc[order]
        if not len(start):
            self.doc = self.line = self.lines = self.start = self.end = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        last = np.append(doc[1:] != doc[:-1], True)
        end = np.where(last, off[doc + 1], np.append(start[1:], 0) - 1)
        solid = ~IS_SPACE[buf]
        begins = np.concatenate([[0], np.cumsum(solid & np.append(True, ~solid[:-1]))]) if len(buf) else np.zeros(1, np.int64)
        words = begins[end] - begins[start]
        # a text's first word may follow the last one of the text before
        words += (end > start) & solid[np.minimum(start, max(len(buf) - 1, 0))] & (np.append(True, ~solid)[start] == 0) if len(buf) else 0
        total = np.concatenate([[0], np.cumsum(words)])

        line = span_hashes(buf, start, end)
        with np.errstate(over="ignore"):
            roll = line.copy()
            for k in range(1, WINDOW):
                same = doc[k:] == doc[:-k]
                roll[k:][same] += line[:-k][same] * U64(0xC2B2AE3D27D4EB4F * k % (1 << 64) | 1)
        long = words >= LONG
        stop = last | long | np.append(long[1:], False) | (mix(roll) % U64(DIVISOR) == 0)
        to = np.flatnonzero(stop)
        at = np.append(0, to[:-1] + 1)
        counts = (to > at) & (total[to + 1] - total[at] >= LEAST)

        first = np.flatnonzero(words > 0)
        through = np.searchsorted(total, total[first] + LONG) - 1
        inside = through < len(doc)
        first, through = first[inside], through[inside]
        inside = doc[first] == doc[through]

        a, b = np.append(at[counts], first[inside]), np.append(to[counts], through[inside])
        # each of the two ascends, as span_hashes needs it
        code = np.concatenate([span_hashes(buf, start[i], end[j]) for i, j in ((at[counts], to[counts]), (first[inside], through[inside]))])
        (a, b), one = np.unique(np.stack([a, b]), axis=1, return_index=True)
        self.doc, self.lines, self.hash = doc[a], b - a + 1, code[one]
        self.line = a - np.searchsorted(doc, self.doc)
        self.start, self.end = start[a], end[b]


UNITS = "hash long, doc_id long, text_key long, line int, lines int"
OCCURRENCES = ("hash long, text binary, first_null boolean, first_doc long, first_key long, first_line int, "
               "members array<struct<doc_id:long,text_key:long,line:int,lines:int>>")
PLACES = "doc_id long, text_key long, line int, lines int, fate int"

_MEMBER = pa.struct([("doc_id", pa.int64()), ("text_key", pa.int64()), ("line", pa.int32()), ("lines", pa.int32())])
_OCCURRENCES = pa.schema([("hash", pa.int64()), ("text", pa.binary()), ("first_null", pa.bool_()), ("first_doc", pa.int64()),
                          ("first_key", pa.int64()), ("first_line", pa.int32()), ("members", pa.list_(_MEMBER))])
_PLACES = pa.schema([*_MEMBER, ("fate", pa.int32())])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in pieces(batch, limit=8 << 20):
            found = Chunks(rows.column("text"))
            of = pa.array(found.doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.hash.view(np.int64)), rows.column("doc_id").take(of), rows.column("text_key").take(of),
                 pa.array(found.line.astype(np.int32)), pa.array(found.lines.astype(np.int32))],
                names=["hash", "doc_id", "text_key", "line", "lines"])


def _place(doc: np.ndarray, line: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """One value per chunk of a batch, to look chunks up by."""
    out = np.empty(len(doc), [("doc", np.int64), ("line", np.int64), ("lines", np.int64)])
    out["doc"], out["line"], out["lines"] = doc, line, lines
    return out


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in pieces(batch, limit=8 << 20):
            found = Chunks(rows.column("text"))
            ids, keys = rows.column("doc_id").to_pylist(), rows.column("text_key").to_pylist()
            data = memoryview(np.ascontiguousarray(found.buf))
            chunks = rows.column("chunks")
            asked = chunks.flatten()
            of = np.repeat(np.arange(rows.num_rows), chunks.value_lengths().to_numpy())
            wanted = _place(of, asked.field("line").to_numpy(), asked.field("lines").to_numpy())
            use = np.flatnonzero(np.isin(_place(found.doc, found.line, found.lines), wanted))
            same: dict[tuple[int, bytes], list] = {}
            for i in use[np.argsort(found.hash[use], kind="stable")].tolist():
                text = bytes(data[found.start[i] : found.end[i]])
                d = int(found.doc[i])
                same.setdefault((int(found.hash[i]), text), []).append(
                    (ids[d] is None, ids[d], keys[d], int(found.line[i]), int(found.lines[i])))
            out = []
            for (h, text), members in same.items():
                first = min(members, key=lambda m: (m[0], m[1] or 0, m[2], m[3]))
                out.append({"hash": h - (1 << 64) if h >> 63 else h, "text": text, "first_null": first[0], "first_doc": first[1],
                            "first_key": first[2], "first_line": first[3],
                            "members": [{"doc_id": m[1], "text_key": m[2], "line": m[3], "lines": m[4]} for m in members]})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_OCCURRENCES)


#: what happens to a chunk, the later the stronger: it repeats its own text, it stays, it repeats another text
AGAIN, STAYS, GOES = range(3)


def _fate(place: tuple[int, int], owner: tuple[int, int]) -> int:
    return STAYS if place == owner else AGAIN if place[0] == owner[0] else GOES


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every member and its fate, from occurrences sorted by hash and first member."""
    current = None
    owners: dict[bytes, tuple[int, int]] = {}  # texts of the current hash
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in ("hash", "text", "first_key", "first_line", "members")}
            if row["hash"] != current:
                current, owners = row["hash"], {}
            owner = owners.setdefault(row["text"], (row["first_key"], row["first_line"]))
            out += [m | {"fate": _fate((m["text_key"], m["line"]), owner)} for m in row["members"]]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_PLACES)


def _met(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """Documents with the list ``chunks`` of their entries of ``places``, matched by doc_id and text."""
    entries = [c for c in places.columns if c not in ("doc_id", "text_key")]
    listed = (places.groupBy(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"))
              .agg(F.collect_set(F.struct(*entries)).alias("_chunks")))
    return docs.withColumn("_text_key", F.xxhash64("text")).join(
        listed, (F.col("_text_key") == F.col("_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")), how)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line, lines and fate of every chunk that stands in two places.

    Equal texts are one text here: what its chunks share with no other place is left to :func:`whole_copies`.
    """
    plain = _plain(docs)
    units = plain.mapInArrow(returned(_units), UNITS)
    place = F.xxhash64("text_key", "line")
    twice = units.groupBy("hash").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("hash")
    asked = units.join(twice, "hash", "left_semi").select("doc_id", "text_key", "line", "lines")
    seen = _met(plain, asked, "inner").select("doc_id", "text", "text_key", F.col("_chunks").alias("chunks")).mapInArrow(returned(_occurrences), OCCURRENCES)
    dealt = seen.repartition("hash").sortWithinPartitions("hash", "first_null", "first_doc", "first_key", "first_line")
    return dealt.mapInArrow(returned(_repeats), PLACES)


def whole_copies(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, digest and first of every text that several rows hold; ``first``: no other doc_id that holds it comes before."""
    rows = _plain(docs).select("doc_id", "text_key", F.unhex(F.sha2("text", 256)).alias("digest"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    texts = rows.groupBy("text_key", "digest").agg(F.count("*").alias("n"), F.min(place).alias("place")).where("n > 1")
    found = lookup(rows.select("doc_id", "text_key"), texts, ["text_key"], "n", spread=["doc_id", "text_key"])
    return found.select("doc_id", "text_key", "digest", F.col("doc_id").eqNullSafe(F.col("place.doc_id")).alias("first"))


def _without(text: str, chunks: list[dict]) -> tuple[str, int]:
    """The text without the lines of chunks that go, and how many went."""
    lines = text.split("\n")
    gone = np.zeros(len(lines), bool)
    for c in sorted(chunks, key=lambda c: c["fate"]):
        gone[c["line"] : c["line"] + c["lines"]] = c["fate"] != STAYS
    return "\n".join([x for x, y in zip(lines, gone.tolist(), strict=True) if not y]), int(gone.sum())


def _remove_task(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen = None, set()  # the digests of the rows of one doc_id and text_key, which come one after another
        for batch in batches:
            chunks = batch.column("_chunks")
            touched = np.flatnonzero(chunks.is_valid().to_numpy(zero_copy_only=False)).tolist()
            text = batch.column("text").to_pylist() if touched else None
            removed = np.zeros(batch.num_rows, np.int32)
            marks = batch.column("_copies") if "_copies" in batch.schema.names else None
            copies = []
            for i in touched:
                if marks is not None and len(marks[i]):
                    here = (batch.column("doc_id")[i].as_py(), batch.column("_text_key")[i].as_py())
                    if here != key:
                        key, seen = here, set()
                    digest = hashlib.sha256(text[i].encode()).digest()
                    first = {m["digest"]: m["first"] for m in marks[i].as_py()}.get(digest, True)
                    if not first or digest in seen:
                        copies.append(i)
                        continue
                    seen.add(digest)
                text[i], removed[i] = _without(text[i], chunks[i].as_py())
            for i, kept, n in _uncovered(copies, text):
                text[i], removed[i] = kept, n
            new = pa.array(text, pa.string()) if touched else batch.column("text")
            columns = [new if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed)], names=[*names, "removed"])

    return run


def _uncovered(at: list[int], texts: list[str]) -> Iterator[tuple[int, str, int]]:
    """The texts at these places without the lines of all their chunks, and how many went."""
    rows = pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([texts[i] for i in at], pa.string())], names=["at", "text"])
    for part in pieces(rows):
        found = Chunks(part.column("text"))
        ends = np.searchsorted(found.doc, np.arange(part.num_rows + 1))
        for k, i in enumerate(part.column("at").to_pylist()):
            of = slice(ends[k], ends[k + 1])
            yield i, *_without(texts[i], [{"line": a, "lines": n, "fate": GOES} for a, n in zip(found.line[of].tolist(), found.lines[of].tolist())])


def dedup(docs: DataFrame, copies: bool = False) -> DataFrame:
    """The rows of ``docs`` without repeated chunks in ``text``, and ``removed``: how many lines went.

    ``copies``: chunks of whole copies go too.
    """
    kept = docs.drop("removed")
    others = [c for c in kept.columns if c not in ("doc_id", "text")]
    # the caller's other columns travel as one, so that no name can clash
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(True)
    packed = kept.select("doc_id", "text", rest.alias("rest"))
    met = _met_all(packed) if copies else _met(packed, repeats(packed), "left")
    schema = T.StructType([*packed.schema.fields, T.StructField("removed", T.IntegerType())])
    entries = ["_chunks", "_copies", "_text_key"] if copies else ["_chunks"]
    found = met.select(*packed.columns, *entries).mapInArrow(returned(_remove_task(packed.columns)), schema)
    return found.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in kept.columns], "removed")


def _met_all(docs: DataFrame) -> DataFrame:
    """Documents with ``_chunks`` as :func:`_met` and the list ``_copies`` of their entries of :func:`whole_copies`.

    Rows of one doc_id and text come one after another, in one task: only there one of them can be the first.
    """
    places, marks = repeats(docs), whole_copies(docs)
    entry = lambda df, names: F.struct(*[df[c] for c in names])
    kinds = (["line", "lines", "fate"], ["digest", "first"])
    each = places.select("doc_id", "text_key", entry(places, kinds[0]).alias("chunk")).unionByName(
        marks.select("doc_id", "text_key", entry(marks, kinds[1]).alias("copy")), allowMissingColumns=True)
    id_ = F.col("doc_id").cast("long")
    key = {"_none": id_.isNull(), "_doc": F.coalesce(id_, F.lit(0))}
    listed = (each.select(F.col("text_key").alias("_text_key"), *[v.alias(k) for k, v in key.items()], "chunk", "copy")
              .groupBy("_text_key", *key).agg(F.collect_set("chunk").alias("_chunks"), F.collect_set("copy").alias("_copies")))
    order = ["_text_key", *key]
    rows = docs.withColumns({"_text_key": F.xxhash64("text"), **key}).repartition(*order)  # never dealt out anew as a skewed join
    ties = [F.to_json(F.struct("rest"))] if isinstance(docs.schema["rest"].dataType, T.StructType) else []
    return rows.hint("merge").join(listed, order, "left").sortWithinPartitions(*order, *ties)
