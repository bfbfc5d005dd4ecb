"""Texts of an Arrow batch as byte arrays: words, their hashes and n-grams, all in numpy.

Words are runs of bytes outside 0x20 and 0x09-0x0D; ``lower`` folds A-Z only. A word's hash is a polynomial over
random byte values modulo 2^64, mixed; it is computed from prefix sums, so the cost per byte does not depend on the
word. Long texts are read in segments cut at white space: only the word arrays grow with a text.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
U64 = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


POWER = _powers(SEGMENT + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U64(32))
        h = h * U64(0xD6E8FEB86659FD93)
        h = h ^ (h >> U64(32))
        h = h * U64(0xD6E8FEB86659FD93)
        return h ^ (h >> U64(32))


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


#: what a Python process keeps for the next task of the same kind
held: dict[tuple, object] = {}


def returned(task: Task, keeps: bool = False) -> Task:
    """A task that gives the memory it has freed back to the system when it ends: its Python process serves later tasks too.

    Unless it ``keeps`` what tasks of its kind have held, that goes when the task begins.
    """
    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            held.clear()
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


class Words(NamedTuple):
    """One entry per word: hash, index of its text, first byte and the byte after its last."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and where each begins (one more entry at the end). Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 8 << 20, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with about ``limit`` bytes of text each (a longer text is a run of its own), and at most ``rows`` rows."""
    n = batch.num_rows
    if n == 0:
        return
    _, off = bytes_of(batch.column(column))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        to = to if rows is None else min(to, at + rows)
        yield batch.slice(at, to - at)
        at = to


def _cuts(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of at most SEGMENT bytes that end at a text's end or at white space; a longer word stays whole."""
    at, n = 0, len(buf)
    while at < n:
        to = min(n, at + SEGMENT)
        if to < n:
            ends = int(off[np.searchsorted(off, to, "right") - 1])
            if ends > at:
                to = ends
            else:
                spaces = np.flatnonzero(IS_SPACE[buf[at:to]])
                if len(spaces):
                    to = at + int(spaces[-1]) + 1
                else:
                    stop = int(off[np.searchsorted(off, at, "right")])
                    later = np.flatnonzero(IS_SPACE[buf[to:stop]])
                    to = to + int(later[0]) if len(later) else stop
        yield at, to
        at = to


def _segment(buf, starts_at, at, to, lower):
    part = buf[at:to]
    if lower:
        part = LOWER[part]
    solid = ~IS_SPACE[part]
    edge = np.zeros(to - at + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = ~solid[:-1]
    edge[starts_at - at] = True
    start = np.flatnonzero(solid & edge[:-1])
    last = solid.copy()
    last[:-1] &= edge[1:-1] | ~solid[1:]
    end = np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        power = POWER if to - at <= SEGMENT else _powers(to - at + 1)
        total = np.empty(to - at + 1, np.uint64)
        total[0] = 0
        np.cumsum(BYTE_VALUE[part] * power[: to - at], out=total[1:])
        if to - at <= SEGMENT:
            h = (total[end] - total[start]) * POWER[SEGMENT - start]
        else:  # a word longer than a segment: one word from the range's start
            h = (total[end] - total[start]) * POWER[SEGMENT]
    return h, start + at, end + at


def words(buf: np.ndarray, off: np.ndarray, lower: bool = True) -> Words:
    """All words of the texts, in order."""
    hashes, starts, ends = [], [], []
    for at, to in _cuts(buf, off):
        inside = off[np.searchsorted(off, at) : np.searchsorted(off, to)]
        h, s, e = _segment(buf, inside, at, to, lower)
        hashes.append(h)
        starts.append(s)
        ends.append(e)
    if not hashes:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, none)
    start = np.concatenate(starts)
    doc = np.searchsorted(off, start, "right") - 1
    return Words(mix(np.concatenate(hashes)), doc, start, np.concatenate(ends))


def string_hashes(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One hash per string of ``bytes_of``."""
    return span_hashes(buf, off[:-1], off[1:])


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One hash per span of bytes; starts and ends ascend. Equal bytes have equal hashes wherever they lie."""
    out = np.zeros(len(start), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(out):
            base = int(start[at])
            to = max(at + 1, int(np.searchsorted(end, base + SEGMENT, "right")))
            part = BYTE_VALUE[buf[base : end[to - 1]]]
            if len(part) <= SEGMENT:
                total = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(part * POWER[: len(part)], out=total[1:])
                out[at:to] = (total[end[at:to] - base] - total[start[at:to] - base]) * POWER[SEGMENT - (start[at:to] - base)]
            else:
                out[at] = np.sum(part * _powers(len(part)), dtype=np.uint64) * POWER[SEGMENT]
            at = to
    return mix(out)


def ngrams(hashes: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n neighbouring entries of one group, and the position of the first of each."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(group[: len(group) - n + 1] == group[n - 1 :])
    with np.errstate(over="ignore"):
        out = hashes[at]
        for k in range(1, n):
            out = out * U64(0xFF51AFD7ED558CCD) + hashes[at + k]
    return mix(out), at


def counts(group: np.ndarray, n: int) -> np.ndarray:
    """Entries per group, for groups 0 to n-1."""
    return np.bincount(group, minlength=n).astype(np.int64)


def ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions of runs: for each run its entries ``start .. start + length - 1``, one run after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)
