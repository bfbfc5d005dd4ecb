"""Packing by balanced attention cost.

A piece of n tokens costs ``n + quadratic * n^2``: its share of the linear layers and of attention inside the piece.
Documents longer than a sequence are cut into full sequences and a rest. Each task gathers pieces up to
``group_tokens``, opens as many sequences as the group fills, and takes the pieces in descending cost: each goes to
the sequence of the lowest cost that has room for it. Pieces that fit nowhere are cut over the room that is left, so
every sequence of a group is full; what is over goes on to the next group. Only a task's last tokens make short
sequences: they are laid out in lengths that are powers of two, which need no padding.

No shuffle and no state beyond one group: the scan's own partitions are the unit, and a lost task packs the same
sequences again. Sequence ids hold the partition in the upper bits.

Cases: a null text is an empty one, an empty text has the end id alone, a null ``doc_id`` stays null, equal rows are
packed one by one (ties keep the input's order), an empty table gives no row, and other columns are ignored. A text
of any length is cut as it comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import pieces, returned
from .tokens import encoder

LENGTH = 2048
GROUP_TOKENS = 1 << 20
#: bytes of text that are encoded at once, and of pieces that the encoder keeps: this stage runs where others have left memory
RUN, KEPT = 1 << 20, 24 << 20
#: weight of n^2 beside n: attention reaches the linear cost at a whole sequence
QUADRATIC = 1 / LENGTH

PIECES = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def balance(sizes: np.ndarray, length: int, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Fill ``sum(sizes) // length`` sequences. Sizes are at most ``length``.

    Returns placements (piece, first token, tokens, sequence, offset) and what is over (piece, first token, tokens).
    """
    n_seq = int(sizes.sum()) // length
    placed: list[tuple[int, int, int, int, int]] = []
    over: list[tuple[int, int, int]] = []
    if n_seq == 0:
        return placed, [(i, 0, int(n)) for i, n in enumerate(sizes) if n]
    load, free = np.zeros(n_seq), np.full(n_seq, length)
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        open_cost = np.where(free >= n, load, np.inf)
        s = int(open_cost.argmin())
        if open_cost[s] == np.inf:
            over.append((i, 0, n))
            continue
        placed.append((i, 0, n, s, length - int(free[s])))
        load[s] += n + quadratic * n * n
        free[s] -= n
    rooms = [s for s in np.argsort(load, kind="stable").tolist() if free[s]]
    rest: list[tuple[int, int, int]] = []
    for i, at, n in over:
        while n and rooms:
            s = rooms[0]
            take = min(n, int(free[s]))
            placed.append((i, at, take, s, length - int(free[s])))
            free[s] -= take
            at, n = at + take, n - take
            if not free[s]:
                rooms.pop(0)
        if n:
            rest.append((i, at, n))
    return placed, rest


def _pack_task(path: str, spaceless: bool, end_id: int, length: int, group_tokens: int, quadratic: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, spaceless, KEPT)
        base = TaskContext.get().partitionId() << 32
        n_seq = 0
        held: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        n_held = 0
        out: list[tuple] = []

        def put(piece, at, n, sequence, offset):
            doc, start, ids, total = piece
            out.append((doc, start + at, n, total, base + sequence, offset, ids[at : at + n].tobytes()))

        def rows() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SCHEMA, strict=True)], schema=SCHEMA)

        def flush() -> None:
            nonlocal held, n_held, n_seq
            placed, rest = balance(np.array([len(x[2]) for x in held], np.int64), length, quadratic)
            for i, at, n, s, offset in placed:
                put(held[i], at, n, n_seq + s, offset)
            n_seq += 1 + max((p[3] for p in placed), default=-1)
            held = [(held[i][0], held[i][1] + at, held[i][2][at : at + n].copy(), held[i][3]) for i, at, n in rest]
            n_held = sum(len(x[2]) for x in held)

        for batch in batches:
            for part in pieces(batch, limit=RUN):
                ids, per = coder.encode_ended(part.column("text"), end_id)
                stop = np.cumsum(per)
                for doc, b, n in zip(part.column("doc_id").to_pylist(), stop.tolist(), per.tolist(), strict=True):
                    at, a = 0, b - n
                    while n - at >= length:
                        put((doc, at, ids[a + at : a + at + length], n), 0, length, n_seq, 0)
                        n_seq, at = n_seq + 1, at + length
                    if n - at:
                        held.append((doc, at, ids[a + at : b], n))
                        n_held += n - at
                        if n_held >= group_tokens:
                            flush()
                    if len(out) >= 2000:
                        yield rows()
                held = [(d, s, x.copy(), t) for d, s, x, t in held]  # let the batch go
        if held:
            flush()
        piece, left = 0, n_held
        at = 0
        while left:  # the last tokens: sequences of 1024, 512, ... tokens
            size, offset = 1 << (left.bit_length() - 1), 0
            left -= size
            while offset < size:
                take = min(size - offset, len(held[piece][2]) - at)
                put(held[piece], at, take, n_seq, offset)
                offset, at = offset + take, at + take
                if at == len(held[piece][2]):
                    piece, at = piece + 1, 0
            n_seq += 1
        if out:
            yield rows()

    return returned(run, keeps=True)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def pack(docs: DataFrame, tokenizer: str, end_id: int, *, spaceless: bool = False, length: int = LENGTH,
         group_tokens: int = GROUP_TOKENS, quadratic: float = QUADRATIC) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    if length < 1 or length & (length - 1):
        raise ValueError("the length of a sequence is a power of two")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_pack_task(tokenizer, spaceless, end_id, length, group_tokens, quadratic), PIECES)
