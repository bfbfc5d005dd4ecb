"""Linear-chain CRF over sequences of any length, for any number of tags: partition, decoding and gradient.

A sequence is rows of one position each, counted from 0. Rows are cut into *buckets* of neighbouring positions, and a
bucket is worked off inside one task as padded arrays, many buckets at a time. What crosses bucket borders is a scan of
transfer matrices: a bucket's matrix holds, for every tag before it and every tag at its end, the summed (log semiring)
or best (max-plus) score of all paths between; a sequence's first bucket is a single row of it. Matrices are multiplied
``2 ** FAN`` at a time, level by level, until one is left per sequence; on the way down every bucket gets the scores that
enter it. So a sequence of all rows spreads over all tasks, and short sequences never leave their first bucket.

A matrix travels as one row per tag: a task holds ``2 ** FAN`` matrices of K x K numbers at most, never a sequence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import log_sum_exp
from ..session import stored
from .crf import CrfParams, _plus, _row
from .ordered import neighbours

BITS, FAN = 7, 5
#: doubles of one padded array
CHUNK = 1 << 22
#: beyond this spread of scores, exp would lose paths that count
SPREAD = 600.0
B, FIRST, TAG, V = "__b", "__first", "__i", "__v"

Combine = Callable[[np.ndarray, np.ndarray], np.ndarray]


# ---- arithmetic ------------------------------------------------------------------------------------


def _finite(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, 0.0)


def _spread(x: np.ndarray) -> float:
    low = x.min()
    return float(-low) if np.isfinite(low) else float(-x[np.isfinite(x)].min(initial=0.0))


def log_times(a: np.ndarray, m: np.ndarray) -> np.ndarray:
    """``out[r, j] = log sum_k exp(a[r, k] + m[k, j])``, as one matrix product where no path can be lost by it."""
    with np.errstate(divide="ignore"):
        top, high = _finite(a.max(1, keepdims=True)), _finite(m.max(0))
        low_a, low_m = a - top, m - high
        if _spread(low_a) + _spread(low_m) < SPREAD:
            return np.log(np.exp(low_a) @ np.exp(low_m)) + top + high
        out = np.full((len(a), m.shape[1]), -np.inf)
        for k in range(m.shape[0]):
            out = np.logaddexp(out, a[:, k : k + 1] + m[k])
        return out


def max_times(a: np.ndarray, m: np.ndarray) -> np.ndarray:
    """``out[r, j] = max_k(a[r, k] + m[k, j])``."""
    out = a[:, :1] + m[0]
    for k in range(1, m.shape[0]):
        np.maximum(out, a[:, k : k + 1] + m[k], out=out)
    return out


def _best_before(a: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``max_times``, with the lowest k that is best."""
    out, at = a[:, :1] + m[0], np.zeros((len(a), m.shape[1]), np.int16)
    for k in range(1, m.shape[0]):
        here = a[:, k : k + 1] + m[k]
        better = here > out
        out[better], at[better] = here[better], k
    return out, at


class _Params:
    def __init__(self, params: CrfParams):
        self.t, self.start, self.stop = np.array(params.transitions), np.array(params.start), np.array(params.stop)
        self.k = params.size


# ---- groups of a sorted partition ------------------------------------------------------------------


def _borders(batch: pa.RecordBatch, by: Sequence[str]) -> np.ndarray:
    """Where groups of equal neighbours begin."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for name in by:
        x = batch.column(name)
        a, b = x.slice(1), x.slice(0, len(x) - 1)
        unequal = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        nulls = pc.is_null(x).to_numpy(zero_copy_only=False)
        new[1:] |= unequal | (nulls[1:] != nulls[:-1])
    return np.flatnonzero(new)


def _whole_groups(batches: Iterator[pa.RecordBatch], by: Sequence[str], most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups, and where each group begins (one more entry at the end). A group has ``most`` rows at most."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        begin = _borders(batch, by)
        if np.diff(np.append(begin, batch.num_rows)).max() > most:
            raise ValueError("positions of a sequence repeat")
        if begin[-1]:
            yield batch.slice(0, begin[-1]), begin
        held = batch.slice(begin[-1])
    if held is not None:
        yield held, np.array([0, held.num_rows])


def _matrix(lists: pa.Array, k: int) -> np.ndarray:
    """Rows of k numbers; anything else raises."""
    size = np.diff(lists.offsets.to_numpy())
    if lists.null_count or (size != k).any():
        raise ValueError(f"emissions must have {k} scores per position")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] if rows.ndim == 2 else 0), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows, np.float64).reshape(-1)))


def _rows(batch: pa.RecordBatch, at: np.ndarray, keys: Sequence[str], columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The keys of rows ``at`` beside new columns."""
    at = pa.array(at)
    return pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in keys], *columns.values()], names=[*keys, *columns])


class _Buckets:
    """Buckets of a batch as padded arrays, longest first, in chunks of bounded size."""

    def __init__(self, batch: pa.RecordBatch, begin: np.ndarray, p: _Params, per_bucket: int):
        """A border row (position -1) holds the scores that enter its bucket."""
        self.pos = batch.column("__p").to_numpy()
        self.x = _matrix(batch.column("__x"), p.k)
        border = self.pos[begin[:-1]] < 0
        self.entry = np.where(border, begin[:-1], -1)
        self.begin, self.size = begin[:-1] + border, np.diff(begin) - border
        self.first = self.pos[np.minimum(self.begin, len(self.pos) - 1)] == 0
        # a bucket that holds nothing but its border, or enters from nowhere without being first, is a broken sequence
        self.per, self.k = per_bucket, p.k

    def chunks(self, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
        """(buckets, emissions by position x bucket x tag, buckets that reach each position)."""
        which = which[np.argsort(-self.size[which], kind="stable")]
        while len(which):
            longest = int(self.size[which[0]])
            some, which = np.split(which, [max(1, CHUNK // max(longest * self.k, self.per))])
            size = self.size[some]
            x = np.zeros((longest, len(some), self.k))
            reach = []
            for t in range(longest):
                n = int((size > t).sum())
                x[t, :n] = self.x[self.begin[some[:n]] + t]
                reach.append(n)
            yield some, x, reach


# ---- the scan over levels --------------------------------------------------------------------------


def _product_task(keys: Sequence[str], times: Combine, k: int):
    """A parent's matrix (or first row) from its children's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, begin in _whole_groups(batches, [*keys, "__up"], (k << FAN) + 1):
            v, first, b = _matrix(batch.column(V), k), batch.column(FIRST).to_numpy(zero_copy_only=False), batch.column(B).to_numpy()
            at, done, starts = [], [], []
            for low, high in zip(begin[:-1].tolist(), begin[1:].tolist()):
                total = None
                for m in np.split(v[low:high], np.flatnonzero(np.diff(b[low:high])) + 1):
                    total = m if total is None else times(total, m)
                at += [low] * len(total)
                starts += [bool(first[low])] * len(total)
                done.append(total)
            n = np.concatenate([np.arange(len(x)) for x in done])
            yield _rows(batch, np.array(at), keys, {B: batch.column("__up").take(pa.array(at)), FIRST: pa.array(starts),
                                                    TAG: pa.array(n, pa.int32()), V: _lists(np.concatenate(done))})

    return run


def _carry_task(keys: Sequence[str], carry: Combine, k: int, width: int, backward: bool):
    """What enters every child, from what enters the parent (``backward``: from its end): border rows come before the children."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, begin in _whole_groups(batches, [*keys, "__up"], (k << FAN) + 1):
            kind, b = batch.column("__kind").to_numpy(), batch.column(B).to_numpy()
            lists, first = batch.column(V), batch.column(FIRST).to_numpy(zero_copy_only=False)
            flat, off = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            at, out = [], []
            for low, high in zip(begin[:-1].tolist(), begin[1:].tolist()):
                now = flat[off[low] : off[low + 1]] if kind[low] == 0 else None
                low += kind[low] == 0
                cuts = [low, *(np.flatnonzero(np.diff(b[low:high])) + 1 + low).tolist(), high] if high > low else []
                children = list(zip(cuts[:-1], cuts[1:]))
                for c, d in reversed(children) if backward else children:
                    if now is not None:
                        at.append(c)
                        out.append(now)
                    m = flat[off[c] : off[d]].reshape(d - c, -1)
                    if first[c]:
                        now = None if backward else m[0]
                    elif now is not None:
                        now = carry(now, m)
            if at:
                yield _rows(batch, np.array(at), keys, {B: batch.column(B).take(pa.array(at)), V: _lists(np.array(out).reshape(len(out), width))})

    return run


class _Scan:
    """Matrices of all levels, and what enters every bucket."""

    def __init__(self, level: DataFrame, keys: Sequence[str], times: Combine, k: int):
        self.keys, self.k = list(keys), k
        self.types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in level.select(*keys).schema.fields)
        self.levels = [stored(level, "crf-level")]
        highest = self.levels[0].agg(F.max(B).alias("m")).head()["m"] or 0
        while highest:
            highest >>= FAN
            made = self._grouped(self.levels[-1], [B, TAG]).mapInArrow(_product_task(self.keys, times, k), f"{self.types}, {B} long, {FIRST} boolean, {TAG} int, {V} array<double>")
            self.levels.append(stored(made, "crf-level"))

    def _grouped(self, rows: DataFrame, order: Sequence[str]) -> DataFrame:
        rows = rows if "__up" in rows.columns else rows.withColumn("__up", F.shiftright(B, FAN))
        return rows.repartition(*self.keys, "__up").sortWithinPartitions(*self.keys, "__up", *order)

    def totals(self) -> DataFrame:
        """(keys, V): the scores of all tags at the end of every sequence."""
        start = F.when(F.col(FIRST), F.col(V)).otherwise(F.raise_error(F.lit("a sequence has no position 0")).cast("array<double>"))
        return self.levels[-1].select(*self.keys, start.alias(V))

    def entering(self, carry: Combine, ends: DataFrame | None = None, backward: bool = False, width: int | None = None) -> DataFrame:
        """(keys, B, V): what enters every bucket but the first, or, ``backward`` from ``ends`` (keys, V), the end of every bucket."""
        width = width or self.k
        enters = ends.withColumn(B, F.lit(0).cast("long")) if ends is not None else None
        for level in reversed(self.levels[:-1]):
            rows = level.withColumns({"__kind": F.lit(1), "__up": F.shiftright(B, FAN)})
            if enters is not None:
                rows = rows.unionByName(enters.select(
                    *self.keys, F.lit(-1).cast("long").alias(B), F.lit(False).alias(FIRST), V, F.lit(0).alias("__kind"), F.col(B).alias("__up")),
                    allowMissingColumns=True)
            enters = self._grouped(rows, ["__kind", B, TAG]).mapInArrow(
                _carry_task(self.keys, carry, self.k, width, backward), f"{self.types}, {B} long, {V} array<double>")
        if enters is None:
            return self.levels[0].select(*self.keys, B, V).where("false")
        return enters


def _cut(df: DataFrame, keys: Sequence[str], pos: str, emissions: str, bits: int, extra: Sequence[Column] = ()) -> DataFrame:
    place = F.when(F.col(pos) >= 0, F.col(pos)).otherwise(F.raise_error(F.lit("positions count from 0"))).cast("long")
    return df.select(*keys, F.shiftright(place, bits).alias(B), place.alias("__p"), F.col(emissions).cast("array<double>").alias("__x"), *extra)


def _by_bucket(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.repartition(*keys, B).sortWithinPartitions(*keys, B, "__p")


def _with_border(rows: DataFrame, keys: Sequence[str], border: DataFrame) -> DataFrame:
    """Rows and, before them in their bucket, its border row."""
    return rows.unionByName(border.withColumn("__p", F.lit(-1).cast("long")), allowMissingColumns=True)


def _gathered(keys: Sequence[str], *parts: DataFrame) -> DataFrame:
    """One row per bucket from narrow tables of one fact each; keys may be null."""
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part, allowMissingColumns=True)
    facts = [c for c in table.columns if c not in (*keys, B)]
    return table.groupBy(*keys, B).agg(*[F.max(c).alias(c) for c in facts])


def _matrices_task(keys: Sequence[str], params: CrfParams, times: Combine, bits: int):
    """Every bucket's transfer matrix, and of the first bucket its one row."""
    p = _Params(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, begin in _whole_groups(batches, [*keys, B], 1 << bits):
            buckets = _Buckets(batch, begin, p, p.k * p.k)
            for first in (True, False):
                rows = 1 if first else p.k
                for some, x, reach in buckets.chunks(np.flatnonzero(buckets.first == first)):
                    v = (p.start + x[0])[:, None, :] if first else p.t + x[0][:, None, :]
                    for t in range(1, len(x)):
                        n = reach[t]
                        v[:n] = times(v[:n].reshape(n * rows, p.k), p.t).reshape(n, rows, p.k) + x[t, :n, None, :]
                    at = np.repeat(buckets.begin[some], rows)
                    yield _rows(batch, at, keys, {
                        B: batch.column(B).take(pa.array(at)), FIRST: pa.array(np.full(len(at), first)),
                        TAG: pa.array(np.tile(np.arange(rows), len(some)), pa.int32()), V: _lists(v.reshape(-1, p.k))})

    return run


def _types(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)


def _scan(rows: DataFrame, keys: Sequence[str], params: CrfParams, times: Combine, bits: int) -> _Scan:
    level = _by_bucket(rows, keys).mapInArrow(_matrices_task(keys, params, times, bits), f"{_types(rows, keys)}, {B} long, {FIRST} boolean, {TAG} int, {V} array<double>")
    return _Scan(level, keys, times, params.size)


# ---- operators -------------------------------------------------------------------------------------


def log_partition(df: DataFrame, params: CrfParams, keys: Sequence[str], pos: str = "pos", emissions: str = "vec", bits: int = BITS) -> DataFrame:
    """``(*keys, log_z)``: log of the summed scores of all tag paths of every sequence, from rows of one position."""
    ends = _scan(_cut(df, keys, pos, emissions, bits), keys, params, log_times, bits).totals()
    return ends.select(*keys, log_sum_exp(_plus(F.col(V), _row(params.stop))).alias("log_z"))


def _back_task(keys: Sequence[str], params: CrfParams, bits: int, decode: bool):
    """With the scores that enter: every bucket's map from the tag at its end to the best tag before it; with the tag at its
    end as well (``decode``): the tag of every position."""
    p = _Params(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, begin in _whole_groups(batches, [*keys, B], (1 << bits) + 1):
            buckets = _Buckets(batch, begin, p, 0)
            exit = batch.column("__exit").to_numpy(zero_copy_only=False) if decode else None
            every = np.arange(len(buckets.begin)) if decode else np.flatnonzero(~buckets.first)
            for some, x, reach in buckets.chunks(every):
                back = np.zeros((len(x), len(some), p.k), np.int16)
                first = buckets.first[some]
                v = p.start + x[0]
                if not first.all():
                    score, at = _best_before(buckets.x[buckets.entry[some[~first]]], p.t)
                    v[~first], back[0, ~first] = score + x[0][~first], at
                for t in range(1, len(x)):
                    n = reach[t]
                    score, back[t, :n] = _best_before(v[:n], p.t)
                    v[:n] = score + x[t, :n]
                if decode:
                    size = buckets.size[some]
                    tag = exit[buckets.entry[some]].astype(np.int64)
                    found = np.zeros((len(x), len(some)), np.int32)
                    for t in range(len(x) - 1, -1, -1):
                        n = reach[t]
                        found[t, :n] = tag[:n]
                        tag[:n] = back[t, np.arange(n), tag[:n]]
                    at = np.concatenate([np.arange(b, b + n) for b, n in zip(buckets.begin[some], size)])
                    tags = np.concatenate([found[:n, i] for i, n in enumerate(size)])
                    yield _rows(batch, at, keys, {"__p": batch.column("__p").take(pa.array(at)), "tag": pa.array(tags, pa.int32())})
                else:
                    to = np.tile(np.arange(p.k), (len(some), 1))
                    for t in range(len(x) - 1, -1, -1):
                        n = reach[t]
                        to[:n] = np.take_along_axis(back[t, :n], to[:n], 1)
                    at = buckets.begin[some]
                    yield _rows(batch, at, keys, {B: batch.column(B).take(pa.array(at)), FIRST: pa.array(np.zeros(len(at), bool)),
                                                  TAG: pa.array(np.zeros(len(at)), pa.int32()), V: _lists(to)})

    return run


def _follow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Maps of tags one after the other: the later bucket's first, then the earlier one's."""
    return a[:, b[0].astype(np.int64)]


def viterbi(df: DataFrame, params: CrfParams, keys: Sequence[str], pos: str = "pos", emissions: str = "vec", bits: int = BITS) -> DataFrame:
    """``(*keys, pos, tag)``: the best tag path of every sequence, from rows of one position; the lower tag on ties.

    Two scans: best scores forward (max-plus matrices), then, with the scores that enter every bucket, the buckets' maps
    from their last tag to the tag before them, backward from the best last tag of the sequence.
    """
    rows = stored(_cut(df, keys, pos, emissions, bits), "crf-rows")
    scan = _scan(rows, keys, params, max_times, bits)
    enters = stored(scan.entering(lambda v, m: max_times(v[None], m)[0]), "crf-enter")
    end = _plus(F.col(V), _row(params.stop))
    last = scan.totals().select(*keys, F.array((F.array_position(end, F.array_max(end)) - 1).cast("double")).alias(V))
    types = _types(rows, keys)
    maps = _by_bucket(_with_border(rows, keys, enters.select(*keys, B, F.col(V).alias("__x"))), keys).mapInArrow(
        _back_task(keys, params, bits, False), f"{types}, {B} long, {FIRST} boolean, {TAG} int, {V} array<double>")
    # the first bucket maps to nothing before it; it ends the backward scan
    starts = scan.levels[0].where(FIRST).select(*keys, B, FIRST, TAG, F.array_repeat(F.lit(0.0), params.size).alias(V))
    back = _Scan(maps.unionByName(starts), keys, _follow, params.size)
    exits = back.entering(lambda tag, m: m[0][tag.astype(np.int64)], last, True, 1)
    nothing = F.array_repeat(F.lit(0.0), params.size)  # what enters a first bucket is not read
    border = _gathered(keys, enters.select(*keys, B, F.col(V).alias("__x")), exits.select(*keys, B, F.element_at(V, 1).cast("int").alias("__exit")))
    placed = _with_border(rows, keys, border.withColumn("__x", F.coalesce("__x", nothing)))
    found = _by_bucket(placed, keys).mapInArrow(_back_task(keys, params, bits, True), f"{types}, __p long, tag int")
    return found.select(*keys, F.col("__p").alias(pos), "tag")


def _gradient_task(keys: Sequence[str], params: CrfParams, bits: int):
    """Observed less expected counts of all buckets of a task: a border row has what enters (``__x``), the backward scores at
    the bucket's end (``__beta``), the tag before it (``__tag``) and whether it is the sequence's last (``__last``)."""
    p = _Params(params)
    k, weight = p.k, np.exp(p.t)
    steep = float(p.t.max() - p.t.min()) > SPREAD

    def pairs(before: np.ndarray, after: np.ndarray, log_z: np.ndarray) -> np.ndarray:
        """Expected transitions from scores before and scores after, summed over buckets."""
        if steep:
            return sum((np.exp(a[:, None] + p.t + b - z) for a, b, z in zip(before, after, log_z)), np.zeros((k, k)))
        top, high = before.max(1, keepdims=True), after.max(1, keepdims=True)
        return weight * (np.exp(before - top).T @ (np.exp(after - high) * np.exp(top + high - log_z[:, None])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d_t, d_start, d_stop, score, count = np.zeros((k, k)), np.zeros(k), np.zeros(k), 0.0, 0
        for batch, begin in _whole_groups(batches, [*keys, B], (1 << bits) + 1):
            buckets = _Buckets(batch, begin, p, 0)
            tags = batch.column("__tag").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            if ((tags[buckets.pos >= 0] < 0) | (tags[buckets.pos >= 0] >= k)).any():
                raise ValueError(f"a tag is not 0 to {k - 1}")
            last = batch.column("__last").fill_null(False).to_numpy(zero_copy_only=False)
            borders = batch.take(pa.array(buckets.entry))
            ends = _matrix(borders.column("__beta"), k)
            for some, x, reach in buckets.chunks(np.arange(len(buckets.begin))):
                at, size, first = buckets.begin[some], buckets.size[some], buckets.first[some]
                enter = buckets.x[buckets.entry[some]]
                alpha, after = np.empty_like(x), np.empty_like(x)  # after: emission and backward score
                alpha[0] = np.where(first[:, None], p.start, log_times(enter, p.t)) + x[0]
                for t in range(1, len(x)):
                    alpha[t, : reach[t]] = log_times(alpha[t - 1, : reach[t]], p.t) + x[t, : reach[t]]
                beta = ends[some].copy()
                for t in range(len(x) - 1, -1, -1):
                    n, more = reach[t], reach[t + 1] if t + 1 < len(x) else 0
                    if more:
                        beta[:more] = log_times(after[t + 1, :more], p.t.T)
                    after[t, :n] = x[t, :n] + beta[:n]
                whole = alpha[0] + after[0] - x[0]
                log_z = np.logaddexp.reduce(whole, 1)
                d_t -= pairs(enter[~first], after[0, ~first], log_z[~first])
                for t in range(1, len(x)):
                    d_t -= pairs(alpha[t - 1, : reach[t]], after[t, : reach[t]], log_z[: reach[t]])
                d_start -= np.exp(whole[first] - log_z[first, None]).sum(0)
                ending = last[buckets.entry[some]]
                final = alpha[size - 1, np.arange(len(some))]
                d_stop -= np.exp(final[ending] + p.stop - log_z[ending, None]).sum(0)
                here = np.concatenate([np.arange(a, a + n) for a, n in zip(at, size)])
                # the row before a position is its predecessor or its bucket's border, which has the tag before the bucket
                step = here[~np.isin(here, at[first])]
                np.add.at(d_t, (tags[step - 1], tags[step]), 1)
                np.add.at(d_start, tags[at[first]], 1)
                np.add.at(d_stop, tags[(at + size - 1)[ending]], 1)
                score += buckets.x[here, tags[here]].sum() + p.t[tags[step - 1], tags[step]].sum()
                score += p.start[tags[at[first]]].sum() + p.stop[tags[(at + size - 1)[ending]]].sum() - log_z[first].sum()
                count += int(first.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array([*range(k * k + 2 * k), -1, -2], pa.int32()), pa.array(np.concatenate([d_t.ravel(), d_start, d_stop, [score, count]]))],
            names=["slot", "value"])

    return run


def gradient(df: DataFrame, params: CrfParams, keys: Sequence[str], pos: str = "pos", emissions: str = "vec", tag: str = "tag",
             bits: int = BITS) -> DataFrame:
    """``(slot, value)`` as :func:`crf.gradient` gives it, from rows of one position with their tags.

    The forward scores enter every bucket from the left and the backward scores from the right, over the same matrices.
    Positions to be ignored are left out, and the others numbered from 0, by the caller.
    """
    rows = stored(_cut(df, keys, pos, emissions, bits, [F.col(tag).cast("int").alias("__tag")]), "crf-rows")
    scan = _scan(rows, keys, params, log_times, bits)
    stop = scan.totals().select(*keys, _row(params.stop).alias(V))
    alpha = scan.entering(lambda v, m: log_times(v[None], m)[0])
    beta = scan.entering(lambda v, m: log_times(v[None], m.T)[0], stop, True)
    last_tags = rows.groupBy(*keys, B).agg(F.max_by("__tag", "__p").alias("__tag"))
    before = neighbours(last_tags, ["__tag"], [B], keys).select(*keys, B, F.col("__prev.__tag").alias("__tag"))
    last = scan.levels[0].groupBy(*keys).agg(F.max(B).alias(B)).withColumn("__last", F.lit(True))
    border = _gathered(keys, alpha.select(*keys, B, F.col(V).alias("__x")), beta.select(*keys, B, F.col(V).alias("__beta")), before, last)
    placed = _with_border(rows, keys, border.withColumn("__x", F.coalesce("__x", F.array_repeat(F.lit(0.0), params.size))))
    return (_by_bucket(placed, keys).mapInArrow(_gradient_task(keys, params, bits), "slot int, value double")
            .groupBy("slot").agg(F.sum("value").alias("value")))
