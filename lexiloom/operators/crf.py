"""Linear-chain CRF: sequence score, log partition, likelihood, decoding and fitting.

A sequence is one row with ``emissions array<array<double>>`` (position, tag). Rows are independent, so
scoring, partition and decoding run in place, without a shuffle. Sequences come from blocks of bounded length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import bind, log_sum_exp, total
from .ordered import neighbours


IGNORED = -100


@dataclass(frozen=True)
class CrfParams:
    """Transition scores (from, to), start scores and stop scores: K*K + 2K numbers, sent as literals."""

    transitions: tuple[tuple[float, ...], ...]
    start: tuple[float, ...]
    stop: tuple[float, ...]

    @staticmethod
    def of(transitions, start, stop) -> CrfParams:
        table = tuple(tuple(float(x) for x in row) for row in transitions)
        params = CrfParams(table, tuple(float(x) for x in start), tuple(float(x) for x in stop))
        if any(len(row) != params.size for row in table) or not len(table) == len(params.stop) == params.size:
            raise ValueError("transitions must be K x K, start and stop K long")
        return params

    @property
    def size(self) -> int:
        return len(self.start)


def _row(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _columns(params: CrfParams) -> Column:
    """Transitions by target tag: entry j holds the scores of all tags going to j."""
    return F.array(*[_row([row[j] for row in params.transitions]) for j in range(params.size)])


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def assemble_sequences(df: DataFrame, seq: str = "seq_id", pos: str = "pos", columns: Sequence[str] = ("vec",),
                       names: Sequence[str] = ("emissions",)) -> DataFrame:
    """Token rows to one row per sequence, in position order. A sequence is at most a block long."""
    rows = df.groupBy(seq).agg(F.sort_array(F.collect_list(F.struct(pos, *columns))).alias("__r"))
    return rows.select(seq, *[F.col("__r")[c].alias(n) for c, n in zip(columns, names)])


def _check(emissions: Column, params: CrfParams) -> Column:
    fits = F.forall(emissions, lambda e: F.size(e) == params.size) & (F.size(emissions) > 0)
    return F.when(fits, emissions).otherwise(
        F.raise_error(F.lit(f"emissions must be non-empty with {params.size} scores per position"))
        .cast("array<array<double>>"))


def labelled(emissions: Column, tags: Column, params: CrfParams, ignored: int = IGNORED,
             pad_as_zero: bool = False) -> Column:
    """Positions as ``array<struct<e, t>>``: those tagged -100 are left out with their emissions, or
    (``pad_as_zero``) stay as tag 0. Any other tag outside the parameters raises."""
    zipped = F.arrays_zip(emissions.alias("e"), tags.alias("t"))
    if pad_as_zero:
        zipped = F.transform(zipped, lambda z: F.struct(z["e"].alias("e"), F.when(z["t"] == ignored, 0).otherwise(z["t"]).alias("t")))
    else:
        zipped = F.filter(zipped, lambda z: z["t"] != ignored)
    known = F.forall(zipped, lambda z: (z["t"] >= 0) & (z["t"] < params.size))
    return F.when(known, zipped).otherwise(
        F.raise_error(F.lit(f"a tag is neither {ignored} nor 0 to {params.size - 1}")).cast("array<struct<e:array<double>,t:int>>"))


def sequence_score(emissions: Column, tags: Column, params: CrfParams, ignored: int = IGNORED,
                   pad_as_zero: bool = False) -> Column:
    """Score of a given tag path: emissions, transitions, start and stop.

    Positions tagged -100 are left out together with their emissions. ``pad_as_zero`` scores them as tag 0
    instead.
    """
    return bind(labelled(emissions, tags, params, ignored, pad_as_zero), lambda z: _path_score(z, params))


def _path_score(z: Column, params: CrfParams) -> Column:
    flat = _row([x for row in params.transitions for x in row])
    start, stop, k = _row(params.start), _row(params.stop), params.size
    steps = F.zip_with(
        F.slice(z, F.lit(1), F.greatest(F.size(z) - 1, F.lit(0))), F.slice(z, F.lit(2), F.greatest(F.size(z) - 1, F.lit(0))),
        lambda a, b: F.element_at(flat, (a["t"] * k + b["t"] + 1).cast("int")))
    seen = F.transform(z, lambda x: F.element_at(x["e"], x["t"].cast("int") + 1))
    return F.when(F.size(z) > 0, (
        total(seen) + total(steps)
        + F.element_at(start, F.element_at(z, 1)["t"].cast("int") + 1)
        + F.element_at(stop, F.element_at(z, -1)["t"].cast("int") + 1)))


def log_partition(emissions: Column, params: CrfParams) -> Column:
    """Log of the summed scores of all tag paths (forward algorithm)."""
    columns, stop = _columns(params), _row(params.stop)

    def step(alpha: Column, emission: Column) -> Column:
        arrive = F.transform(columns, lambda into: log_sum_exp(_plus(alpha, into)))
        return _plus(arrive, emission)

    def run(e: Column) -> Column:
        first = _plus(F.element_at(e, 1), _row(params.start))
        alpha = F.aggregate(F.slice(e, F.lit(2), F.size(e) - 1), first, step)
        return log_sum_exp(_plus(alpha, stop))

    return bind(_check(emissions, params), run)


def viterbi(emissions: Column, params: CrfParams) -> Column:
    """The best tag path, ``array<int>``; the lower tag on ties."""
    columns, stop = _columns(params), _row(params.stop)

    def step(state: Column, emission: Column) -> Column:
        arrive = F.transform(columns, lambda into: bind(_plus(state["score"], into), lambda x: bind(
            F.array_max(x), lambda m: F.struct(m.alias("m"), F.array_position(x, m).cast("int").alias("b")))))
        return bind(arrive, lambda a: F.struct(
            F.zip_with(a, emission, lambda x, e: x["m"] + e).alias("score"),
            F.concat(state["back"], F.array(F.transform(a, lambda x: x["b"]))).alias("back")))

    def run(e: Column) -> Column:
        first = F.struct(_plus(F.element_at(e, 1), _row(params.start)).alias("score"),
                         F.array().cast("array<array<int>>").alias("back"))
        return bind(F.aggregate(F.slice(e, F.lit(2), F.size(e) - 1), first, step), walk_back)

    def walk_back(state: Column) -> Column:
        last = bind(_plus(state["score"], stop),
                    lambda x: F.array_position(x, F.array_max(x)).cast("int"))
        path = F.aggregate(F.reverse(state["back"]), F.array(last),
                           lambda p, back: F.concat(p, F.array(F.element_at(back, F.element_at(p, -1)))))
        return F.transform(F.reverse(path), lambda t: t - 1)

    return bind(_check(emissions, params), run)


def mean_nll(df: DataFrame, params: CrfParams, emissions: str = "emissions", tags: str = "tags",
             by: Sequence[str] = (), ignored: int = IGNORED, pad_as_zero: bool = False) -> DataFrame:
    """Mean over sequences of log partition minus path score, both over the same positions.

    A sequence with no position left says nothing and is not counted.
    """
    same = F.when(F.size(emissions) == F.size(tags), F.col(emissions)).otherwise(
        F.raise_error(F.lit("emissions and tags must have the same length")).cast("array<array<double>>"))

    def loss(z: Column) -> Column:
        return F.when(F.size(z) > 0, log_partition(F.transform(z, lambda x: x["e"]), params) - _path_score(z, params))

    kept = labelled(F.col("__e"), F.col(tags), params, ignored, pad_as_zero)
    return df.withColumn("__e", same).groupBy(*by).agg(F.avg(bind(kept, loss)).alias("nll"))


def label_bigrams(df: DataFrame, label: str, order: Sequence[str], keys: Sequence[str], **options) -> DataFrame:
    """``(prev, cur, n)`` over row-per-position sequences; ``prev`` is ``<s>`` at a start, ``cur`` ``</s>`` at
    an end.

    Works for sequences of any length: neighbours are found by bucket, not by one window per sequence.
    """
    near = neighbours(df.select(*keys, *order, label), [label], order, keys, lag="__p", lead="__n", **options)
    last = F.col("__n").isNull()
    steps = F.array(
        F.struct(F.coalesce(F.col("__p")[label], F.lit("<s>")).alias("prev"), F.col(label).alias("cur")),
        F.when(last, F.struct(F.col(label).alias("prev"), F.lit("</s>").alias("cur"))))
    return (near.select(F.inline_outer(steps)).where("cur IS NOT NULL")
            .groupBy("prev", "cur").agg(F.count("*").alias("n")))


def bigram_scores(bigrams: DataFrame, labels: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """``(prev, cur, n, log_p)`` for every pair of the label list, with add-``alpha`` smoothing per ``prev``.

    The closed-form estimate of transition, start and stop scores. The label list makes the pairs, so the
    table has (K+1)*(K+1) - 1 rows, pairs never seen included.
    """
    spark = bigrams.sparkSession
    pairs = [(p, c) for p in ["<s>", *labels] for c in [*labels, "</s>"] if (p, c) != ("<s>", "</s>")]
    table = spark.createDataFrame(pairs, "prev string, cur string")
    filled = table.join(bigrams, ["prev", "cur"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    totals = filled.groupBy("prev").agg(F.sum("n").alias("__t"), F.count("*").alias("__k"))
    log_p = F.ln((F.col("n") + alpha) / (F.col("__t") + alpha * F.col("__k")))
    return filled.join(totals, "prev").select("prev", "cur", "n", log_p.alias("log_p"))


# ---- fitting ---------------------------------------------------------------------------------------


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _kept_positions(batch: pd.DataFrame, emissions: str, tags: str, k: int, ignored: int, pad_as_zero: bool):
    """Padded emissions (sequence, position, tag), tags and lengths of a batch, ignored positions left out."""
    kept = []
    for e, y in zip(batch[emissions], batch[tags]):
        y = np.asarray(y, dtype=int)
        keep = np.ones(len(y), bool) if pad_as_zero else y != ignored
        y = np.where(y == ignored, 0, y)[keep]
        if ((y < 0) | (y >= k)).any():
            raise ValueError(f"a tag is neither {ignored} nor 0 to {k - 1}")
        if len(y):
            kept.append((np.stack(list(e)).astype(float)[keep], y))
    length = np.array([len(y) for _, y in kept], dtype=int)
    x, tag = np.zeros((len(kept), int(length.max(initial=0)), k)), np.zeros((len(kept), int(length.max(initial=0))), int)
    for i, (e, y) in enumerate(kept):
        x[i, :len(y)], tag[i, :len(y)] = e, y
    return x, tag, length


def _observed_minus_expected(x: np.ndarray, tag: np.ndarray, length: np.ndarray, t, start, stop):
    """Summed gradient of the log-likelihoods of a batch, and their sum: one step per position for all sequences."""
    m, n, k = x.shape
    rows, last = np.arange(m), length - 1
    alpha, beta = np.empty((n, m, k)), np.empty((n, m, k))
    alpha[0], beta[n - 1] = x[:, 0] + start, stop
    for i in range(1, n):
        step = _lse(alpha[i - 1][:, :, None] + t, 1) + x[:, i]
        alpha[i] = np.where((i <= last)[:, None], step, alpha[i - 1])
    for i in range(n - 2, -1, -1):
        step = _lse(t + (x[:, i + 1] + beta[i + 1])[:, None, :], 2)
        beta[i] = np.where((i < last)[:, None], step, stop)
    log_z = _lse(alpha[n - 1] + stop, 1)
    d_t, d_start, d_stop = np.zeros((k, k)), np.zeros(k), np.zeros(k)
    for i in range(n - 1):
        on = i < last
        d_t -= np.exp(alpha[i][on][:, :, None] + t + (x[on, i + 1] + beta[i + 1][on])[:, None, :]
                      - log_z[on][:, None, None]).sum(axis=0)
        np.add.at(d_t, (tag[on, i], tag[on, i + 1]), 1)
    d_start -= np.exp(alpha[0] + beta[0] - log_z[:, None]).sum(axis=0)
    d_stop -= np.exp(alpha[n - 1] + stop - log_z[:, None]).sum(axis=0)
    np.add.at(d_start, tag[:, 0], 1)
    np.add.at(d_stop, tag[rows, last], 1)
    on = np.arange(n)[None, :] <= last[:, None]
    path = (np.take_along_axis(x, tag[:, :, None], 2)[:, :, 0] * on).sum() + start[tag[:, 0]].sum() + stop[tag[rows, last]].sum()
    path += (t[tag[:, :-1], tag[:, 1:]] * on[:, 1:]).sum()
    return d_t, d_start, d_stop, float(path - log_z.sum())


def gradient(df: DataFrame, params: CrfParams, emissions: str = "emissions", tags: str = "tags",
             ignored: int = IGNORED, pad_as_zero: bool = False) -> DataFrame:
    """``(slot, value)``: the summed gradient and log-likelihood of all sequences.

    Slots 0..K*K-1 are transitions, then start, then stop; -1 is the log-likelihood and -2 the number of
    sequences with a position left. Every Arrow batch is one padded array and is added up in its task:
    K*K + 2K + 2 rows leave it.
    """
    k = params.size
    t, start, stop = np.array(params.transitions), np.array(params.start), np.array(params.stop)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values = np.zeros(k * k + 2 * k + 2)
        for batch in batches:
            x, tag, length = _kept_positions(batch, emissions, tags, k, ignored, pad_as_zero)
            if len(length):
                d_t, d_start, d_stop, score = _observed_minus_expected(x, tag, length, t, start, stop)
                values += np.concatenate([d_t.ravel(), d_start, d_stop, [score, len(length)]])
        yield pd.DataFrame({"slot": [*range(k * k + 2 * k), -1, -2], "value": values})

    return (df.select(emissions, tags).mapInPandas(partial, "slot int, value double")
            .groupBy("slot").agg(F.sum("value").alias("value")))


def fit(df: DataFrame, size: int, iterations: int = 20, rate: float = 1.0, emissions: str = "emissions",
        tags: str = "tags", start_from: CrfParams | None = None) -> tuple[CrfParams, list[float]]:
    """Gradient ascent on the mean log-likelihood of transition, start and stop scores.

    Each iteration is one distributed pass; the driver receives K*K + 2K + 2 numbers and updates them.
    Give a stored table: it is read once per iteration. Returns the parameters and the mean negative
    log-likelihood before each update.
    """
    params = start_from or CrfParams.of(np.zeros((size, size)), np.zeros(size), np.zeros(size))
    losses = []
    for _ in range(iterations):
        got = {r["slot"]: r["value"] for r in gradient(df, params, emissions, tags).collect()}
        n = max(got[-2], 1.0)
        losses.append(-got[-1] / n)
        step = rate / n * np.array([got[i] for i in range(size * size + 2 * size)])
        square = size * size
        params = CrfParams.of(
            np.array(params.transitions) + step[:square].reshape(size, size),
            np.array(params.start) + step[square:square + size],
            np.array(params.stop) + step[square + size:])
    return params, losses
