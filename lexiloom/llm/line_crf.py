"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is good or bad. A line's features are binned figures of its characters and words (``STATS``),
those of the line before and of the line after, and whether it is the first or last; the chain adds start and
transition scores. Forward and backward sums give every line's probability of being good, and a document's quality is
their mean, weighted by the lines' bytes (and one for the line end).

Fitting takes the lines of a bounded sample of labelled documents (``SAMPLE`` of each label, whole texts, chosen by a
hash of id and text), all lines of a document with the document's label, and maximises the regularised likelihood on
the driver. Prediction is one pass over the text without a shuffle.

Cases: a null text is an empty one, an empty text is one empty line and gets a score as any other; equal texts score
alike; rows without an id or label teach nothing, equal rows teach once, and an id that is labelled twice has the mean
label, good from one half on. Without labelled rows every score is one half. Other columns pass through. A text of any
length is read whole; its lines take about 100 bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import bytes_of, pieces, words

#: labelled documents of each label that are fitted
SAMPLE = 4000
STEPS, RATE, PENALTY = 150, 0.1, 1e-4
RUN = 4 << 20
STATS = ("bytes", "letters", "upper case", "digits", "symbols", "word length", "distinct words", "repeated words", "words without letters",
         "words ending in symbols", "capitalised words")
BINS = 16
OWN = len(STATS) * BINS
#: own, previous and next line's bins, and two marks for the first and the last line
FEATURES = 3 * OWN + 2
BAD, GOOD = 0, 1

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
SYMBOL = ~(LETTER | DIGIT | BLANK)


class Model(NamedTuple):
    weight: np.ndarray  # score of a good line, by feature
    step: np.ndarray  # (from, to)
    start: np.ndarray


class Lines(NamedTuple):
    """One entry per line, by text and position; ``first`` has each text's first line, and one more entry."""

    doc: np.ndarray
    start: np.ndarray
    size: np.ndarray
    first: np.ndarray


def cut_lines(buf: np.ndarray, off: np.ndarray) -> Lines:
    """The lines of all texts, line ends left out. A text has one more line than line ends."""
    n = len(off) - 1
    ends = np.flatnonzero(buf == 10)
    doc = np.concatenate([np.arange(n), np.searchsorted(off, ends, "right") - 1])
    start = np.concatenate([off[:-1], ends + 1])
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    stop = off[doc + 1].copy()
    inner = doc[1:] == doc[:-1]
    stop[:-1][inner] = start[1:][inner] - 1
    return Lines(doc, start, stop - start, np.searchsorted(doc, np.arange(n + 1)))


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Tenths, rounded down; 11 is exactly all, and 0 exactly none."""
    with np.errstate(divide="ignore", invalid="ignore"):
        f = np.where(whole > 0, part / np.maximum(whole, 1), 0.0)
    return np.where(f >= 1, 11, np.where(f > 0, 1 + np.minimum(np.floor(f * 10), 9), 0)).astype(np.int16)


def bins(buf: np.ndarray, lines: Lines) -> np.ndarray:
    """The bin of every figure of every line (lines x figures)."""
    n = len(lines.doc)
    total = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    letters, symbols = total(LETTER[buf]), total(SYMBOL[buf])
    stop = lines.start + lines.size
    within = lambda t: t[stop] - t[lines.start]
    w = words(buf, np.append(lines.start, len(buf)), lower=False)
    line = w.doc
    per = lambda flags: np.bincount(line[flags], minlength=n)
    count = np.bincount(line, minlength=n)
    again = np.zeros(len(line), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((w.hash, line))
    new = np.ones(len(line), bool)
    new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (line[order][1:] != line[order][:-1])
    mute = letters[w.end] == letters[w.start]
    two = np.maximum(w.end - 2, w.start)
    marked = ((symbols[w.end] - symbols[two]) == 2) & (w.end - w.start > 2)
    capital = UPPER[buf[w.start]] if len(line) else np.zeros(0, bool)
    size, abc = lines.size, within(letters)
    mean = np.bincount(line, w.end - w.start, n) / np.maximum(count, 1)
    return np.stack([
        np.minimum(np.log2(size + 1), BINS - 1).astype(np.int16), _share(abc, size), _share(within(total(UPPER[buf])), abc),
        _share(within(total(DIGIT[buf])), size), _share(within(symbols), size), np.minimum(mean, BINS - 1).astype(np.int16),
        _share(np.bincount(line[order][new], minlength=n), count), _share(per(again), count), _share(per(mute), count),
        _share(per(marked), count), _share(per(capital), count)], 1)


def features(bin: np.ndarray, lines: Lines) -> np.ndarray:
    """Feature indexes of every line: its own bins, those of its neighbours, and the marks of first and last; -1 is none."""
    own = (bin + np.arange(len(STATS), dtype=np.int16) * BINS).astype(np.int32)
    n = len(own)
    out = np.full((n, 3 * len(STATS) + 2), -1, np.int32)
    k = len(STATS)
    out[:, :k] = own
    inner = lines.doc[1:] == lines.doc[:-1]
    out[1:, k : 2 * k][inner] = own[:-1][inner] + OWN
    out[:-1, 2 * k : 3 * k][inner] = own[1:][inner] + 2 * OWN
    out[lines.first[:-1], 3 * k] = 3 * OWN
    out[lines.first[1:] - 1, 3 * k + 1] = 3 * OWN + 1
    return out


def _scores(model: Model, index: np.ndarray) -> np.ndarray:
    return np.append(model.weight, 0.0)[index].sum(1)


def _active(first: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Texts by falling number of lines, and how many have a line at each position."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    longest = int(n.max(initial=0))
    return order, (len(n) - np.searchsorted(np.sort(n), np.arange(longest), "right")).tolist()


def forward_backward(model: Model, score: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log forward and backward sums (lines x 2) and the log partition of every text."""
    order, active = _active(first)
    begin, end = first[:-1][order], first[1:][order] - 1
    emit = np.stack([np.zeros_like(score), score], 1)
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    step = model.step
    for t, k in enumerate(active):
        at = begin[:k] + t
        if t == 0:
            alpha[at] = model.start + emit[at]
        else:
            p = alpha[at - 1]
            alpha[at] = np.logaddexp(p[:, :1] + step[0], p[:, 1:] + step[1]) + emit[at]
    for t, k in enumerate(active[1:]):
        k = active[t + 1]
        at = end[:k] - t - 1  # texts with at least t + 2 lines
        nxt = beta[at + 1] + emit[at + 1]
        beta[at] = np.logaddexp(step[:, 0] + nxt[:, :1], step[:, 1] + nxt[:, 1:])
    last = alpha[first[1:] - 1]
    return alpha, beta, np.logaddexp(last[:, 0], last[:, 1])


def marginals(model: Model, index: np.ndarray, lines: Lines) -> np.ndarray:
    """The probability that a line is good, for every line."""
    alpha, beta, log_z = forward_backward(model, _scores(model, index), lines.first)
    return np.exp(alpha[:, GOOD] + beta[:, GOOD] - log_z[lines.doc])


def likelihood(model: Model, index: np.ndarray, lines: Lines, good: np.ndarray) -> tuple[float, Model]:
    """Mean log-likelihood of all lines of a text having its label, and its slopes."""
    score = _scores(model, index)
    alpha, beta, log_z = forward_backward(model, score, lines.first)
    p = np.exp(alpha + beta - log_z[lines.doc][:, None])
    y = good[lines.doc]
    n = len(good)
    inner = np.flatnonzero(lines.doc[1:] == lines.doc[:-1])
    emit = np.stack([np.zeros_like(score), score], 1)
    pair = np.exp(alpha[inner][:, :, None] + model.step + (emit + beta)[inner + 1][:, None, :] - log_z[lines.doc[inner]][:, None, None])
    step = -pair.sum(0)
    np.add.at(step, (y[inner], y[inner]), 1)
    start = np.bincount(y[lines.first[:-1]], minlength=2) - p[lines.first[:-1]].sum(0)
    miss = y - p[:, GOOD]
    weight = np.bincount(index.ravel() + 1, np.repeat(miss, index.shape[1]), FEATURES + 1)[1:]
    path = (score * y).sum() + model.step[y[inner], y[inner]].sum() + model.start[y[lines.first[:-1]]].sum()
    return float(path - log_z.sum()) / n, Model(weight / n, step / n, start / n)


def fit_lines(index: np.ndarray, lines: Lines, good: np.ndarray, steps: int = STEPS) -> Model:
    """Ascend the regularised likelihood with rates by coordinate (Adam)."""
    flat = np.zeros(FEATURES + 6)
    m, v = np.zeros_like(flat), np.zeros_like(flat)

    def model() -> Model:
        return Model(flat[:FEATURES], flat[FEATURES : FEATURES + 4].reshape(2, 2), flat[FEATURES + 4 :])

    for t in range(1, steps + 1 if len(good) else 1):
        _, slope = likelihood(model(), index, lines, good)
        g = np.concatenate([slope.weight, slope.step.ravel(), slope.start]) - PENALTY * flat
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        flat = flat + RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return model()


def _sample_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bins of every line of the sampled documents: one row per document."""
    for batch in batches:
        for part in pieces(batch, limit=RUN):
            buf, off = bytes_of(part.column("text"))
            lines = cut_lines(buf, off)
            found = bins(buf, lines).astype(np.uint8)
            rows = [found[a:b].tobytes() for a, b in zip(lines.first[:-1].tolist(), lines.first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("good"), pa.array(rows, pa.binary())], names=["good", "bins"])


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, steps: int = STEPS) -> Model:
    """Fit on documents (doc_id, text) with labels (doc_id, quality: 1 is good)."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).alias("good"))
    sizes = {r["good"]: r["n"] for r in marks.groupBy("good").agg(F.count("*").alias("n")).collect()}

    def drawn(key, share):
        return F.pmod(F.xxhash64(key, F.lit("draw")), F.lit(1 << 30)) < F.lit(float(1 << 30)) * share

    share = F.when(F.col("good"), min(1.0, 2.0 * sample / sizes.get(True, 1))).otherwise(min(1.0, 2.0 * sample / sizes.get(False, 1)))
    # about twice the sample of each label: not every labelled document need be there
    chosen = docs.select("doc_id", "text").join(F.broadcast(marks.where(drawn(F.col("doc_id"), share))), "doc_id")
    keyed = chosen.where(F.col("text").isNotNull()).withColumn("key", F.xxhash64("doc_id", "text"))
    found = {r["good"]: r["n"] for r in keyed.groupBy("good").agg(F.countDistinct("key").alias("n")).collect()}
    share = F.when(F.col("good"), min(1.0, sample / found.get(True, 1))).otherwise(min(1.0, sample / found.get(False, 1)))
    rows = (keyed.where(drawn(F.col("key"), share)).groupBy("key").agg(F.first("good").alias("good"), F.first("text").alias("text"))
            .select("key", "good", "text").orderBy("key").select("good", "text").mapInArrow(_sample_task, "good boolean, bins binary").toArrow())
    good = rows["good"].to_numpy().astype(np.int64)
    each = [np.frombuffer(x, np.uint8).reshape(-1, len(STATS)) for x in rows["bins"].to_pylist()]
    n = np.array([len(x) for x in each], np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    lines = Lines(np.repeat(np.arange(len(n)), n), np.zeros(0), np.zeros(0), first)
    table = np.concatenate(each).astype(np.int16) if each else np.zeros((0, len(STATS)), np.int16)
    return fit_lines(features(table, lines) if each else np.zeros((0, 3 * len(STATS) + 2), np.int32), lines, good, steps)


def label_texts(model: Model, texts: pa.Array) -> tuple[Lines, np.ndarray, np.ndarray]:
    """The lines of the texts, every line's probability of being good, and every text's quality."""
    buf, off = bytes_of(texts)
    lines = cut_lines(buf, off)
    p = marginals(model, features(bins(buf, lines), lines), lines)
    weight = lines.size + 1.0
    n = len(texts)
    return lines, p, np.clip(np.bincount(lines.doc, weight * p, n) / np.bincount(lines.doc, weight, n), 0.0, 1.0)


def _predict_task(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text", RUN):
                _, _, quality = label_texts(shared.value, part.column("__text"))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], pa.array(quality)], names=[*keep, "score"])

    return run


def _lines_task(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text", RUN):
                lines, p, _ = label_texts(shared.value, part.column("__text"))
                at = pa.array(lines.doc)
                kept = [part.column(i).take(at) for i in range(len(keep))]
                number = np.arange(len(at)) - lines.first[lines.doc]
                _, off = bytes_of(part.column("__text"))
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(number), pa.array(lines.start - off[lines.doc]), pa.array(lines.size), pa.array(p), pa.array(p >= 0.5)],
                    names=[*keep, "line", "start", "size", "probability", "good"])

    return run


def _run(docs: DataFrame, text: str, keep: list[str] | None, task, model: Model, made: list[T.StructField]) -> DataFrame:
    names = {f.name for f in made}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    plain = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES + 6 numbers
    return plain.mapInArrow(task(shared, keep), T.StructType([*plain.schema.fields[: len(keep)], *made]))


def predict(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``score``, 0 to 1, beside the columns ``keep`` (all, if not given); it takes the place of a column of that name."""
    return _run(docs, text, keep, _predict_task, model, [T.StructField("score", T.DoubleType())])


def label_lines(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per line: its number, first byte and bytes in the text, the probability that it is good, and the label."""
    return _run(docs, text, keep, _lines_task, model, [
        T.StructField("line", T.LongType()), T.StructField("start", T.LongType()), T.StructField("size", T.LongType()),
        T.StructField("probability", T.DoubleType()), T.StructField("good", T.BooleanType())])
