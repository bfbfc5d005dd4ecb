"""Bidirectional token representation and heads on it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .ordered import running_total


def mirror_join(forward: DataFrame, backward: DataFrame, seq: str = "seq_id", pos: str = "pos",
                vec: str = "vec", mask: str | None = None, mode: str = "concat", keep: Sequence[str] = ()) -> DataFrame:
    """``(seq, pos, vec, *keep)``: forward state and un-reversed backward state of every token, concatenated.

    ``mask`` is that of both sides, pads anywhere. As in un-reversing an array, the backward states of valid
    positions, last one first, belong to the first positions, and those of pads follow in their own order; with
    pads at the end that is position n-1-p for p of n, and pads in place. Positions count from 0 without holes.
    The backward state of a valid position goes to the number of valid positions after it, that of a pad to its own
    position moved on by that number: one bucketed count from the end over narrow rows says both, whatever the length.
    The joins are on sequence *and* position, so a long sequence spreads like many short ones. A forward row without a
    backward row raises; a state that is NULL makes a NULL. ``keep`` names further columns of ``forward``.
    ``mode="forward"`` keeps the forward states alone.
    """
    if mode == "forward":
        return forward.select(seq, pos, vec, *keep)
    if mode != "concat":
        raise ValueError(f"mode {mode!r} is neither 'concat' nor 'forward'")
    place = F.col(pos).cast("bigint")
    valid = (F.col(mask) == 1) if mask else F.lit(True)
    places = forward.select(seq, place.alias("__from"), valid.alias("__valid"), (-place).alias("__back_order"))
    places = running_total(places, F.col("__valid").cast("bigint"), "__after", ["__back_order"], [seq])
    placed = places.select(seq, "__from", (F.col("__after") + F.when(F.col("__valid"), 0).otherwise(F.col("__from"))).alias("__at"))
    right = (backward.select(seq, place.alias("__from"), F.col(vec).alias("__back"), F.lit(True).alias("__met"))
             .join(placed, [seq, "__from"]).drop("__from"))
    left = forward.select(seq, pos, vec, *keep, place.alias("__at"))
    joined = left.join(right, [seq, "__at"], "left")
    both = F.when(F.col("__met"), F.concat(vec, "__back")).otherwise(
        F.raise_error(F.format_string("no backward state for position %d", F.col(pos))).cast("array<float>"))
    return joined.select(seq, pos, both.alias(vec), *keep)


def head_scores(df: DataFrame, hidden: np.ndarray, hidden_bias: np.ndarray, out: np.ndarray,
                out_bias: np.ndarray, vec: str = "vec", logits: str = "logits") -> DataFrame:
    """Two-layer head with given weights: linear, ReLU, linear; one matrix product per Arrow batch."""
    w1, b1, w2, b2 = (np.asarray(a, dtype="float64") for a in (hidden, hidden_bias, out, out_bias))

    @F.pandas_udf(ArrayType(DoubleType()))
    def score(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype="object")
        x = np.stack(vectors.to_numpy()).astype("float64")
        return pd.Series(list(np.maximum(x @ w1.T + b1, 0.0) @ w2.T + b2))

    return df.withColumn(logits, score(vec))


def head_gradient(df: DataFrame, weights: np.ndarray, bias: np.ndarray, vec: str = "vec", label: str = "label") -> DataFrame:
    """``(label, dim, slope)`` of the mean cross-entropy of a linear head at given weights; dim -1 is the bias.

    Every Arrow batch is one matrix product, added up in its task: labels x (dimensions + 1) rows leave it.
    """
    w, b = np.asarray(weights, "float64"), np.asarray(bias, "float64")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((len(b), w.shape[1] + 1)), 0
        for batch in batches:
            if len(batch):
                x = np.stack(batch[vec].to_numpy()).astype("float64")
                z = x @ w.T + b
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(p)), batch[label].to_numpy(int)] -= 1
                total[:, 0] += p.sum(axis=0)
                total[:, 1:] += p.T @ x
                n += len(x)
        labels, dims = np.indices(total.shape)
        yield pd.DataFrame({"label": labels.ravel(), "dim": dims.ravel() - 1, "total": total.ravel(), "n": n})

    parts = df.select(vec, label).mapInPandas(partial, "label int, dim int, total double, n bigint")
    return parts.groupBy("label", "dim").agg((F.sum("total") / F.sum("n")).alias("slope"))


def _learner(kind: str, vec: str, label: str, layers: Sequence[int] | None, settings: dict):
    if kind == "linear":
        return LogisticRegression(featuresCol="__x", labelCol=label, **settings)
    if kind == "two_layer":
        if not layers:
            raise ValueError("the two-layer head needs its layer widths")
        return MultilayerPerceptronClassifier(featuresCol="__x", labelCol=label, layers=list(layers), **settings)
    raise ValueError(f"head {kind!r} is neither 'linear' nor 'two_layer'")


def fit_head(df: DataFrame, kind: str = "linear", vec: str = "vec", label: str = "label",
             layers: Sequence[int] | None = None, **settings):
    """A token classifier on fixed features, trained by distributed L-BFGS."""
    return _learner(kind, vec, label, layers, settings).fit(df.withColumn("__x", array_to_vector(vec)))


def apply_head(model, df: DataFrame, vec: str = "vec", out: str = "pred") -> DataFrame:
    scored = model.transform(df.withColumn("__x", array_to_vector(vec)))
    return scored.withColumn(out, F.col("prediction").cast("int")).drop(
        "__x", "rawPrediction", "probability", "prediction")
