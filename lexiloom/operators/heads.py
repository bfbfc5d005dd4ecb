"""Heads on fixed features, fitted by passes over the rows: many linear settings at once, and a two-layer head.

Every pass is one scan: a task turns its Arrow batches into matrix products, adds up loss and slopes, and hands on one
number per parameter; the driver holds parameters only. Settings of a grid are one stacked array, so that a grid costs
the scans of its longest setting, not of all of them. Which rows are held out is a function of their key, not of where
they lie, so the same grid gives the same choice under any partitioning (up to the order of sums).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import md5_number
from ..session import stored

TRAIN_LOSS, HELD_LOSS, HELD_RIGHT, TRAIN_ROWS, HELD_ROWS = -1, -2, -3, -4, -5


def held_out(rate: float, seed: int, *key: Column) -> Column:
    """Whether a row is held out, by a hash of its key."""
    return md5_number(F.lit(seed), *key) % 10_000 < int(rate * 10_000)


def _softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities over the last axis, and the log of their denominator."""
    top = z.max(-1, keepdims=True)
    e = np.exp(z - top)
    total = e.sum(-1, keepdims=True)
    return e / total, (top + np.log(total))[..., 0]


def _summed(df: DataFrame, partial: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> dict[tuple[int, int], float]:
    """Sums by (setting, slot) over all tasks: as many numbers as there are parameters, and a few."""
    rows = df.mapInPandas(partial, "setting int, slot int, value double").groupBy("setting", "slot").agg(F.sum("value").alias("value"))
    return {(r["setting"], r["slot"]): r["value"] for r in rows.collect()}


def _table(setting: np.ndarray, slot: np.ndarray, value: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"setting": setting.astype("int32"), "slot": slot.astype("int32"), "value": value.astype(float)})


# ---- a grid of linear heads ------------------------------------------------------------------------


@dataclass(frozen=True)
class Setting:
    """One cell of a grid: how far a step goes along the slope, and the weight of half the squared weights in the loss."""

    rate: float
    penalty: float = 0.0


@dataclass
class Score:
    """How a setting did: after how many steps, its mean losses (without penalty) and the share of held-out rows it got right."""

    setting: Setting
    steps: int
    train_loss: float
    held_loss: float
    accuracy: float


def linear_sums(df: DataFrame, weights: np.ndarray, vec: str = "vec", label: str = "label", held: str = "held") -> dict[tuple[int, int], float]:
    """Slopes of the summed cross-entropy of stacked linear heads (setting x label x (bias, dimensions)), in one scan.

    Slots from 0 are the slopes of the rows that are not held out; negative ones are losses and counts.
    """
    w = np.asarray(weights, float)
    n_settings, n_labels, width = w.shape

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slope, other = np.zeros_like(w), np.zeros((n_settings, 5))
        for batch in batches:
            if not len(batch):
                continue
            x = np.column_stack([np.ones(len(batch)), np.stack(batch[vec].to_numpy()).astype(float)])
            y, out = batch[label].to_numpy(int), batch[held].to_numpy(bool)
            z = (x @ w.reshape(-1, width).T).reshape(len(x), n_settings, n_labels)
            p, log_total = _softmax(z)
            at = np.arange(len(x))
            loss = log_total - z[at, :, y]
            right = z.argmax(2) == y[:, None]
            p[at, :, y] -= 1
            slope += np.einsum("nsl,nd->sld", p[~out], x[~out], optimize=True)
            other += np.stack([loss[~out].sum(0), loss[out].sum(0), right[out].sum(0), np.full(n_settings, (~out).sum()), np.full(n_settings, out.sum())], 1)
        s, slot = np.indices((n_settings, n_labels * width))
        yield _table(s.ravel(), slot.ravel(), slope.reshape(n_settings, -1).ravel())
        s, slot = np.indices(other.shape)
        yield _table(s.ravel(), -1 - slot.ravel(), other.ravel())

    return _summed(df.select(vec, label, held), partial)


def grid_descent(df: DataFrame, settings: Sequence[Setting], labels: int, dims: int, steps: Sequence[int], keep: float = 0.5, vec: str = "vec",
                 label: str = "label", held: str = "held") -> list[Score]:
    """Fit all settings of a grid by gradient descent from zero, in as many scans as the longest takes (and one for scores).

    ``steps``: the length of every rung. After a rung the share ``keep`` of the settings with the least held-out loss goes on
    (successive halving; ties to the earlier setting). One rung takes all settings to its end. ``df`` is stored once. A
    setting's score is that of the last rung it was in.
    """
    rows = stored(df.select(vec, label, held), "head-rows")
    alive, weights, scores, done = list(range(len(settings))), np.zeros((len(settings), labels, dims + 1)), {}, 0
    for rung in steps:
        for left in range(rung, -1, -1):
            found = linear_sums(rows, weights[alive], vec, label, held)
            value = lambda s, slot: found.get((s, slot), 0.0)  # noqa: B023, E731
            n, n_held = max(value(0, TRAIN_ROWS), 1.0), max(value(0, HELD_ROWS), 1.0)
            if not left:
                break
            for s, i in enumerate(alive):
                slope = np.array([value(s, k) for k in range(labels * (dims + 1))]).reshape(labels, dims + 1) / n
                weights[i] = weights[i] - settings[i].rate * (slope + settings[i].penalty * weights[i])
            done += 1
        for s, i in enumerate(alive):
            scores[i] = Score(settings[i], done, value(s, TRAIN_LOSS) / n, value(s, HELD_LOSS) / n_held, value(s, HELD_RIGHT) / n_held)
        best = sorted(alive, key=lambda i: (round(scores[i].held_loss, 9), i))
        alive = sorted(best[: max(1, int(len(best) * keep))])
    return [scores[i] for i in range(len(settings))]


# ---- a two-layer head ------------------------------------------------------------------------------


@dataclass
class TwoLayer:
    """Linear, ReLU, linear: weights by (unit, input)."""

    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([self.hidden.ravel(), self.hidden_bias, self.out.ravel(), self.out_bias]).astype(float)

    def like(self, flat: np.ndarray) -> TwoLayer:
        """The head of this shape with other parameters."""
        cuts = np.split(flat, np.cumsum([self.hidden.size, self.hidden_bias.size, self.out.size]))
        return TwoLayer(cuts[0].reshape(self.hidden.shape), cuts[1], cuts[2].reshape(self.out.shape), cuts[3])


def two_layer_start(dims: int, hidden: int, labels: int, seed: int = 42) -> TwoLayer:
    """Small random weights, the same for the same seed."""
    rng = np.random.default_rng(seed)
    return TwoLayer(rng.normal(0, np.sqrt(2 / dims), (hidden, dims)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (labels, hidden)), np.zeros(labels))


def two_layer_loss(df: DataFrame, head: TwoLayer, vec: str = "vec", label: str = "label") -> tuple[float, np.ndarray, int]:
    """Mean cross-entropy of a two-layer head, its slope in every parameter (as ``flat``), and the rows: one scan."""
    size = len(head.flat())

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slope, loss, n = np.zeros(size), 0.0, 0
        for batch in batches:
            if not len(batch):
                continue
            x, y = np.stack(batch[vec].to_numpy()).astype(float), batch[label].to_numpy(int)
            a = x @ head.hidden.T + head.hidden_bias
            h = np.maximum(a, 0)
            z = h @ head.out.T + head.out_bias
            d, log_total = _softmax(z)
            at = np.arange(len(x))
            loss += float((log_total - z[at, y]).sum())
            d[at, y] -= 1
            back = (d @ head.out) * (a > 0)
            slope += np.concatenate([(back.T @ x).ravel(), back.sum(0), (d.T @ h).ravel(), d.sum(0)])
            n += len(x)
        yield _table(np.zeros(size + 2), np.array([*range(size), TRAIN_LOSS, TRAIN_ROWS]), np.append(slope, [loss, n]))

    found = _summed(df.select(vec, label), partial)
    n = max(found.get((0, TRAIN_ROWS), 0.0), 1.0)
    return found.get((0, TRAIN_LOSS), 0.0) / n, np.array([found.get((0, i), 0.0) for i in range(size)]) / n, int(n)


def lbfgs_direction(slope: np.ndarray, steps: Sequence[np.ndarray], changes: Sequence[np.ndarray]) -> np.ndarray:
    """Where to go from a slope, given the last steps and what they changed in the slope (two-loop recursion)."""
    q, weights = slope.copy(), []
    for s, y in zip(reversed(steps), reversed(changes)):
        a = (s @ q) / (y @ s)
        weights.append(a)
        q -= a * y
    if steps:
        q *= (steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
    for (s, y), a in zip(zip(steps, changes), reversed(weights)):
        q += s * (a - (y @ q) / (y @ s))
    return -q


def fit_two_layer(df: DataFrame, head: TwoLayer, iterations: int = 20, penalty: float = 0.0, memory: int = 5, vec: str = "vec",
                  label: str = "label") -> tuple[TwoLayer, list[float]]:
    """Fit by L-BFGS with backtracking; returns the head and the loss (with penalty) before every step and at the end.

    A trial of a step length is one scan, and its slope serves the next step. The loss never rises.
    """
    rows = stored(df.select(vec, label), "head-rows")

    def at(flat: np.ndarray) -> tuple[float, np.ndarray]:
        loss, slope, _ = two_layer_loss(rows, head.like(flat), vec, label)
        return loss + penalty / 2 * float(flat @ flat), slope + penalty * flat

    here = head.flat()
    loss, slope = at(here)
    losses, steps, changes = [loss], [], []
    for _ in range(iterations):
        way = lbfgs_direction(slope, steps, changes)
        length = 1.0 if steps else min(1.0, 1.0 / max(float(np.linalg.norm(slope)), 1e-12))
        for _ in range(20):
            there = here + length * way
            new_loss, new_slope = at(there)
            if new_loss <= loss + 1e-4 * length * float(slope @ way):
                break
            length /= 2
        else:
            break
        if (new_slope - slope) @ (there - here) > 1e-10:
            steps, changes = [*steps, there - here][-memory:], [*changes, new_slope - slope][-memory:]
        here, loss, slope = there, new_loss, new_slope
        losses.append(loss)
    return head.like(here), losses
