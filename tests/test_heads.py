"""Heads fitted by scans against whole-array arithmetic."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import heads

D, L = 4, 3


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (150, D))
    y = (x @ rng.normal(0, 2, (D, L)) + rng.normal(0, 0.3, (150, L))).argmax(1)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(150)], "id int, vec array<double>, label int")
    return df.withColumn("held", heads.held_out(0.3, 7, F.col("id"))), x, y


def losses(w, x, y):
    z = np.column_stack([np.ones(len(x)), x]) @ w.T
    return np.log(np.exp(z).sum(1)) - z[np.arange(len(x)), y]


def test_stacked_slopes_are_numeric_slopes(rows):
    df, x, y = rows
    held = np.array([r["held"] for r in df.orderBy("id").collect()])
    w = np.random.default_rng(1).normal(0, 0.5, (2, L, D + 1))
    got = heads.linear_sums(df, w)
    for s in range(2):
        assert math.isclose(got[s, heads.HELD_LOSS], losses(w[s], x[held], y[held]).sum(), rel_tol=1e-9)
        assert got[s, heads.TRAIN_ROWS] == (~held).sum() and got[s, heads.HELD_ROWS] == held.sum()
        for k in range(L * (D + 1)):
            up, down = w[s].copy(), w[s].copy()
            up.ravel()[k] += 1e-6
            down.ravel()[k] -= 1e-6
            diff = (losses(up, x[~held], y[~held]).sum() - losses(down, x[~held], y[~held]).sum()) / 2e-6
            assert math.isclose(got[s, k], diff, abs_tol=1e-4)


GRID = [heads.Setting(r, p) for r in (0.1, 1.0) for p in (0.0, 0.5)]


def test_a_grid_is_the_same_under_any_partitioning_and_as_one_by_one(rows):
    df, _, _ = rows
    together = heads.grid_descent(df, GRID, L, D, [4])
    for parts in (1, 7):
        again = heads.grid_descent(df.repartition(parts), GRID, L, D, [4])
        assert all(math.isclose(a.held_loss, b.held_loss, rel_tol=1e-9) and a.accuracy == b.accuracy for a, b in zip(together, again))
    alone = heads.grid_descent(df, GRID[2:3], L, D, [4])[0]
    assert math.isclose(alone.held_loss, together[2].held_loss, rel_tol=1e-9) and alone.steps == 4


def test_halving_takes_the_better_half_on(rows):
    df, _, _ = rows
    short, long = heads.grid_descent(df, GRID, L, D, [2]), heads.grid_descent(df, GRID, L, D, [5])
    got = heads.grid_descent(df, GRID, L, D, [2, 3])
    best = sorted(range(4), key=lambda i: short[i].held_loss)[:2]
    for i in range(4):
        want = long[i] if i in best else short[i]
        assert got[i].steps == (5 if i in best else 2) and math.isclose(got[i].held_loss, want.held_loss, rel_tol=1e-9)


def test_two_layer_slope_is_the_numeric_slope_and_fitting_falls(rows):
    df, x, y = rows
    head = heads.two_layer_start(D, 5, L, seed=1)

    def loss(flat):
        h = head.like(flat)
        z = np.maximum(x @ h.hidden.T + h.hidden_bias, 0) @ h.out.T + h.out_bias
        return (np.log(np.exp(z).sum(1)) - z[np.arange(len(x)), y]).mean()

    value, slope, n = heads.two_layer_loss(df, head)
    flat = head.flat()
    assert n == 150 and math.isclose(value, loss(flat), rel_tol=1e-9)
    for k in range(len(flat)):
        e = np.zeros(len(flat))
        e[k] = 1e-6
        assert math.isclose(slope[k], (loss(flat + e) - loss(flat - e)) / 2e-6, abs_tol=1e-5)
    fitted, seen = heads.fit_two_layer(df, head, iterations=12)
    assert all(b < a for a, b in zip(seen, seen[1:])) and seen[-1] < 0.5 * seen[0]
    assert math.isclose(loss(fitted.flat()), seen[-1], rel_tol=1e-9)


def test_the_two_loop_direction_solves_a_quadratic():
    rng = np.random.default_rng(2)
    a = rng.normal(0, 1, (6, 6))
    a = a @ a.T + np.eye(6)
    steps = [rng.normal(0, 1, 6) for _ in range(40)]
    changes = [a @ s for s in steps]
    g = rng.normal(0, 1, 6)
    assert np.allclose(heads.lbfgs_direction(g, [], []), -g)
    got = heads.lbfgs_direction(g, steps, changes)
    assert (got @ g) < 0 and np.linalg.norm(a @ got + g) < 0.2 * np.linalg.norm(g)
