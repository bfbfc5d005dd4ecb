"""Long sequences in buckets against the row-wise operators, which are checked against all paths."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import crf, crf_long

K = 3


def setup(seed, sizes, k=K, whole=False):
    rng = random.Random(seed)
    number = (lambda: float(rng.randint(-2, 2))) if whole else (lambda: rng.gauss(0, 1))
    params = crf.CrfParams.of([[number() for _ in range(k)] for _ in range(k)], [number() for _ in range(k)], [number() for _ in range(k)])
    return params, [(i, [[number() for _ in range(k)] for _ in range(n)], [rng.randint(0, k - 1) for _ in range(n)]) for i, n in enumerate(sizes)]


def frames(spark, rows):
    wide = spark.createDataFrame(rows, "id int, emissions array<array<double>>, tags array<int>")
    flat = [(f"s{i}" if i else None, p, e, t) for i, emissions, tags in rows for p, (e, t) in enumerate(zip(emissions, tags))]
    random.Random(0).shuffle(flat)
    return wide.withColumn("key", F.when(F.col("id") > 0, F.concat(F.lit("s"), "id"))), spark.createDataFrame(flat, "key string, pos int, vec array<double>, tag int")


SIZES = [1, 2, 3, 4, 5, 8, 9, 16, 17, 40, 7, 1, 33]


@pytest.fixture
def narrow(monkeypatch):
    """Two matrices a level, so that short sequences have many levels."""
    monkeypatch.setattr(crf_long, "FAN", 1)


@pytest.mark.parametrize("bits", [2, 7])
def test_partition_and_path_equal_the_row_wise_ones(spark, narrow, bits):
    params, rows = setup(1, SIZES)
    wide, flat = frames(spark, rows)
    want = {r["key"]: r for r in wide.select("key", crf.log_partition(F.col("emissions"), params).alias("z"), crf.viterbi(F.col("emissions"), params).alias("v")).collect()}
    got = {r["key"]: r["log_z"] for r in crf_long.log_partition(flat, params, ["key"], bits=bits).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]["z"], abs_tol=1e-9) for k in want)
    path = {}
    for r in crf_long.viterbi(flat, params, ["key"], bits=bits).orderBy("pos").collect():
        path.setdefault(r["key"], []).append(r["tag"])
    assert path == {k: list(r["v"]) for k, r in want.items()}


@pytest.mark.parametrize("bits", [2])
def test_ties_take_the_lower_tag_across_borders(spark, narrow, bits):
    """Whole numbers add up without rounding, so ties are ties in any order."""
    params, rows = setup(5, SIZES * 3, whole=True)
    wide, flat = frames(spark, [(i, e, t) for i, (_, e, t) in enumerate(rows)])
    want = {r["key"]: list(r["v"]) for r in wide.select("key", crf.viterbi(F.col("emissions"), params).alias("v")).collect()}
    path = {}
    for r in crf_long.viterbi(flat, params, ["key"], bits=bits).orderBy("pos").collect():
        path.setdefault(r["key"], []).append(r["tag"])
    assert path == want


@pytest.mark.parametrize("bits", [2, 7])
def test_gradient_equals_the_row_wise_one(spark, narrow, bits):
    params, rows = setup(2, SIZES)
    wide, flat = frames(spark, rows)
    want = {r["slot"]: r["value"] for r in crf.gradient(wide, params).collect()}
    got = {r["slot"]: r["value"] for r in crf_long.gradient(flat, params, ["key"], bits=bits).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-7) for k in want)


def test_many_tags_and_one_long_sequence(spark):
    params, rows = setup(3, [700, 3], k=40)
    wide, flat = frames(spark, rows)
    want = {r["key"]: r["z"] for r in wide.select("key", crf.log_partition(F.col("emissions"), params).alias("z")).collect()}
    got = {r["key"]: r["log_z"] for r in crf_long.log_partition(flat, params, ["key"], bits=5).collect()}
    assert all(math.isclose(got[k], want[k], rel_tol=1e-10) for k in want)


def test_forbidden_steps_lose_no_path():
    rng = np.random.default_rng(4)
    a, m = rng.normal(0, 1, (6, 5)), rng.normal(0, 1, (5, 5))
    m[rng.random((5, 5)) < 0.6] = -10_000.0
    a[rng.random((6, 5)) < 0.3] = -2_000.0
    a[0] = -np.inf
    want = np.logaddexp.reduce(a[:, :, None] + m, axis=1)
    assert np.allclose(crf_long.log_times(a, m), want, equal_nan=True)
    best, at = crf_long._best_before(a, m)
    assert (best == crf_long.max_times(a, m)).all() and (at[1:] == (a[1:, :, None] + m).argmax(1)).all()


def test_broken_sequences_raise(spark):
    params, _ = setup(4, [1])
    make = lambda rows: spark.createDataFrame(rows, "key string, pos int, vec array<double>, tag int")
    for rows, text in [([("a", 1, [0.0] * K, 0)], "no position 0"), ([("a", -1, [0.0] * K, 0)], "count from 0"),
                       ([("a", 0, [0.0] * 2, 0)], "scores per position"), ([("a", 0, [0.0] * K, 0)] * 3, "repeat")]:
        with pytest.raises(Exception, match=text):
            crf_long.log_partition(make(rows), params, ["key"], bits=1).collect()
    with pytest.raises(Exception, match="a tag is not"):
        crf_long.gradient(make([("a", 0, [0.0] * K, -100)]), params, ["key"]).collect()
    assert crf_long.log_partition(make([]), params, ["key"]).collect() == []
    assert crf_long.viterbi(make([]), params, ["key"]).collect() == []
