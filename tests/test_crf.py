import itertools
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexiloom.operators import crf

K = 3


def setup(seed, n=25, longest=5, whole=False):
    rng = random.Random(seed)
    number = (lambda: float(rng.randint(-2, 2))) if whole else (lambda: rng.gauss(0, 1))
    params = crf.CrfParams.of([[number() for _ in range(K)] for _ in range(K)], [number() for _ in range(K)],
                              [number() for _ in range(K)])
    rows = []
    for i in range(n):
        size = rng.randint(1, longest)
        rows.append((i, [[number() for _ in range(K)] for _ in range(size)], [rng.randint(0, K - 1) for _ in range(size)]))
    return params, rows


def score(params, emissions, path):
    total = params.start[path[0]] + params.stop[path[-1]]
    total += sum(e[t] for e, t in zip(emissions, path))
    return total + sum(params.transitions[a][b] for a, b in zip(path, path[1:]))


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, emissions array<array<double>>, tags array<int>")


def test_against_all_paths(spark):
    params, rows = setup(1)
    e, t = F.col("emissions"), F.col("tags")
    got = {r["id"]: r for r in frame(spark, rows).select(
        "id", crf.sequence_score(e, t, params).alias("s"), crf.log_partition(e, params).alias("z"),
        crf.viterbi(e, params).alias("v")).collect()}
    for i, emissions, tags in rows:
        paths = list(itertools.product(range(K), repeat=len(tags)))
        scores = [score(params, emissions, p) for p in paths]
        assert math.isclose(got[i]["s"], score(params, emissions, tags), abs_tol=1e-9)
        assert math.isclose(got[i]["z"], math.log(sum(math.exp(s) for s in scores)), abs_tol=1e-9)
        assert tuple(got[i]["v"]) == paths[int(np.argmax(scores))]
        assert got[i]["z"] >= max(scores)


def test_best_path_with_ties_is_still_best(spark):
    params, rows = setup(2, whole=True)
    got = {r["id"]: r["v"] for r in frame(spark, rows).select(
        "id", crf.viterbi(F.col("emissions"), params).alias("v")).collect()}
    for i, emissions, tags in rows:
        best = max(score(params, emissions, p) for p in itertools.product(range(K), repeat=len(tags)))
        assert math.isclose(score(params, emissions, got[i]), best, abs_tol=1e-9)


def test_ignored_positions(spark):
    params, _ = setup(3)
    e = [[1.0, 2.0, 3.0], [0.5, 0.5, 0.5], [4.0, 1.0, 0.0]]
    df = frame(spark, [(0, e, [2, 1, -100]), (1, e, [-100, -100, -100])])
    column = crf.sequence_score(F.col("emissions"), F.col("tags"), params).alias("s")
    zero = crf.sequence_score(F.col("emissions"), F.col("tags"), params, pad_as_zero=True).alias("z")
    rows = df.select("id", column, zero).orderBy("id").collect()
    assert math.isclose(rows[0]["s"], score(params, e[:2], [2, 1]))
    assert math.isclose(rows[0]["z"], score(params, e, [2, 1, 0]))
    assert rows[1]["s"] is None


def test_shapes_are_checked(spark):
    params, _ = setup(4)
    with pytest.raises(PySparkException, match="scores per position"):
        frame(spark, [(0, [[1.0, 2.0]], [0])]).select(crf.viterbi(F.col("emissions"), params)).collect()
    with pytest.raises(PySparkException, match="same length"):
        crf.mean_nll(frame(spark, [(0, [[1.0, 2.0, 3.0]], [0, 1])]), params).collect()
    with pytest.raises(ValueError):
        crf.CrfParams.of([[0.0]], [0.0, 1.0], [0.0, 1.0])


def test_gradient_is_the_slope_and_fitting_descends(spark):
    params, rows = setup(5, n=12)
    df = frame(spark, rows).cache()
    got = {r["slot"]: r["value"] for r in crf.gradient(df.repartition(3), params).collect()}
    n = len(rows)
    assert got[-2] == n
    nll = crf.mean_nll(df, params).first()["nll"]
    assert math.isclose(-got[-1] / n, nll, abs_tol=1e-9)
    step = 1e-5
    for slot, (i, j) in ((1, (0, 1)), (5, (1, 2))):
        moved = [list(row) for row in params.transitions]
        moved[i][j] += step
        there = crf.mean_nll(df, crf.CrfParams.of(moved, params.start, params.stop)).first()["nll"]
        assert math.isclose((nll - there) / step, got[slot] / n, abs_tol=1e-3)
    fitted, losses = crf.fit(df, K, iterations=5, rate=0.5)
    assert losses == sorted(losses, reverse=True) and fitted.size == K


def test_label_bigrams_of_a_hot_sequence(spark):
    rng = random.Random(6)
    rows = [("hot", i, rng.choice("AB")) for i in range(300)] + [(f"s{k}", i, "A") for k in range(5) for i in range(2)]
    df = spark.createDataFrame(rows, "seq string, pos bigint, tag string")
    got = {(r["prev"], r["cur"]): r["n"] for r in crf.label_bigrams(df, "tag", ["pos"], ["seq"], bits=4).collect()}
    want = {}
    for seq in {r[0] for r in rows}:
        path = ["<s>"] + [t for s, _, t in sorted(rows) if s == seq] + ["</s>"]
        for p in zip(path, path[1:]):
            want[p] = want.get(p, 0) + 1
    assert got == want
    scored = crf.bigram_scores(crf.label_bigrams(df, "tag", ["pos"], ["seq"]), ["A", "B"]).collect()
    assert len(scored) == 8
    for prev in ("<s>", "A", "B"):
        assert math.isclose(sum(math.exp(r["log_p"]) for r in scored if r["prev"] == prev), 1.0, abs_tol=1e-9)


def masked(rows):
    return [(i, [e for e, y in zip(es, ys) if y != -100], [y for y in ys if y != -100]) for i, es, ys in rows]


def ignored_rows(rng, n=40):
    rows = []
    for i in range(n):
        size = rng.integers(1, 7)
        tags = [-100 if rng.random() < 0.4 else int(rng.integers(0, K)) for _ in range(size)]
        rows.append((i, [[float(v) for v in rng.normal(size=K) * 3] for _ in range(size)], tags))
    return rows


def test_ignored_positions_are_left_out_of_both_terms(spark):
    rng = np.random.default_rng(8)
    params = crf.CrfParams.of(rng.normal(size=(K, K)), rng.normal(size=K), rng.normal(size=K))
    rows = ignored_rows(rng)
    kept = [r for r in masked(rows) if r[1]]
    want = crf.mean_nll(frame(spark, kept), params).first()["nll"]
    assert crf.mean_nll(frame(spark, rows), params).first()["nll"] == pytest.approx(want)
    one = crf.mean_nll(frame(spark, rows), params, by=["id"]).collect()
    assert all(r["nll"] is None or r["nll"] >= 0 for r in one)
    zero = [(i, e, [0 if y == -100 else y for y in ys]) for i, e, ys in rows]
    want = crf.mean_nll(frame(spark, zero), params).first()["nll"]
    assert crf.mean_nll(frame(spark, rows), params, pad_as_zero=True).first()["nll"] == pytest.approx(want)
    for pad, plain in ((False, kept), (True, zero)):
        got = {r["slot"]: r["value"] for r in crf.gradient(frame(spark, rows), params, pad_as_zero=pad).collect()}
        wanted = {r["slot"]: r["value"] for r in crf.gradient(frame(spark, plain).repartition(3), params).collect()}
        assert got.keys() == wanted.keys() and all(got[s] == pytest.approx(wanted[s], abs=1e-9) for s in got)


def test_hand_case_of_an_ignored_tag(spark):
    params = crf.CrfParams.of([[0.0, 0.0]] * 2, [0.0] * 2, [0.0] * 2)
    df = frame(spark, [(0, [[0.0, 0.0], [-50.0, -50.0]], [0, -100])])
    assert crf.mean_nll(df, params).first()["nll"] == pytest.approx(np.log(2))
    assert crf.mean_nll(frame(spark, [(0, [[0.0, 0.0]], [-100])]), params).first()["nll"] is None


@pytest.mark.parametrize("tag", [-1, 9])
def test_other_tags_raise(spark, tag):
    params = crf.CrfParams.of(np.zeros((K, K)), np.zeros(K), np.zeros(K))
    df = frame(spark, [(0, [[0.0] * K], [tag])])
    with pytest.raises(PySparkException):
        crf.mean_nll(df, params).collect()
    with pytest.raises(PySparkException):
        crf.gradient(df, params).collect()
