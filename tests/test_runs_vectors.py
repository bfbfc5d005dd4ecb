import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexiloom.functions import numeric
from lexiloom.operators import metrics, represent, runs
from lexiloom.plans import vectors


def states(spark, mask):
    """Backward states stand where un-reversing the array by the mask puts them in place."""
    n = len(mask)
    forward = [(0, p, m, [float(p), 1.0]) for p, m in enumerate(mask)]
    order = [p for p in range(n) if mask[p]][::-1] + [p for p in range(n) if not mask[p]]
    backward = [(0, b, [float(10 + p)]) for p, b in enumerate(order)]
    return (spark.createDataFrame(forward, "seq_id bigint, pos bigint, mask int, vec array<float>"),
            spark.createDataFrame(backward, "seq_id bigint, pos bigint, vec array<float>"))


@pytest.mark.parametrize("mask", [[1, 1, 1, 0, 0], [1], [0, 0], [1, 1], [0, 0, 1, 1, 1], [0, 1, 0, 1, 1, 0]])
def test_mirror_join_keeps_pads_in_place(spark, mask):
    rows = represent.mirror_join(*states(spark, mask), mask="mask").orderBy("pos").collect()
    assert [r["vec"] for r in rows] == [[float(p), 1.0, float(10 + p)] for p in range(len(mask))]


def test_mirror_join_modes_and_missing_rows(spark):
    forward, backward = states(spark, [1, 1, 1])
    assert represent.mirror_join(forward, backward, mode="forward").first()["vec"][1] == 1.0
    with pytest.raises(ValueError):
        represent.mirror_join(forward, backward, mode="sum")
    with pytest.raises(PySparkException, match="no backward state"):
        represent.mirror_join(forward, backward.where("pos > 0")).collect()


@pytest.mark.parametrize("name", ["mirror_join", "mirror_join_left", "forward_states"])
def test_mirror_joins_of_sequences_with_missing_vectors(spark, tmp_path, name):
    ids = [*range(10), *range(10, 16), 21, 24, 29, 31, 39, 70]
    rows = [(v, [float((7 * k + 3 * i) % 11) for i in range(64)]) for k, v in enumerate(ids)] + [(25, None)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vectors.QUERIES[name](spark, str(tmp_path)).collect()
    wide = 64 if name != "forward_states" else 32
    want = [(v // 10, v % 10, None if x is None else sum(y * (i + 1) for i, y in enumerate(x[:wide]))) for v, x in rows]
    assert sorted(((r["seq_id"], r["pos"], r["checksum"]) for r in got), key=repr) == sorted(want, key=repr)


def test_head_scores(spark):
    rng = np.random.default_rng(1)
    w1, b1, w2, b2 = rng.normal(size=(4, 3)), rng.normal(size=4), rng.normal(size=(2, 4)), rng.normal(size=2)
    x = rng.normal(size=(20, 3))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, vec array<double>")
    got = np.array([r["logits"] for r in represent.head_scores(df, w1, b1, w2, b2).orderBy("i").collect()])
    assert np.allclose(got, np.maximum(x @ w1.T + b1, 0) @ w2.T + b2)
    assert represent.head_scores(df.limit(0), w1, b1, w2, b2).count() == 0


def test_heads_learn_separable_labels(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(200):
        label = i % 2
        rows.append(([float(v) for v in rng.normal(size=2) * 0.1 + (label * 2 - 1)], label))
    df = spark.createDataFrame(rows, "vec array<double>, label int").cache()
    for kind, extra in (("linear", {"maxIter": 20}), ("two_layer", {"layers": [2, 4, 2], "maxIter": 40, "seed": 1})):
        out = represent.apply_head(represent.fit_head(df, kind, **extra), df)
        assert out.where("pred = label").count() > 190
    with pytest.raises(ValueError):
        represent.fit_head(df, "other")


def test_numeric_functions(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], 1), ([1000.0, 0.0, 0.0], -100)], "x array<double>, y int")
    rows = df.select(numeric.argmax(F.col("x")).alias("a"), numeric.log_sum_exp(F.col("x")).alias("l"),
                     numeric.cross_entropy(F.col("x"), F.col("y")).alias("c"),
                     numeric.softmax(F.col("x")).alias("s")).collect()
    assert [r["a"] for r in rows] == [1, 0]
    z = math.log(math.exp(1) + 2 * math.exp(3))
    assert math.isclose(rows[0]["l"], z) and math.isclose(rows[0]["c"], z - 3)
    assert rows[1]["l"] == 1000.0 and rows[1]["c"] is None and math.isclose(sum(rows[0]["s"]), 1.0)


def test_epoch_loss_weighs_batches_not_tokens(spark):
    rows = [(0, [0.0, 0.0], 0)] * 3 + [(1, [0.0, math.log(3)], 1)]
    df = spark.createDataFrame(rows, "batch int, logits array<double>, label int")
    by_batch = metrics.epoch_loss(df, "batch").first()["loss"]
    assert math.isclose(by_batch, (math.log(2) + math.log(4 / 3)) / 2)
    assert math.isclose(metrics.mean_loss(df).first()["loss"], (3 * math.log(2) + math.log(4 / 3)) / 4)


def test_improvements_are_strict(spark):
    scores = [0.0, 0.5, 0.5, 0.4, 0.7]
    df = spark.createDataFrame([("r", e, s) for e, s in enumerate(scores)], "run_id string, epoch bigint, s double")
    up = metrics.improvements(df, "s", ["epoch"], bits=1)
    assert [r["improved"] for r in up.orderBy("epoch").collect()] == [False, True, False, False, True]
    best = metrics.best_epochs(up, ["epoch"], ["epoch", "s"]).first()
    assert (best["epoch"], best["s"], best["n_improved"]) == (4, 0.7, 2)
    down = metrics.improvements(df, "s", ["epoch"], higher=False)
    assert [r["improved"] for r in down.orderBy("epoch").collect()] == [True, False, False, False, False]


def test_label_report(spark):
    df = spark.createDataFrame([(["a", "a", "b", "c"], ["a", "b", "b", "a"])], "gold array<string>, pred array<string>")
    rows = {r["label"]: r for r in metrics.label_report(metrics.confusion(df)).collect()}
    assert rows["accuracy"]["f1"] == 0.5 and rows["c"]["f1"] == 0.0 and rows["a"]["precision"] == 0.5
    assert math.isclose(rows["macro avg"]["recall"], 0.5) and rows["weighted avg"]["support"] == 4


def test_grid_and_trials(spark):
    df = spark.createDataFrame([("d",)], "dataset string")
    cells = runs.with_run_id(runs.expand_grid(df, {"k": [4, 16], "seed": [1, 2, 3]}), "%s/%s/%s", "dataset", "k", "seed")
    assert {r["run_id"] for r in cells.collect()} == {f"d/{k}/{s}" for k in (4, 16) for s in (1, 2, 3)}
    values = F.create_map(F.lit("lr"), F.array(*[F.lit(str(i)) for i in range(5)]))
    drawn = runs.random_trials(df.withColumn("c", values), "c", 500, 1, ["dataset"])
    rows = drawn.collect()
    assert [r["value"] for r in rows] == [r["value"] for r in drawn.collect()]
    assert all(60 < sum(r["value"] == str(i) for r in rows) < 145 for i in range(5))


def test_learning_curve_gain(spark):
    rows = [("m", 4, "concat", 30.0), ("m", 4, "concat", 20.0), ("m", 4, "forward", 10.0), ("m", 16, "concat", 5.0)]
    df = spark.createDataFrame(rows, "model string, k int, variant string, f1 double")
    got = {r["k"]: r for r in metrics.learning_curve(df).collect()}
    assert got[4]["gain"] == 15.0 and got[4]["log4_k"] == 1.0 and got[4]["n_runs"] == 3
    assert got[16]["gain"] is None and got[16]["concat_mean"] == 5.0
