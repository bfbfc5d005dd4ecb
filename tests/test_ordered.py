import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import ordered


def rows_of(seed, hot=0.5, sparse=False):
    """Rows of which one key holds half; ids with holes on request."""
    rng = random.Random(seed)
    ids = rng.sample(range(100_000 if sparse else 400), 300)
    return [("hot" if rng.random() < hot else f"k{rng.randint(0, 4)}", i, rng.randint(-5, 9)) for i in ids]


def grouped(rows):
    out = {}
    for key, i, v in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(key, []).append((i, v))
    return out


@pytest.mark.parametrize("bits,levels,sparse", [(2, 0, False), (3, 1, False), (3, 3, True), (12, 0, True)])
@pytest.mark.parametrize("how", ["sum", "max", "min"])
def test_running_matches_a_plain_loop(spark, bits, levels, sparse, how):
    rows = rows_of(bits, sparse=sparse)
    df = spark.createDataFrame(rows, "k string, id bigint, v int")
    got = ordered.running(df, F.col("v"), "r", ["id"], ["k"], how=how, bits=bits, levels=levels)
    assert got.columns == ["k", "id", "v", "r"]
    found = {(r["k"], r["id"]): r["r"] for r in got.collect()}
    assert len(found) == len(rows)
    fold = {"sum": sum, "max": max, "min": min}[how]
    for key, items in grouped(rows).items():
        for n, (i, _) in enumerate(items):
            past = [v for _, v in items[:n]]
            assert found[(key, i)] == (fold(past) if past else (0 if how == "sum" else None))


@pytest.mark.parametrize("bits,levels", [(2, 0), (3, 2)])
def test_neighbours_match_a_plain_loop(spark, bits, levels):
    rows = rows_of(9, sparse=True)
    df = spark.createDataFrame(rows, "k string, id bigint, v int")
    got = ordered.neighbours(df, ["v", "id"], ["id"], ["k"], lag="p", lead="n", bits=bits, levels=levels)
    found = {(r["k"], r["id"]): r for r in got.collect()}
    assert len(found) == len(rows)
    for key, items in grouped(rows).items():
        for n, (i, _) in enumerate(items):
            row = found[(key, i)]
            assert (row["p"] and (row["p"]["id"], row["p"]["v"])) == (items[n - 1] if n else None)
            assert (row["n"] and (row["n"]["id"], row["n"]["v"])) == (items[n + 1] if n + 1 < len(items) else None)


def test_dense_index_without_keys_and_with_null_keys(spark):
    rows = [(None if i % 3 else "a", i * 17) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, id bigint")
    whole = {r["id"]: r["x"] for r in ordered.dense_index(df, "x", ["id"], bits=4).collect()}
    assert whole == {i * 17: i for i in range(60)}
    keyed = ordered.dense_index(df, "x", ["id"], ["k"], bits=4).collect()
    for key in ("a", None):
        assert [r["x"] for r in sorted((r for r in keyed if r["k"] == key), key=lambda r: r["id"])] == list(
            range(20 if key else 40))


def test_given_bucket_columns(spark):
    rows = [("f", b, r) for b in (0, 128, 256) for r in range(b, b + 5)]
    df = spark.createDataFrame(rows, "file string, block bigint, rec bigint")
    got = ordered.dense_index(df, "x", ["rec"], ["file"], bucket=["block"])
    assert [r["x"] for r in got.orderBy("block", "rec").collect()] == list(range(15))
    assert got.columns == ["file", "block", "rec", "x"]


@pytest.mark.parametrize("hot_keys", [1, 3, 100])
def test_lookup_is_a_join_whatever_the_number_of_hot_keys(spark, hot_keys):
    rng = random.Random(3)
    facts = [(i, "hot" if rng.random() < 0.4 else f"k{rng.randint(0, 30)}") for i in range(500)]
    counts = {k: sum(f[1] == k for f in facts) for k in {f[1] for f in facts} if k != "k7"}
    left = spark.createDataFrame(facts, "i int, k string")
    table = spark.createDataFrame([(k, n, n * 10) for k, n in counts.items()], "k string, w int, v int")
    inner = ordered.lookup(left, table, ["k"], "w", spread=["i"], hot_keys=hot_keys)
    assert sorted((r["i"], r["k"], r["v"]) for r in inner.collect()) == sorted(
        (i, k, counts[k] * 10) for i, k in facts if k in counts)
    outer = ordered.lookup(left, table, ["k"], "w", spread=["i"], how="left", hot_keys=hot_keys)
    assert {r["i"]: r["v"] for r in outer.collect()} == {
        i: counts[k] * 10 if k in counts else None for i, k in facts}
