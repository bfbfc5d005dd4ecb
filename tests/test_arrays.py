import random

from pyspark.sql import functions as F

from lexiloom.functions import arrays


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    df = spark.createDataFrame([tuple(v for _, v in values.values())], schema)
    return df.select(column.alias("x")).first()["x"]


def test_unreverse_with_mask(spark):
    states = [[4, 4], [3, 3], [2, 2], [1, 1], [-1, -1], [-1, -1]]
    got = one(spark, arrays.unreverse(F.col("s"), F.col("m")),
              s=("array<array<int>>", states), m=("array<int>", [1, 1, 1, 1, 0, 0]))
    assert got == [[1, 1], [2, 2], [3, 3], [4, 4], [-1, -1], [-1, -1]]


def test_masked_reverse_documented_cases(spark):
    cases = [([1, 3, 2, 5, 0, 0], [1, 1, 1, 1, 0, 0], [5, 2, 3, 1, 0, 0]),
             ([5661, 318, 257, 6291, 13], [1] * 5, [13, 6291, 257, 318, 5661]),
             ([19509, 6827, 9, 9, 9], [1, 1, 0, 0, 0], [6827, 19509, 9, 9, 9])]
    for ids, mask, want in cases:
        assert one(spark, arrays.masked_reverse(F.col("i"), F.col("m")),
                   i=("array<int>", ids), m=("array<int>", mask)) == want


def test_masked_reverse_of_left_padding(spark):
    # the ids come out right-padded, the pads in reversed order
    assert one(spark, arrays.masked_reverse(F.col("i"), F.col("m")), i=("array<int>", [-1, -2, 7, 8]),
               m=("array<int>", [0, 0, 1, 1])) == [8, 7, -2, -1]


def test_reversal_properties(spark):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        n, pads = rng.randint(0, 9), rng.randint(0, 4)
        rows.append((i, [rng.randint(1, 99) for _ in range(n)] + [0] * pads, [1] * n + [0] * pads))
    df = spark.createDataFrame(rows, "i int, ids array<int>, mask array<int>")
    df = df.withColumn("r", arrays.masked_reverse(F.col("ids"), F.col("mask")))
    df = df.withColumn("u", arrays.unreverse(F.col("r"), F.col("mask")))
    for row in df.collect():
        n = sum(row["mask"])
        assert row["u"] == row["ids"] and len(row["r"]) == len(row["ids"])
        assert row["r"][:n] == row["ids"][:n][::-1] and row["r"][n:] == row["ids"][n:]


def test_fit_length(spark):
    for ids in ([], [1, 2], [1, 2, 3], [1, 2, 3, 4, 5]):
        fitted = one(spark, arrays.fit_length(F.col("i"), 3, 0), i=("array<int>", ids))
        mask = one(spark, arrays.fit_mask(F.col("i"), 3), i=("array<int>", ids))
        assert fitted == (ids + [0, 0, 0])[:3]
        assert mask == [int(k < len(ids)) for k in range(3)]


def test_special_mask_and_length(spark):
    assert one(spark, arrays.special_mask(F.col("i"), [0, 9]), i=("array<int>", [0, 4, 9])) == [1, 0, 1]
    assert arrays.effective_length(None, 4096) == 1024
    assert arrays.effective_length(None, 512) == 512
    assert arrays.effective_length(2048, 4096) == 2048
    assert arrays.effective_length(2048, 512) == 512


def test_shifts_of_short_arrays(spark):
    for ids in ([], [1], [1, 2, 3]):
        right = one(spark, arrays.shifted_right(F.col("i"), F.lit(0)), i=("array<int>", ids))
        left = one(spark, arrays.shifted_left(F.col("i"), F.lit(0)), i=("array<int>", ids))
        assert right[:len(ids)] == ([0] + ids)[:len(ids)]
        assert left[:len(ids)] == (ids + [0])[1:][:len(ids)]
