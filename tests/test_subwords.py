import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions import arrays, subwords
from lexiloom.functions.text import fixed_pieces, md5_number
from lexiloom.operators import labels
from lexiloom.plans import tagging

POOL = ["", "a", "abcd", "abcde", "überlangää", "\U0001f600" * 5, "日本語" * 3, "x\ny\nz\r\nlong"]


def made_rows(seed, count):
    rng = random.Random(seed)
    rows = [(0, None, None), (1, [], []), (2, None, [1]), (3, ["abcdef"], None), (4, ["", ""], [1, 2]), (5, [None], [3])]
    for i in range(6, count):
        tokens = [rng.choice(POOL + [None] * (i % 3 == 0)) for _ in range(rng.randint(0, 9))]
        size = max(0, len(tokens) + rng.choice([0, 0, 1, -1]))
        rows.append((i, tokens, [rng.choice([0, 1, 2, None]) for _ in range(size)]))
    return rows


def plain(tokens, tags, width):
    """Pieces, word ids and labels of a row."""
    if tokens is None:
        return None, None, None
    cut = [None if w is None else [w[i:i + width] for i in range(0, len(w), width)] for w in tokens]
    lost = None in cut
    flat = None if lost else [p for c in cut for p in c]
    ids = None if lost else [i for i, c in enumerate(cut) for _ in c]
    own = None if tags is None else [x for i, c in enumerate(cut) if c for x in [tags[i] if i < len(tags) else None, *[-100] * (len(c) - 1)]]
    return flat, ids, own


@pytest.mark.parametrize("part", [1, 2 << 20])
@pytest.mark.parametrize("width", [1, 4])
def test_batches_are_cut_as_the_plain_rule_does(part, width, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(subwords, "PART", part)
    rows = made_rows(part + width, 200)
    tokens = pa.array([r[1] for r in rows], pa.list_(pa.string()))
    tags = pa.array([r[2] for r in rows], pa.list_(pa.int32()))
    made = {}
    monkeypatch.setattr(subwords.F, "arrow_udf", lambda kind: lambda fn: lambda *columns: made.setdefault(fn.__name__, fn))
    subwords.fixed_word_pieces(F, width), subwords.piece_words(F, width), subwords.md5_numbers(F, 4, 1)
    subwords.piece_labels(F, type("Given", (), {"cast": lambda self, kind: self})(), T.IntegerType(), -100, width)
    want = [plain(t, g, width) for _, t, g in rows]
    for a, b in [(0, 200), (7, 150), (3, 3)]:
        some = tokens.slice(a, b - a), tags.slice(a, b - a)
        pieces = made["cut"](some[0])
        assert pieces.to_pylist() == [w[0] for w in want[a:b]]
        assert made["placed"](some[0]).to_pylist() == [w[1] for w in want[a:b]]
        assert made["labelled"](*some).to_pylist() == [w[2] for w in want[a:b]]
        assert made["numbers"](pieces).to_pylist() == [w[0] and [int(hashlib.md5(p.encode()).hexdigest()[:4], 16) + 1 for p in w[0]] for w in want[a:b]]


def test_sub_word_rows_of_words_and_of_given_pieces(spark):
    rows = made_rows(2, 120)
    df = spark.createDataFrame(rows, "id int, tokens array<string>, l array<int>")
    given = df.withColumn("cut", F.transform("tokens", lambda w: fixed_pieces(w, 3)))
    for frame in (labels.subword_rows(df, "tokens", "l", None, width=3), labels.subword_rows(given, "tokens", "l", None, pieces="cut"),
                  labels.subword_rows(df, "tokens", "l", None, pieces=lambda w: fixed_pieces(w, 3))):
        got = {r["id"]: (r["pieces"], r["word_ids"], r["sub_labels"]) for r in frame.collect()}
        assert got == {i: plain(t, g, 3) for i, t, g in rows}
    for kind, ignored in (("bigint", -100), ("double", -100.0)):
        wide = labels.subword_rows(df.withColumn("l", F.col("l").cast(f"array<{kind}>")), "tokens", "l", None)
        assert wide.schema["sub_labels"].dataType.simpleString() == f"array<{kind}>"
        assert wide.where("id = 4 or id = 1").count() == 2 and {x for r in wide.collect() for x in r["sub_labels"] or []} >= {ignored}


def test_numbers_of_an_array_are_those_of_its_texts(spark):
    df = spark.createDataFrame([(["a", "", None, "ä", "a"],), ([],), (None,)], "v array<string>")
    for digits in (1, 4, 8):
        row = df.select(subwords.md5_numbers(F.col("v"), digits, 5).alias("n"), F.transform("v", lambda x: md5_number(x, digits=digits) + 5).alias("m"))
        assert all(r["n"] == r["m"] for r in row.collect())


def test_fitted_ids_are_reversed_as_by_their_mask(spark):
    rows = [(None,), ([],), ([0, None, 3],), (list(range(9)),), ([7],)]
    for length in (1, 3, 9, 20):
        df = spark.createDataFrame(rows, "i array<int>").withColumns({"f": arrays.fit_length(F.col("i"), length, 7), "m": arrays.fit_mask(F.col("i"), length)})
        both = df.select(arrays.masked_reverse(F.col("f"), F.col("m")).alias("a"), arrays.fit_reversed(F.col("i"), length, 7).alias("b"))
        assert all(r["a"] == r["b"] for r in both.collect())


def test_features_are_made_in_one_python_step_without_a_lambda_per_piece(spark, folder):
    plan = tagging.QUERIES["features"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("MapInArrow") == 1
    assert "md5(" not in plan and "regexp_extract_all" not in plan and "filter(" not in plan and "zip_with" not in plan
    assert plan.count("transform(") == 1  # the tags' ids
