import random

import pytest
from pyspark.sql import functions as F

from lexiloom.functions.tags import chunk_ends, chunk_starts
from lexiloom.operators import metrics, spans


def chunks_of(tags):
    """Chunks of a tag list by looking at neighbours."""
    def kind(t):
        return ("O", None) if t == "O" else tuple(t.split("-", 1))

    def cut(a, b):
        return kind(a)[1] != kind(b)[1] or kind(b)[0] in "BS" or kind(a)[0] in "ES"

    out, begin = [], None
    for i, tag in enumerate(tags):
        before = tags[i - 1] if i else "O"
        after = tags[i + 1] if i + 1 < len(tags) else "O"
        if tag != "O" and (before == "O" or cut(before, tag)):
            begin = i
        if tag != "O" and (after == "O" or cut(tag, after)):
            out.append((begin, i, kind(tag)[1]))
    return out


def counts_of(pairs):
    table = {}
    for gold, pred in pairs:
        g, p = set(chunks_of(gold)), set(chunks_of(pred))
        for side, chunks in (("gold", g), ("pred", p), ("correct", g & p)):
            for c in chunks:
                table.setdefault(c[2], {"correct": 0, "gold": 0, "pred": 0})[side] += 1
    return table


def random_tags(rng, n, scheme="BIES"):
    return ["O" if rng.random() < 0.35 else f"{rng.choice(scheme)}-{rng.choice(['X', 'Y-Z'])}" for _ in range(n)]


def pair(rng, n):
    gold = random_tags(rng, n)
    return gold, [t if rng.random() < 0.8 else random_tags(rng, 1)[0] for t in gold]


def as_table(df):
    return {r["type"]: {c: r[c] for c in ("correct", "gold", "pred")} for r in df.collect()}


@pytest.mark.parametrize("before,here,start,end", [
    ("B-PER", "I-PER", False, False), ("B-LOC", "O", False, True), ("B-PER", "I-LOC", True, True),
    ("O", "I-PER", True, False), ("O", "O", False, False), ("I-PER", "B-PER", True, True),
    ("E-PER", "I-PER", True, True), ("S-PER", "S-PER", True, True), ("I-PER", "E-PER", False, False)])
def test_start_and_end_table(spark, before, here, start, end):
    row = spark.range(1).select(
        chunk_starts(F.lit(before), F.lit(here)).alias("s"), chunk_ends(F.lit(before), F.lit(here)).alias("e")).first()
    assert (row["s"], row["e"]) == (start, end)


def test_documented_sentences(spark):
    rows = [(0, ["B-PER", "O", "O", "B-LOC", "I-LOC", "I-LOC", "O"]),
            (1, ["S-PER", "O", "O", "B-LOC", "I-LOC", "E-LOC", "O"]), (2, []), (3, ["O"])]
    df = spark.createDataFrame(rows, "id int, tags array<string>")
    got = sorted(tuple(r) for r in spans.chunks(df, ["id"], "tags").collect())
    assert got == [(i, *c) for i in (0, 1) for c in ((0, 0, "PER"), (3, 5, "LOC"))]


def test_perfect_prediction(spark):
    tags = ["O", "O", "B-temp", "O"]
    df = spark.createDataFrame([(0, tags, tags), (1, tags, tags)], "id int, gold array<string>, pred array<string>")
    row = metrics.with_prf(spans.chunk_counts(df)).first()
    assert (row["precision"], row["recall"], row["f1"]) == (100.0, 100.0, 100.0)


def test_random_sentences(spark):
    rng = random.Random(1)
    data = [pair(rng, rng.randint(0, 12)) for _ in range(800)]
    df = spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(data)],
                               "id bigint, gold array<string>, pred array<string>")
    want = counts_of(data)
    assert as_table(spans.chunk_counts(df)) == want
    matched = spans.chunk_table(df, ["id"]).groupBy("type").agg(
        F.sum(F.col("in_gold") * F.col("in_pred")).alias("correct"), F.sum("in_gold").alias("gold"),
        F.sum("in_pred").alias("pred"))
    assert as_table(matched) == want
    for counts in want.values():
        assert counts["correct"] <= min(counts["gold"], counts["pred"])


@pytest.mark.parametrize("bits,levels", [(1, 0), (2, 2), (12, 0)])
def test_one_stream_over_many_rows(spark, bits, levels):
    """Chunks run over rows and over buckets, empty rows and rows without events lie between."""
    rng = random.Random(bits)
    data = []
    for _ in range(150):
        if rng.random() < 0.5:
            same = ["I-X"] * rng.randint(0, 3)
            data.append((same, list(same)))
        else:
            data.append(pair(rng, rng.randint(0, 5)))
    df = spark.createDataFrame([(3 * i, g, p) for i, (g, p) in enumerate(data)],
                               "id bigint, gold array<string>, pred array<string>")
    want = counts_of([([t for g, _ in data for t in g], [t for _, p in data for t in p])])
    assert as_table(spans.chunk_counts_flat(df, ["id"], bits=bits, levels=levels)) == want


def test_streams_by_key(spark):
    rng = random.Random(8)
    data = [(k, i, *pair(rng, 4)) for k in "ab" for i in range(30)]
    df = spark.createDataFrame(data, "k string, id bigint, gold array<string>, pred array<string>")
    got = spans.chunk_counts_flat(df, ["id"], keys=["k"], bits=2).collect()
    for key in "ab":
        mine = [(g, p) for k, _, g, p in data if k == key]
        want = counts_of([([t for g, _ in mine for t in g], [t for _, p in mine for t in p])])
        assert {r["type"]: {c: r[c] for c in ("correct", "gold", "pred")} for r in got if r["k"] == key} == want


def test_invalid_tags_count_nothing_and_are_reported(spark):
    df = spark.createDataFrame([(0, ["NOUN", "O"], ["O", "O"]), (1, ["B-X"], ["B-X"])],
                               "id int, gold array<string>, pred array<string>")
    assert as_table(spans.chunk_counts(df)) == {"X": {"correct": 1, "gold": 1, "pred": 1}}
    assert [(r["id"], r["valid"]) for r in spans.invalid_rows(df).collect()] == [(0, False)]


def test_summary_without_entities_is_null(spark):
    df = spark.createDataFrame([(0, ["O", "O"], ["O", "O"])], "id int, gold array<string>, pred array<string>")
    row = metrics.evaluation_summary(df).collect()
    assert len(row) == 1 and row[0]["type"] == "ALL"
    assert row[0]["accuracy"] == 100.0 and row[0]["accuracy_inside"] is None and row[0]["f1"] == 0.0
    lines = [r["line"] for r in metrics.report_lines(metrics.evaluation_summary(df)).collect()]
    assert lines[0].startswith("processed 2 tokens with 0 phrases") and "undefined" in lines[1]


def test_separators_count_as_tokens(spark):
    df = spark.createDataFrame([(0, ["B-X"], ["B-X"]), (1, ["O"], ["B-X"])],
                               "id int, gold array<string>, pred array<string>")
    plain = metrics.evaluation_summary(df).where("type = 'ALL'").first()
    with_blank = metrics.evaluation_summary(df, separators=True).where("type = 'ALL'").first()
    assert (plain["tokens"], plain["accuracy"]) == (2, 50.0)
    assert (with_blank["tokens"], with_blank["accuracy"]) == (4, 75.0)
