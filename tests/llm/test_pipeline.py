"""The registered queries of this subpackage, and the pipeline against its own parts."""

import os
import sys

import pytest
from helpers import PASSAGE, TEXTS, documents

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import __spark_entry__ as driver  # noqa: E402
import check  # noqa: E402
import corpus_pipeline  # noqa: E402

from lexiloom.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, folder, name):
    assert name in driver.queries()
    assert check.compare(spark, check.oracle(folder), folder, name).startswith(("ok", "rows-only"))


def folder_of(spark, tmp_path, rows, items):
    documents(spark, rows).select("doc_id", "text", "lang").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_take_effect(spark, tmp_path):
    words = [f"t{k}" for k in range(300)]
    clean = [(100 + i, " ".join(words[i * 90 : i * 90 + 90]) + f"\nown line {i}", "en") for i in range(3)]
    near = clean[0][1].replace("t45 ", "changed ")
    leak = " ".join(f"item{k}" for k in range(20))
    rows = [*clean, (200, near, "en"), (201, "before the " + leak + " after", "en"), (202, clean[1][1], "en"), (203, "123 ...", "en"), (204, None, "en"),
            (205, "some words here\n" + PASSAGE, "en"), (206, "other words there\n" + PASSAGE, "en"), (207, PASSAGE, "en"), (207, PASSAGE, "en")]
    d = folder_of(spark, tmp_path, rows, [(1, leak)])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / f"out{k}")
        stage(spark, docs, d).write.parquet(out)
        docs = spark.read.parquet(out)
        if name != "pack":
            assert docs.columns == ["doc_id", "text", "lang"]
            kept.append(sorted(r["doc_id"] for r in docs.collect()))
    ids = [100, 101, 102, 200, 201, 202, 205, 206, 207, 207]
    assert kept[0] == ids
    lines = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "out1")).collect()}
    assert lines[205] == rows[8][1] and lines[206] == "other words there" and 207 not in lines
    assert kept[2] == [100, 101, 102, 201, 205, 206]
    assert kept[3] == [100, 101, 102, 205, 206]
    assert {r["doc_id"] for r in docs.collect()} == set(kept[3])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, d).collect()} == set(kept[3])


def test_decontamination_takes_rows_not_ids(spark, tmp_path):
    """A leak goes alone: other rows without an id or with the same id stay, equal rows go together."""
    leak = " ".join(f"item{k}" for k in range(20))
    rows = [(None, "a clean text without an id", "en"), (None, "before " + leak, "en"), (None, None, "en"), (7, leak + " after", "en"),
            (7, leak + " after", "en"), (7, "another text of the same id", "en"), (8, "clean", "en")]
    d = folder_of(spark, tmp_path, rows, [(1, leak)])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = corpus_pipeline.decontaminate(spark, docs, d)
    assert got.columns == docs.columns
    assert {tuple(r) for r in got.collect()} == {rows[k] for k in (0, 2, 5, 6)} and got.count() == 4


CLASHES = ("_doc", "_key", "_chunks", "_text_key", "_row", "key", "row", "rest", "fp", "v", "component", "removed", "a.b")


def test_columns_of_any_name_pass_all_stages(spark, tmp_path):
    rows = [(i, f"text number {i} " + " ".join(f"w{i}x{k}" for k in range(30)) + "\n" + PASSAGE, "en", *[f"{c}{i}" for c in CLASHES]) for i in range(4)]
    rows += [(3, rows[3][1], "en", *["zz"] * len(CLASHES))]
    names = ["doc_id", "text", "lang", *[c for c in CLASHES if c not in ("a.b", "removed")]]
    docs = spark.createDataFrame([r[: len(names)] for r in rows], ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names))
    spark.createDataFrame([(1, " ".join(f"item{k}" for k in range(20)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.columns == names
    got = {r["doc_id"]: r for r in docs.collect()}
    assert len(got) == docs.count() == 4
    for i in range(4):  # of the two rows of id 3 the first by its other columns stays
        assert [got[i][c] for c in names[3:]] == [f"{c}{i}" for c in names[3:]]


@pytest.mark.parametrize("rows", [TEXTS, []])
def test_awkward_and_empty_tables(spark, tmp_path, rows):
    d = folder_of(spark, tmp_path, rows, [])
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, d).select("doc_id").distinct().collect()}
    assert got == ({None, 3, 8, 9, 11, 12, 13, 14, 15} if rows else set())
