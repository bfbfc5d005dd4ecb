import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import labels, metrics, vocab
from lexiloom.plans import inputs, tagging

TEXTS = ["", " \t", None, ".", "a longword. second sentence here\n\n.third", "...leading dots, abcdefghijk abcdefghijkl\r\nx überlangää  odd",
         "\U0001f600\U0001f600\U0001f600\U0001f600\U0001f600\U0001f600\U0001f600 seventy1 seventy2 seventy3 seventy4 elevenchars nøne", "a\x0bb c\x00d. ." * 3,
         " ".join("wordsize" * (1 + i % 3) for i in range(40)), "twentytwo" * 2 + "four abcdefg hijklmn opqrstu vwxyzab cdefghi jklmnop"]


def plain(doc_id, text):
    import re

    def tagged(kinds):
        return ["O" if k is None else ("I-" if i and kinds[i - 1] == k else "B-") + k for i, k in enumerate(kinds)]

    for sent, piece in enumerate(re.split("[.\n]+", text) if text is not None else []):
        tokens = [t for t in re.split("[ \t\r]+", piece) if t]
        gold = [inputs.TYPES[i // 4 % 4] if len(t) >= 7 else None for i, t in enumerate(tokens)]
        pred = [None if g is None or len(t) % 5 == 4 else "LOC" if len(t) % 11 == 0 else g for t, g in zip(tokens, gold)]
        if tokens:
            yield doc_id, sent, tokens, tagged(gold), tagged(pred)


@pytest.mark.parametrize("size", [1, 2 << 20])
def test_tagged_sentences_are_those_of_the_plain_rule(spark, tmp_path, size, monkeypatch):
    rows = [*enumerate(TEXTS), (None, "no id here, somewords"), (4, TEXTS[4])]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    frame = inputs.tagged_sentences(spark, str(tmp_path))
    assert frame.columns == ["doc_id", "sent", "tokens", "gold", "pred"]
    want = [r for d, t in rows for r in plain(d, t)]
    assert sorted(map(repr, map(tuple, frame.collect()))) == sorted(map(repr, want))
    monkeypatch.setattr(inputs, "TAGGED_BYTES", size)
    batch = spark.read.parquet(f"{tmp_path}/documents.parquet").toArrow().combine_chunks().to_batches()
    cut = [tuple(r.values()) for b in inputs._tagged_batches(iter(batch)) for r in b.to_pylist()]
    assert sorted(map(repr, cut)) == sorted(map(repr, want))
    assert "ArrowEvalPython" not in frame._jdf.queryExecution().toString() and frame.where("false").count() == 0


def test_a_summary_tags_its_rows_once(spark):
    rows = spark.createDataFrame([(["B-A", "O"], ["B-A", "O"]), (["B-B"], ["O"])], "gold array<string>, pred array<string>")
    summary = metrics.evaluation_summary(rows)
    assert summary._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + \
        summary._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") <= 2
    got = {r["type"]: (r["overall"], r["correct"], r["gold"], r["pred"], r["tokens"]) for r in summary.collect()}
    assert got == {"A": (False, 1, 1, 1, None), "B": (False, 0, 1, 0, None), "ALL": (True, 1, 2, 1, 3)}
    assert [tuple(r)[:5] for r in metrics.evaluation_summary(rows.limit(0)).collect()] == [(True, "ALL", 0, 0, 0)]


def test_chosen_sentences_meet_the_rows_without_a_shuffle(spark):
    rows = spark.createDataFrame([(i, ["B-A", "I-A", "O"]) for i in range(40)], "sent_id bigint, tags array<string>")
    chosen = labels.kshot(rows, 3, ["sent_id"])
    assert "SortMergeJoin" not in chosen._jdf.queryExecution().executedPlan().toString()
    assert "ResolvedHint (strategy=broadcast)" in chosen._jdf.queryExecution().analyzed().toString()
    assert sorted(r["sent_id"] for r in chosen.collect()) == [0, 1, 2]


def test_a_callers_tokenizer_gets_bounded_pieces(spark, monkeypatch):
    monkeypatch.setattr(vocab, "BATCH_CHARS", 50)
    seen = []

    class Rows:
        def mapInPandas(self, fn, schema):
            texts = pd.DataFrame({"doc_id": range(30), "text": [None, "x" * 20, "y" * 70] * 10})
            return list(fn(iter([texts, texts.iloc[:0]])))

    def words(batches):
        for batch in batches:
            seen.append(sum(len(t) for t in batch["text"] if t))
            yield batch

    made = pd.concat(vocab.tokenize_with(Rows(), words, ""))
    assert made["doc_id"].tolist() == list(range(30)) and len(seen) > 5 and max(seen) <= 50 + 70


def test_sentences_to_be_cut_by_a_vocabulary_are_tagged_once(spark, folder):
    frame = tagging.QUERIES["subword_vocab_labels"](spark, folder)
    assert "MapInArrow" not in frame._jdf.queryExecution().optimizedPlan().toString() and frame.count() > 0
