"""Language identification, licence notices and the language model."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import TEXTS, documents, tokens
from pyspark.sql import functions as F

from lexiloom.llm import ecoc_lang, elias_fano_lm, license_ngrams

SAMPLES = {"en": "the dog and the cat are in the house with what they thought", "fr": "le chien et le chat sont dans la maison avec ce qu'ils pensaient",
           "de": "der hund und die katze sind in dem haus mit dem was sie dachten", "es": "el perro y el gato están en la casa con lo que pensaban",
           "it": "il cane e il gatto sono nella casa con quello che pensavano", "nl": "de hond en de kat zijn in het huis met wat zij dachten"}


@pytest.mark.parametrize("k", [1, 2, 3, 5, 6, 20])
def test_codewords_are_apart(k):
    code = ecoc_lang.codewords(k)
    assert code.shape[0] == k and len({tuple(r) for r in code}) == max(1, k if code.shape[1] else 1)
    if k > 2:
        assert min((code[i] != code[j]).sum() for i in range(k) for j in range(i)) >= 2


@pytest.mark.parametrize("langs", [["en"], ["en", "fr"], list(SAMPLES)])
def test_languages(spark, langs):
    rows = [(i, " ".join(np.random.default_rng(i).permutation(SAMPLES[x].split())), x) for i, x in enumerate(langs * 30)]
    model = ecoc_lang.fit(documents(spark, rows[: len(langs) * 20]))
    got = ecoc_lang.predict(documents(spark, rows[len(langs) * 20 :]), model)
    assert got.where("lang <> lang_pred").count() == 0
    assert got.columns[-3:] == ["lang_pred", "score", "ambiguous"]


def test_language_of_awkward_texts(spark):
    model = ecoc_lang.fit(documents(spark))
    got = ecoc_lang.predict(documents(spark), model).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1 and (letters or r["score"] == 0)
    assert ecoc_lang.predict(documents(spark, []), model).count() == 0
    none = ecoc_lang.predict(documents(spark), ecoc_lang.fit(documents(spark, []))).collect()
    assert {r["lang_pred"] for r in none} == {None, "und"}


def test_language_does_not_depend_on_where_a_text_stands():
    model = ecoc_lang.Model(["a", "b"], ecoc_lang.codewords(2), np.random.default_rng(0).normal(0, 1, (ecoc_lang.FEATURES, 1)).astype(np.float32),
                            np.zeros(1), np.ones(1), np.ones(1))

    class Shared:
        value = model

    made = [t for _, t, _ in TEXTS]
    run = ecoc_lang._predict_task(Shared)
    both = [r for b in run(iter([pa.RecordBatch.from_pydict({"text": pa.array(made)})])) for r in b.to_pylist()]
    one = [r for t in made for b in run(iter([pa.RecordBatch.from_pydict({"text": pa.array([t], pa.string())})])) for r in b.to_pylist()]
    assert [r["lang_pred"] for r in both] == [r["lang_pred"] for r in one]
    assert np.allclose([r["score"] for r in both], [r["score"] for r in one], atol=1e-4)


@pytest.fixture(scope="module")
def licences(spark):
    return license_ngrams.fit(documents(spark))


def test_licence_families(licences):
    found = {}
    for family, notices in license_ngrams.NOTICES.items():
        for notice in notices:
            for text in (notice, "wob lers " * 200 + notice.upper() + " gub nel" * 200):
                rows = license_ngrams.classify(licences, pa.array([text]))
                found[text] = [(r[2], r[5] >= license_ngrams.CONFIRM) for r in rows] == [(family, True)]
    assert sum(found.values()) >= 0.97 * len(found)
    plain = ["The license to drive was granted.", "All rights of passage", "permission is granted to any person", "a public domain", "", None, " \n "]
    assert license_ngrams.classify(licences, pa.array(plain)) == []


def test_licence_scan(spark, licences):
    rows = [*TEXTS, (50, "first\nReleased under the MIT License.\nlast\nAll rights reserved.", "en"), (None, "Licensed under CC BY-NC 4.0.", "en"),
            (50, "first\nReleased under the MIT License.\nlast\nAll rights reserved.", "en")]
    got = Counter((r["doc_id"], r["paragraph"], r["family"], r["confirmed"]) for r in license_ngrams.scan(documents(spark, rows), licences).collect())
    assert got == {(50, 1, "mit", True): 2, (50, 3, "all-rights-reserved", True): 2, (None, 0, "cc-by-nc", True): 1}
    # brute force: the same weights, one n-gram at a time
    for text in [t for _, t, _ in rows if t and len(t) < 1000]:
        for line in text.split("\n"):
            g, _, _, _ = license_ngrams.features(pa.array([line]))
            held = [int(np.searchsorted(licences.grams, x)) for x in set(g.tolist()) if x in set(licences.grams.tolist())]
            z = (licences.bias + sum((licences.weights[i] for i in held), np.zeros(len(licences.families)))) / licences.temperature
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            family = licences.families[int(p.argmax())]
            want = [] if not held or family == "unknown" or p.max() < license_ngrams.LIKELY else [family]
            assert [r[2] for r in license_ngrams.classify(licences, pa.array([line]))] == want
    assert license_ngrams.scan(documents(spark, []), licences).count() == 0
    assert license_ngrams.fit(documents(spark, [])).families[-1] == "unknown"


@pytest.mark.parametrize("values", [[], [0], [0, 0, 3, 2**64 - 1], list(range(1000)), [7] * 50])
def test_elias_fano(values):
    values = np.array(values, np.uint64)
    level = elias_fano_lm.EliasFano(memoryview(elias_fano_lm.ef_encode(values)))
    assert np.array_equal(level.get(np.arange(len(values))), values)
    for v in set(values.tolist()) | {1, 500, 2**40}:
        at = level.find(np.array([v], np.uint64))[0]
        assert (at >= 0) == (v in values) and (at < 0 or values[at] == v)


def test_trie_from_a_file(tmp_path):
    word = np.array([5, 9, 2**63], np.uint64)
    data = elias_fano_lm.Trie.build(word, np.array([-1.0, -2.0, -3.0]), np.array([0, 2, 2, 3]), np.array([1, 7, 4], np.uint32), np.array([-0.1, -0.2, -0.3]))
    (tmp_path / "levels").write_bytes(data)
    for trie in (elias_fano_lm.Trie(data), elias_fano_lm.Trie(np.memmap(tmp_path / "levels", np.uint8, "r"))):
        got = trie.log_numerator(np.array([5, 5, 9, 2**63, 6], np.uint64), np.array([7, 2, 7, 4, 1], np.uint32), -9.0)
        assert np.allclose(got, [-0.2, -1.0, -2.0, -0.3, -9.0], atol=1e-4)


@pytest.mark.parametrize("shard_tokens", [elias_fano_lm.SHARD_TOKENS, 2000])
def test_scores(spark, shard_tokens, monkeypatch):
    rows = TEXTS + [(100 + k, " ".join(f"w{x}" for x in np.random.default_rng(k).zipf(1.5, 40) % 300), "en") for k in range(40)]
    learn = F.col("doc_id") % 5 != 0
    got = elias_fano_lm.score(documents(spark, rows), learn, shard_tokens=shard_tokens).collect()
    texts = [[*tokens(t), None] for _, t, _ in rows]
    train = [d is not None and d % 5 != 0 for d, _, _ in rows]
    c, pairs = Counter(), Counter()
    for w, t in zip(texts, train):
        if t:
            c.update(w)
            pairs.update(zip([0, *w[:-1]], w))
    n, v, once, twice = sum(c.values()), len(c), sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    discount, mu = (once + 0.5) / (once + 2 * twice + 1), elias_fano_lm.MU
    want = Counter()
    for (d, _, _), w in zip(rows, texts):
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = sum(math.log10((pairs[p, x] + mu * ((c[x] - discount) / n if c[x] else discount * v / n)) / ((sum(train) if p == 0 else c[p]) + mu))
                    for p, x in zip([0, *w[:-1]], w))
        want[d, len(w), sum(c[x] > 0 for x in w), n, f"{base:.6g}", f"{score:.3g}"] += 1
    found = Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], f"{r['base_score']:.6g}", f"{r['score']:.3g}") for r in got)
    exact = Counter(k[:5] for k in found.elements())
    assert exact == Counter(k[:5] for k in want.elements())
    near = sorted(((k[0] or 0, k[1], float(k[5])) for k in found.elements())), sorted(((k[0] or 0, k[1], float(k[5])) for k in want.elements()))
    assert np.allclose(np.array(near[0]), np.array(near[1]), rtol=0.011)


def test_scores_without_training_or_texts(spark):
    none = elias_fano_lm.score(documents(spark), F.lit(False)).collect()
    assert len(none) == len(TEXTS) and all(r["score"] is None and r["base_score"] is None and r["n_known"] == 0 for r in none)
    assert elias_fano_lm.score(documents(spark, []), F.lit(True)).count() == 0


def test_many_short_texts_in_one_batch(spark):
    """More texts in an Arrow batch than 16 bits can number."""
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "0")
    try:
        docs = spark.range(140_000, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"))
        found = elias_fano_lm.score(docs, F.col("doc_id") % 2 == 0).agg(F.count("*"), F.min("n_known"), F.max("n_known"), F.min("n_tokens"), F.max("n_tokens")).first()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert tuple(found) == (140_000, 2, 2, 2, 2)
