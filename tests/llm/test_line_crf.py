"""The line field against all label paths, numeric slopes, plain counting and held-out labels."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from helpers import TEXTS, documents
from pyspark.sql import functions as F

from lexiloom.llm import line_crf
from lexiloom.llm.texts import bytes_of

SOME = ["one\ntwo words\n\nTHREE!! MORE!!", "", "\n", "a a a b 12 ...", "Ünï | wörd |\nx### y%%%\nend", "x" * 5000 + "\n" + "tail " * 3]


def parts(texts):
    buf, off = bytes_of(pa.array(texts, pa.string()))
    lines = line_crf.cut_lines(buf, off)
    return buf, off, lines, line_crf.features(line_crf.bins(buf, lines), lines)


def model(seed=1):
    rng = np.random.default_rng(seed)
    return line_crf.Model(rng.normal(0, 0.3, line_crf.FEATURES), rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2))


def test_lines_are_those_of_split():
    buf, off, lines, _ = parts([*SOME, None])
    raw = bytes(buf)
    got = [[raw[a : a + n] for a, n in zip(lines.start[i:j], lines.size[i:j])] for i, j in zip(lines.first[:-1], lines.first[1:])]
    assert got == [(t or "").encode().split(b"\n") for t in [*SOME, None]]


def plain_bins(line):
    words = line.split()
    share = lambda a, b: 11 if b and a >= b else 0 if not b or not a else 1 + min(int(a / b * 10), 9)
    letters, symbol = line_crf.LETTER, line_crf.SYMBOL
    abc = sum(bool(letters[c]) for c in line)
    return [min(int(np.log2(len(line) + 1)), 15), share(abc, len(line)), share(sum(65 <= c < 91 for c in line), abc),
            share(sum(48 <= c < 58 for c in line), len(line)), share(sum(bool(symbol[c]) for c in line), len(line)),
            min(int(sum(map(len, words)) / max(len(words), 1)), 15), share(len(set(words)), len(words)),
            share(sum(a == b for a, b in itertools.pairwise(words)), len(words)), share(sum(not any(letters[c] for c in w) for w in words), len(words)),
            share(sum(len(w) > 2 and bool(symbol[w[-1]] and symbol[w[-2]]) for w in words), len(words)), share(sum(65 <= w[0] < 91 for w in words), len(words))]


def test_bins_are_counted_plainly():
    texts = [*SOME, *[t for _, t, _ in TEXTS if t]]
    buf, _, lines, index = parts(texts)
    got = line_crf.bins(buf, lines).tolist()
    assert got == [plain_bins(x) for t in texts for x in t.encode().split(b"\n")]
    k = len(line_crf.STATS)
    assert (index[:, :k] - np.arange(k) * line_crf.BINS == np.array(got)).all()
    assert (index[lines.first[:-1], k : 2 * k] == -1).all() and (index[lines.first[1:] - 1, 2 * k : 3 * k] == -1).all()


def test_marginals_and_likelihood_equal_all_paths():
    _, _, lines, index = parts(SOME)
    m = model()
    score = np.append(m.weight, 0)[index].sum(1)
    got = line_crf.marginals(m, index, lines)
    total = 0.0
    good = np.array([0, 1, 1, 0, 1, 0])
    for d, (a, b) in enumerate(zip(lines.first[:-1], lines.first[1:])):
        paths = list(itertools.product((0, 1), repeat=b - a))
        s = np.array([m.start[p[0]] + sum(score[a + i] * y for i, y in enumerate(p)) + sum(m.step[x, y] for x, y in itertools.pairwise(p)) for p in paths])
        log_z = np.logaddexp.reduce(s)
        want = [np.exp(s[[p[i] == 1 for p in paths]] - log_z).sum() for i in range(b - a)]
        assert np.allclose(got[a:b], want)
        total += s[paths.index((good[d],) * (b - a))] - log_z
    value, _ = line_crf.likelihood(m, index, lines, good)
    assert np.isclose(value, total / len(good))


def test_slopes_are_numeric_slopes():
    _, _, lines, index = parts(SOME)
    good, m, h = np.array([0, 1, 1, 0, 1, 0]), model(2), 1e-6
    _, slope = line_crf.likelihood(m, index, lines, good)
    for k in [int(i) for i in np.unique(index) if i >= 0][::7]:
        up, down = m.weight.copy(), m.weight.copy()
        up[k], down[k] = up[k] + h, down[k] - h
        diff = line_crf.likelihood(m._replace(weight=up), index, lines, good)[0] - line_crf.likelihood(m._replace(weight=down), index, lines, good)[0]
        assert np.isclose(diff / (2 * h), slope.weight[k], atol=1e-5)
    for name in ("step", "start"):
        for at in np.ndindex(getattr(m, name).shape):
            up, down = getattr(m, name).copy(), getattr(m, name).copy()
            up[at], down[at] = up[at] + h, down[at] - h
            diff = line_crf.likelihood(m._replace(**{name: up}), index, lines, good)[0] - line_crf.likelihood(m._replace(**{name: down}), index, lines, good)[0]
            assert np.isclose(diff / (2 * h), getattr(slope, name)[at], atol=1e-5)


def test_quality_is_the_mean_of_marginals_by_length():
    lines, p, quality = line_crf.label_texts(model(), pa.array([*SOME, None], pa.string()))
    for d, (a, b) in enumerate(zip(lines.first[:-1], lines.first[1:])):
        assert np.isclose(quality[d], ((lines.size[a:b] + 1) * p[a:b]).sum() / (lines.size[a:b] + 1).sum())


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    m = line_crf.fit(docs.where(~held_out), labels.where(~held_out))
    found = line_crf.predict(docs.where(held_out).drop("lang", "source"), m).join(labels, "doc_id").select("score", "quality").collect()
    assert len(found) > 50 and {r["quality"] for r in found} == {0, 1}
    right = {q: np.mean([(r["score"] >= 0.3) == q for r in found if r["quality"] == q]) for q in (0, 1)}
    assert right[0] >= 0.9 and right[1] >= 0.97
    rows = line_crf.label_lines(docs.where(held_out), m, keep=["doc_id"]).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("good").cast("int")).alias("g")).collect()
    share = {r["quality"]: r["g"] for r in rows}
    assert share[0] < 0.2 and share[1] > 0.9


def test_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(3, 1), (5, 0), (5, 1), (8, 1), (10, 0), (13, 0), (None, 1), (99, 1), (7, None)], "doc_id long, quality int")
    m = line_crf.fit(docs, labels, steps=30)
    found = line_crf.predict(docs, m)
    assert found.columns == [*[c for c in docs.columns if c != "score"], "score"]
    rows = found.collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(v) == 1 for v in by.values())
    again = line_crf.fit(docs.repartition(7), labels.repartition(3), steps=30)
    assert np.allclose(m.weight, again.weight)
    assert line_crf.predict(documents(spark, []), m).collect() == []
    lines = line_crf.label_lines(docs, m, keep=["doc_id"])
    assert lines.count() == sum((t or "").count("\n") + 1 for _, t, _ in TEXTS)


@pytest.mark.parametrize("rows", [[], [(3, None)]])
def test_without_labels_every_score_is_one_half(spark, rows):
    m = line_crf.fit(documents(spark), spark.createDataFrame(rows, "doc_id long, quality int"))
    assert {round(r["score"], 9) for r in line_crf.predict(documents(spark), m, keep=["doc_id"]).collect()} == {0.5}
