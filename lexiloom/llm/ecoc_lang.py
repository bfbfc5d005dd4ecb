"""Language identification by error-correcting output codes.

Every language has a codeword of bits, one binary classifier per bit. For up to five languages the code is exhaustive:
all ways to cut the languages in two; beyond, random rows far apart. A bit's classifier is a naive Bayes log odds of
byte bigrams and trigrams of the lower-cased text, centred between the languages it has to tell apart. Decoding is
loss-weighted: a bit counts by how far apart its two sides lie, and the codeword of the least logistic loss wins. A
text whose second codeword is nearly as near is flagged ambiguous.

Fitting counts n-grams of at most about ``FIT_ROWS`` labelled texts per language, whole, chosen by a hash; counts are
added up by Spark, and the driver sees one number per language and feature (at most ``FEATURES`` each). Prediction is
one pass over the text without a shuffle.

Cases: a null text and a text without a letter are ``und`` with score 0; without any labelled text every other text
gets a null language; equal rows are predicted alike; ties go to the first language in order; other columns pass
through. Texts of any length are read whole, in runs of n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import bytes_of, pieces, returned

FIT_ROWS = 20_000
PAIRS = TRIPLES = 1 << 16
FEATURES = PAIRS + TRIPLES
RUN = 1 << 17
#: loss between the two best codewords below which a text is ambiguous
MARGIN = 0.5
SMOOTH = 0.5
UNKNOWN = "und"

#: bytes below 128 that are no letters count as space
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[c for c in range(128) if not chr(c).isalpha()]] = 32


class Model(NamedTuple):
    langs: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # features x bits
    centre: np.ndarray
    scale: np.ndarray
    trust: np.ndarray


def codewords(k: int) -> np.ndarray:
    """k codewords of +1 and -1: exhaustive up to five languages, else random with a large least distance."""
    if k <= 5:
        cuts = [[1, *(-1 if c >> i & 1 else 1 for i in range(k - 1))] for c in range(1, 2 ** max(k - 1, 0))]
        return np.array(cuts, np.int8).reshape(len(cuts), k).T
    rng, bits, best, far = np.random.default_rng(7), 10 * int(np.ceil(np.log2(k))), None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (k, bits))
        gap = min(int((code[i] != np.delete(code, i, 0)).sum(1).min()) for i in range(k))
        if gap > far and (abs(code.sum(0)) < k).all():
            best, far = code, gap
    return best


def _features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bigram, trigram, text) indexes of every position, run by run. Every text has a space before and after."""
    low = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    space = pa.scalar(" ", pa.large_string())
    buf, off = bytes_of(pc.binary_join_element_wise(space, low, space, pa.scalar("", pa.large_string())))
    for at in range(0, len(buf) - 2, RUN):
        b = PLAIN[buf[at : at + RUN + 2]].astype(np.uint32)
        doc = np.searchsorted(off, np.arange(at, at + len(b) - 2), "right") - 1
        inside = np.arange(at, at + len(b) - 2) + 2 < off[doc + 1]
        two = b[:-2] << 8 | b[1:-1]
        three = ((two << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)
        yield two[inside], three[inside], doc[inside]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for rows in pieces(batch, limit=1 << 20):
            coded = rows.column("lang").dictionary_encode()
            names, of = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            for two, three, doc in _features(rows.column("text")):
                lang = of[doc]
                for i in np.unique(lang).tolist():
                    mine = lang == i
                    found = total.setdefault(names[i], np.zeros(FEATURES, np.int64))
                    found[:PAIRS] += np.bincount(two[mine], minlength=PAIRS)
                    found[PAIRS:] += np.bincount(three[mine], minlength=TRIPLES)
    for name, found in total.items():
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "feature": pa.array(at, pa.int32()),
                                          "n": pa.array(found[at], pa.int64())})


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on the rows of ``labelled`` (text, lang) in which neither is null."""
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if langs:
        share = F.create_map(*[F.lit(x) for name in langs for x in (name, min(1.0, fit_rows / sizes[name]))])[F.col("lang")]
        # equal texts are drawn one by one: the draw also depends on the row's place
        draw = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1 << 30)) / (1 << 30)
        counts = (rows.where(draw < share).mapInArrow(returned(_count), "lang string, feature int, n long")
                  .groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas())
    p = np.full((len(langs), FEATURES), SMOOTH)
    if langs:
        p[np.searchsorted(langs, counts["lang"].to_numpy(str)), counts["feature"].to_numpy()] += counts["n"].to_numpy(float)
    for part in (slice(0, PAIRS), slice(PAIRS, None)):
        p[:, part] /= p[:, part].sum(1, keepdims=True)
    code = codewords(len(langs))
    weights, centre, scale, trust = [], [], [], []
    for bit in code.T:
        odds = (np.log(p[bit > 0].mean(0)) - np.log(p[bit < 0].mean(0))) / 2
        mean = p @ odds  # what a text of each language gets on average
        high, low = mean[bit > 0].min(), mean[bit < 0].max()
        gap = max(high - low, 1e-6)
        weights.append(odds)
        centre.append((high + low) / 2)
        scale.append(8 / gap)
        trust.append(gap)
    trust = np.array(trust) / max(float(np.mean(trust)), 1e-9) if trust else np.zeros(0)
    table = np.array(weights, np.float32).reshape(len(trust), FEATURES).T
    return Model(langs, code, np.ascontiguousarray(table), np.array(centre), np.array(scale), trust)


def decode(model: Model, mean: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword, its score from 0 to 1, and whether another is nearly as near, from mean log odds of n n-grams."""
    out = (mean - model.centre) * model.scale * (n / (n + 12))[:, None]
    loss = (np.logaddexp(0, -out[:, None, :] * model.code[None]) * model.trust).sum(2)
    best = loss.argmin(1)
    least = np.sort(loss, 1)
    near = least[:, 1] - least[:, 0] < MARGIN if loss.shape[1] > 1 else np.zeros(len(n), bool)
    return best, 1 / np.exp(least[:, :1] - loss).sum(1), near


def _predict_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        two_w, three_w = model.weights[:PAIRS], model.weights[PAIRS:]
        for batch in batches:
            for rows in pieces(batch.select(["text"]), limit=8 << 20) if batch.num_rows else ():
                texts = rows.column("text")
                letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                total, n = np.zeros((len(texts), model.code.shape[1])), np.zeros(len(texts))
                for two, three, doc in _features(texts):
                    if len(doc):
                        at = np.flatnonzero(np.diff(doc, prepend=-1))
                        total[doc[at]] += np.add.reduceat(two_w[two] + three_w[three], at, axis=0)
                        n[doc[at]] += np.diff(at, append=len(doc))
                if model.langs:
                    best, score, near = decode(model, total / np.maximum(n, 1)[:, None], n)
                    name = np.array(model.langs, object)[best]
                else:
                    name, score, near = np.full(len(texts), None), np.zeros(len(texts)), np.ones(len(texts), bool)
                name = np.where(letters, name, UNKNOWN)
                yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(np.where(letters, score, 0.0)),
                                                  pa.array(near | ~letters)], names=["lang_pred", "score", "ambiguous"])

    return run


def _with_columns(task, columns):
    """Put what a task finds for the texts beside the batch's other columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.Table.from_batches(task(iter([batch])), _FOUND).combine_chunks()
            arrays = [batch.column(i) for i, f in enumerate(batch.schema) if f.name in columns]
            names = [f.name for f in batch.schema if f.name in columns]
            new = [found.column(i).combine_chunks() for i in range(3)]
            yield pa.RecordBatch.from_arrays(arrays + new, names=names + _FOUND.names)

    return run


_FOUND = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with lang_pred, score and ambiguous, which take the place of columns of those names."""
    kept = docs.drop(*_FOUND.names)
    kept = kept if text == "text" else kept.withColumn("text", F.col(text))
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("ambiguous", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features x bits: fixed by the number of languages
    return kept.mapInArrow(returned(_with_columns(_predict_task(shared), set(kept.columns))), schema)
