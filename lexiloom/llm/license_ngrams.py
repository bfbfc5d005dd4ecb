"""Licence notices in documents, by a trained paragraph classifier.

A paragraph is a line. Its features are the word n-grams (one to three words, A-Z folded, punctuation as space) that
occur in the notices below; other words have no weight, so a notice inside a long paragraph reads as well as one alone.
A multinomial logistic regression with an unknown class is fitted to pieces and mixtures of the notices and to
paragraphs of a bounded sample of the documents (``SAMPLE`` rows of up to ``SAMPLE_BYTES``); small weights are set to
zero. A temperature fitted on rows kept apart calibrates its probabilities, the unknown class's among them. A predicted
paragraph is then compared with its family's notices: the share of a notice's n-grams of two and three words that the
paragraph holds confirms the prediction.

Prediction is one pass without a shuffle; the model, of a size fixed by the notices, is broadcast.

Cases: null and blank texts have no paragraphs; every paragraph of a document may be found, equal rows alike; a null
``doc_id`` passes through; an empty table gives no row (and a model without sampled paragraphs); ties go to the first
family in order; other columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import LOWER, U64, bytes_of, ngrams, pieces, words

SAMPLE, SAMPLE_BYTES = 1000, 20_000
ORDERS = (1, 2, 3)
CONFIRM, LIKELY = 0.6, 0.5
SIEVE = 1 << 20
#: weights nearer to zero than this are dropped
LEAST_WEIGHT = 0.02

#: fixed values: notices by which licences are commonly declared
NOTICES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
             "Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only"],
    "all-rights-reserved": ["All rights reserved", "Copyright. All rights reserved", "No part of this publication may be reproduced without the prior written permission of the publisher"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
                   "Released under the Apache 2.0 license", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Released under the BSD 3-Clause License", "Licensed under the BSD license", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
            "This work is dedicated to the public domain under CC0 1.0 Universal"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 2",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "SPDX-License-Identifier: GPL-3.0-or-later"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1-or-later",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mit": ["Released under the MIT License", "Licensed under the MIT License", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
}
UNKNOWN = "unknown"

#: letters and digits, folded; line ends stay; all other ASCII is space
PLAIN = LOWER.copy()
PLAIN[[c for c in range(128) if not chr(c).isalnum() and c != 10]] = 32


class Model(NamedTuple):
    families: list[str]  # and UNKNOWN last
    grams: np.ndarray  # sorted hashes of the features
    weights: np.ndarray  # features x classes
    bias: np.ndarray
    temperature: float
    sieve: np.ndarray
    notices: list[tuple[str, str, np.ndarray]]  # family, text, its n-grams of two and three words


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document, paragraph within it, and order of every n-gram; n-grams stay inside a paragraph."""
    buf, off = bytes_of(texts)
    w = words(PLAIN[buf], off, lower=False)
    breaks = np.flatnonzero(buf == 10)
    line = np.searchsorted(breaks, w.start) - np.searchsorted(breaks, off[:-1])[w.doc]
    place = w.doc.astype(np.int64) << 32 | line
    found = [(w.hash, np.arange(len(w.hash)))] + [ngrams(w.hash, place, n) for n in ORDERS[1:]]
    at = np.concatenate([x[1] for x in found])
    order = np.repeat(ORDERS, [len(x[0]) for x in found])
    return np.concatenate([x[0] for x in found]), w.doc[at], line[at], order


def _matrix(texts: list[str], grams: np.ndarray) -> np.ndarray:
    g, doc, _, _ = features(pa.array(texts, pa.string()))
    at = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
    hit = grams[at] == g
    out = np.zeros((len(texts), len(grams)), np.float32)
    out[doc[hit], at[hit]] = 1
    return out


def _examples(rng: np.random.Generator) -> tuple[list[str], list[int]]:
    """Notices, long pieces of them, and mixtures with missing words; short pieces are examples of the unknown class."""
    texts, labels = [], []
    for label, notices in enumerate(NOTICES.values()):
        for notice in notices:
            parts = notice.split()
            texts.append(notice)
            labels.append(label)
            for _ in range(24):
                keep = max(2, int(np.ceil(len(parts) * rng.uniform(0.7, 1))))
                start = rng.integers(0, len(parts) - keep + 1)
                piece = [p for p in parts[start : start + keep] if keep < 6 or rng.random() > 0.05]
                texts.append(" ".join(piece))
                labels.append(label)
            for _ in range(12):
                keep = rng.integers(1, max(2, len(parts) // 3 + 1))
                start = rng.integers(0, len(parts) - keep + 1)
                texts.append(" ".join(parts[start : start + keep]))
                labels.append(len(NOTICES))
    return texts, labels


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, steps: int = 150) -> Model:
    """Fit to the notices and to paragraphs of about ``sample`` documents."""
    short = docs.where(F.octet_length("text") <= sample_bytes).select(F.col("text").cast("string").alias("text"))
    n = short.count()
    drawn = short.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(n, 1)))).limit(2 * sample)
    plain = [line for r in drawn.collect() for line in r["text"].split("\n") if line.strip()]
    families = [*NOTICES, UNKNOWN]
    known = [(family, text, _long_grams(text)) for family, texts in NOTICES.items() for text in texts]
    vocabulary, of, _, order = features(pa.array([k[1] for k in known], pa.string()))
    # single words of several families, mostly words of any text, say nothing
    family = np.array([families.index(k[0]) for k in known])[of]
    single = np.unique(np.stack([vocabulary[order == 1], family[order == 1].astype(np.uint64)]), axis=1)[0]
    single, n_families = np.unique(single, return_counts=True)
    grams = np.union1d(vocabulary[order > 1], single[n_families == 1])
    x = _matrix(plain, grams) if plain else np.zeros((0, len(grams)), np.float32)
    # a sampled paragraph that holds a notice is no example of the unknown class; one without any feature says nothing
    held = np.zeros(len(plain), bool)
    for _, _, own in known:
        held |= x[:, np.searchsorted(grams, own)].mean(axis=1) >= CONFIRM
    x = np.unique(x[~held], axis=0)[: 4 * sample]
    rng = np.random.default_rng(11)
    texts, labels = _examples(rng)
    x = np.concatenate([_matrix(texts, grams), x, np.zeros((1, len(grams)), np.float32)])
    y = np.array(labels + [len(NOTICES)] * (len(x) - len(labels)))
    apart = rng.random(len(x)) < 0.25
    weights, bias = _logistic(x[~apart], y[~apart], len(families), steps)
    weights[np.abs(weights) < LEAST_WEIGHT] = 0
    # calibration: the temperature of least loss on the rows kept apart
    z = x[apart] @ weights + bias
    loss = {t: -np.log(_softmax(z / t)[np.arange(len(z)), y[apart]] + 1e-12).mean() for t in np.geomspace(0.2, 5, 33)}
    used = np.abs(weights).sum(axis=1) > 0
    sieve = np.zeros(SIEVE, bool)
    sieve[grams[used] & U64(SIEVE - 1)] = True
    return Model(families, grams[used], weights[used], bias, float(min(loss, key=loss.get)), sieve, known)


def _logistic(x: np.ndarray, y: np.ndarray, classes: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Full-batch multinomial regression with classes weighted alike, by Adam."""
    w, b = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32)
    weight = (1 / np.bincount(y, minlength=classes).clip(1))[y].astype(np.float32)
    weight /= weight.sum()
    target = np.eye(classes, dtype=np.float32)[y]
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, steps + 1):
        error = (_softmax(x @ w + b) - target) * weight[:, None]
        for k, (value, slope) in enumerate(((w, x.T @ error + 1e-5 * w), (b, error.sum(axis=0)))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            value -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w, b


def _long_grams(text: str) -> np.ndarray:
    grams, _, _, order = features(pa.array([text], pa.string()))
    return np.unique(grams[order > 1])


FOUND = "doc_id long, paragraph int, family string, probability double, notice string, similarity double, confirmed boolean"
_FOUND = pa.schema([("doc_id", pa.int64()), ("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()),
                    ("notice", pa.string()), ("similarity", pa.float64()), ("confirmed", pa.bool_())])


def classify(model: Model, texts: pa.Array) -> list[tuple[int, int, str, float, str, float]]:
    """(text, paragraph, family, probability, nearest notice, similarity) of every paragraph taken for a notice."""
    grams, doc, line, order = features(texts)
    at = np.flatnonzero(model.sieve[grams & U64(SIEVE - 1)])
    place = np.minimum(np.searchsorted(model.grams, grams[at]), max(len(model.grams) - 1, 0))
    hit = model.grams[place] == grams[at]
    at, place = at[hit], place[hit]
    if not len(at):
        return []
    # each feature counts once per paragraph
    where = doc[at].astype(np.int64) << 32 | line[at]
    pair = np.unique(np.stack([where, place]), axis=1)
    paragraph, back = np.unique(pair[0], return_inverse=True)
    z = np.zeros((len(paragraph), len(model.families)))
    first = np.flatnonzero(np.append(True, back[1:] != back[:-1]))
    z[:] = np.add.reduceat(model.weights[pair[1]].astype(np.float64), first, axis=0) + model.bias
    p = _softmax(z / model.temperature)
    best = p.argmax(axis=1)
    found = np.flatnonzero((best < len(model.families) - 1) & (p.max(axis=1) >= LIKELY))
    if not len(found):
        return []
    long = np.flatnonzero(order > 1)
    all_at = doc[long].astype(np.int64) << 32 | line[long]
    mine = np.isin(all_at, paragraph[found])
    held, at_held = grams[long][mine], all_at[mine]
    out = []
    for i in found.tolist():
        own = held[at_held == paragraph[i]]
        family = model.families[best[i]]
        share, notice = max(((float(np.isin(g, own).mean()) if len(g) else 0.0, text) for f, text, g in model.notices if f == family),
                            key=lambda s: s[0])
        out.append((int(paragraph[i] >> 32), int(paragraph[i] & 0xFFFFFFFF), family, float(p[i, best[i]]), notice, share))
    return out


def _scan_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces(batch, limit=2 << 20):
                ids = rows.column("doc_id").to_pylist()
                found = classify(shared.value, rows.column("text"))
                if found:
                    yield pa.RecordBatch.from_pylist(
                        [{"doc_id": ids[d], "paragraph": line, "family": family, "probability": p, "notice": notice, "similarity": share,
                          "confirmed": share >= CONFIRM} for d, line, family, p, notice, share in found], schema=_FOUND)

    return run


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """One row per paragraph taken for a licence notice, confirmed or not."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_scan_task(docs.sparkSession.sparkContext.broadcast(model)), FOUND)
