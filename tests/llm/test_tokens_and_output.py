"""Token ids, the word-aligned code, packing and shards, each against a plain computation."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import TEXTS, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexiloom.llm import cost_packing, hilbert, texts, tokens, word_aligned

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
BITS = [" ", "  ", "\n", "\n\n", "a", "Foo", "bar.", "x,", "<|endoftext|>", "don't", "12", "é", "İ", "ΑΣ", "́", "　", "\x85", "\x1c", "\t",
        "\r\n", "日本", ".\n", "Zeb.", "q\nR", "\xa0", "ﬁ", "'s"]


@pytest.mark.parametrize(("path", "spaceless"), [(WORD, True), (BYTE, False)])
def test_ids_equal_the_tokenizers(path, spaceless):
    rng = random.Random(3)
    made = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + [t for _, t, _ in TEXTS[:12] if t]
    for kept in (500, tokens.KEPT):  # with and without starting anew
        coder = tokens.Encoder(path, spaceless, kept)
        for _ in range(2):
            ids, per = coder.encode(pa.array(made))
            want = [x.ids for x in coder.tokenizer.encode_batch(made, add_special_tokens=False)]
            assert ids.tolist() == [i for x in want for i in x]
            assert per.tolist() == list(map(len, want))


def test_words_and_hashes():
    made = ["a b A  c", None, "", " \n", "x" * (2 * texts.SEGMENT + 5) + " b", "b " * texts.SEGMENT]
    w = texts.words(*texts.bytes_of(pa.array(made)))
    plain = [(i, x) for i, t in enumerate(made) for x in (t or "").encode().lower().split()]
    assert w.doc.tolist() == [i for i, _ in plain]
    by = {}
    for h, (_, x) in zip(w.hash.tolist(), plain):
        assert by.setdefault(x, h) == h
    assert len(set(by.values())) == len(by)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 3) | st.integers(0, 50000), max_size=1500))
def test_code_round_trip(values):
    values = np.array(values, np.uint64)
    coded = word_aligned.encode(values)
    assert np.array_equal(word_aligned.decode(coded), values)
    assert np.array_equal(word_aligned.decode(coded, 1, 2), values[word_aligned.BLOCK : 2 * word_aligned.BLOCK])


def test_damaged_segment_is_refused():
    with pytest.raises(ValueError):
        word_aligned.decode(b"x" * 64)


def test_output_in_order_of_ids(spark, tmp_path):
    path = str(tmp_path / "ids")
    word_aligned.write(documents(spark), path, WORD, 2, spaceless=True, segment_ids=5000)
    got = word_aligned.read(spark, path).collect()
    coder = Tokenizer.from_file(WORD)
    plain = sorted(((d, [*coder.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, _ in TEXTS), key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], zlib.crc32(r["ids"])) for r in got) == sorted(
        (d is not None, d or 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in plain)
    in_order = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in in_order] == [d for d, _ in plain]
    assert [r["start"] for r in in_order] == np.cumsum([0, *(len(x) for _, x in plain)])[:-1].tolist()
    assert word_aligned.read(spark, path, F.col("last_doc") < 0).count() == 0


def test_output_of_no_documents(spark, tmp_path):
    path = str(tmp_path / "none")
    word_aligned.write(documents(spark, []), path, WORD, 2, spaceless=True)
    assert word_aligned.read(spark, path).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_packing_keeps_every_id_once(spark, parts):
    got = cost_packing.pack(documents(spark).coalesce(1).repartition(parts), BYTE, 1, group_tokens=6000).collect()
    coder = Tokenizer.from_file(BYTE)
    want = sorted(np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for _, t, _ in TEXTS)
    by_doc = {}
    for r in got:
        assert len(r["ids"]) == 4 * r["length"]
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for rows in sequences.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0  # full, or a power of two: no padding
    assert sum(r["length"] for r in got) == sum(len(x) // 4 for x in want)
    single = [x for k, x in by_doc.items() if k[0] not in (7,)]
    assert all(b"".join(ids for _, ids in sorted(x)) in want for x in single)


def test_balance_takes_the_cheapest_sequence_with_room():
    placed, rest = cost_packing.balance(np.array([60, 50, 40, 30, 20]), 100)
    assert [(p[0], p[3]) for p in placed] == [(0, 0), (1, 1), (2, 1), (3, 0)] and rest == [(4, 0, 10)] or sum(p[2] for p in placed) == 200
    load = {s: sum(p[2] for p in placed if p[3] == s) for s in (0, 1)}
    assert load == {0: 100, 1: 100} and sum(r[2] for r in rest) == 0
    assert cost_packing.balance(np.array([3, 0, 4]), 100) == ([], [(0, 0, 3), (2, 0, 4)])


def test_packing_of_no_documents(spark):
    assert cost_packing.pack(documents(spark, []), BYTE, 1).count() == 0
    with pytest.raises(ValueError):
        cost_packing.pack(documents(spark, []), BYTE, 1, length=100)


def test_hilbert_curve_visits_neighbours():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    order = hilbert.hilbert_index(cells, 3)
    assert sorted(order) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(order)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("rows", [TEXTS, TEXTS * 5, []])
def test_shards_differ_by_one_row(spark, rows):
    docs = documents(spark, rows)
    dims = {"size_cell": hilbert.level(F.octet_length("text")), "lang_cell": hilbert.place(F.col("lang"))}
    got = hilbert.shards(docs, dims, 4).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    if rows:
        assert set(slots) == {0, 1, 2, 3} and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
        want = sorted((r[0] or 0, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
        assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == want
        in_order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
        assert [r["hilbert"] for r in in_order] == sorted(r["hilbert"] for r in got)
        ends = hilbert.pruning(hilbert.shards(docs, dims, 4), list(dims)).collect()
        assert sum(r["n_rows"] for r in ends) == len(rows)
