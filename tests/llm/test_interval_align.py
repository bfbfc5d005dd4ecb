"""Alignment of two tokenizers against loops over tokens."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from helpers import TEXTS, documents
from tokenizers import Tokenizer

from lexiloom.llm import interval_align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(text, tools):
    """[(id, bytes)] of both sides, or None."""
    t, sp = tools
    value = interval_align.byte_values()
    a = [(i, bytes(value[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in sp.encode(text):
        name = sp.id_to_piece(i)
        b.append((i, bytes([int(name[3:5], 16)]) if sp.is_byte(i) else name.replace("▁", " ").encode()))
    want = (" " + text).encode()
    if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
        return None
    return a, b


def spans(side):
    out, at = [], 0
    for i, x in side:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def plain(texts, tools):
    rows, links = [], []
    for text in texts:
        found = tokens(text, tools) if text else None
        if not found:
            rows.append([0, 0, 0, 0, ""])
            links.append([])
            continue
        a, b = spans(found[0]), spans(found[1])
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        parts, low = [], 0
        for cut in cuts:
            one = [",".join(str(i) for i, s, e in side if low <= s and e <= cut) for side in (a, b)]
            parts.append("|".join(one))
            low = cut
        mine, j = [], 0
        for i, s, e in a:
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                mine.append((i, b[k][0]))
                k += 1
        links.append(mine)
        rows.append([len(a), len(b), len(cuts), len(mine), hashlib.sha256(";".join(parts).encode()).hexdigest()])
    n = Counter(p for mine in links for p in set(mine))
    best = {}
    for (x, _), c in n.items():
        best[x] = max(best.get(x, 0), c)
    return [(*row[:4], sum(n[p] == best[p[0]] for p in mine), sum(n[p] for p in mine), row[4]) for row, mine in zip(rows, links)]


MORE = ["", " ", "  two  spaces ", "a▁b", "tab\tand\r\nline", "x" * 3000, "<|endoftext|> inside <s> and </s>", "😀 ünïcode 日本語 ٣", " nbsp　 wide",
        "null\0byte", "é é", "the cat sat", "the cat sat", "The Cat, sat.", "don't can't won't", "a\n\n\nb", " lead", "trail ", "1234567890 3.14"]


def check(got, texts, tools):
    want = plain(texts, tools)
    assert sorted(got, key=repr) == sorted(want, key=repr)


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("head", [interval_align.HEAD, 40, 0])
def test_equals_loops_over_tokens(spark, tools, head):
    rows = [(i, t[:5000] if t else t, "en") for i, (_, t, _) in enumerate(TEXTS)] + [(100 + i, t, None) for i, t in enumerate(MORE)] + [(None, "the cat sat", None)] * 20
    df = interval_align.score(documents(spark, rows), A, B, head=head)
    assert df.columns == ["doc_id", *COLUMNS[:4], "n_best", "count_sum", "groups_sha256"]
    got = df.collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    check([tuple(r[c] for c in COLUMNS) for r in got], [r[1] for r in rows], tools)


def test_real_documents(spark, tools, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = [r["text"] for r in docs.select("text").collect()]
    check([tuple(r[c] for c in COLUMNS) for r in interval_align.score(docs, A, B, head=2000).collect()], texts, tools)


def test_groups_of_intervals():
    start, end = np.array([0, 3, 5, 0, 2, 5]), np.array([3, 5, 9, 2, 5, 9])
    assert interval_align.groups(start, end).tolist() == [0, 0, 1, 0, 0, 1]
    a, b = interval_align.overlaps(start[:3], end[:3], start[3:], end[3:])
    assert list(zip(a.tolist(), b.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2)]


def test_a_long_group_costs_its_links_alone(tools):
    """Tokens of four bytes shifted by one never end together: as many groups as one, links in proportion to the tokens."""
    n = 100_000
    a_end, b_end = np.minimum(np.arange(n) * 4 + 1, 4 * n - 4), np.arange(1, n) * 4
    a_end = np.unique(a_end)
    a_start, b_start = np.concatenate([[0], a_end[:-1]]), np.concatenate([[0], b_end[:-1]])
    assert len(set(interval_align.groups(np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])).tolist())) == 1
    at_a, _ = interval_align.overlaps(a_start, a_end, b_start, b_end)
    assert len(at_a) < 3 * n


def test_words_met_before_give_the_same_pieces(tools):
    _, sp = tools
    coder = interval_align.Pieces(B, kept=3)
    for text in [*MORE, *[t for _, t, _ in TEXTS if t]] * 2:
        ids, per = coder.encode(pa.array([text, "and more", text]))
        assert ids.tolist() == [*sp.encode(text), *sp.encode("and more"), *sp.encode(text)]
        assert per.tolist() == [len(sp.encode(text)), len(sp.encode("and more")), len(sp.encode(text))]


def test_empty_table(spark):
    assert interval_align.score(documents(spark, []), A, B).collect() == []
