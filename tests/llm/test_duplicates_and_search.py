"""Near duplicates, line chunks, decontamination and top-k, each against brute force."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from helpers import PASSAGE, TEXTS, documents, tokens
from pyspark.sql import functions as F

from lexiloom.llm import gray_simhash, impact_topk, line_chunks, queries, window_decontam


def fingerprint(text):
    words = tokens(text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(near):
    label = np.arange(len(near))
    while not np.array_equal(label, least := np.array([label[row].min() for row in near])):
        label = least
    return label


@pytest.mark.parametrize("n", [2, 40, 400, 3000])
@pytest.mark.parametrize("words", [1, 2])
def test_gray_search(n, words):
    rng = np.random.default_rng(n)
    centre = rng.integers(0, 2**63, (max(n // 20, 1), words), dtype=np.uint64)
    codes = centre[rng.integers(0, len(centre), n)]
    for _ in range(3):
        codes[np.arange(n), rng.integers(0, words, n)] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    codes = np.unique(codes, axis=0)
    rank = codes[:, 0].copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    codes = codes[np.argsort(rank)]
    want = closure(np.bitwise_count(codes[:, None] ^ codes[None]).sum(axis=2) <= 4)
    assert np.array_equal(gray_simhash.search(codes, 4), want)
    assert np.array_equal(gray_simhash.bucket_links(np.zeros(len(codes), np.int64), codes, 4), want)


@pytest.mark.parametrize("split", [gray_simhash.SPLIT, 2])
def test_components_of_codes(spark, split):
    """Chains and clusters of codes: the links, also of buckets dealt out again, join what is within the radius."""
    rng = np.random.default_rng(5)
    codes = [int(x) for x in rng.integers(0, 2**62, 12)]
    for c in list(codes):
        for _ in range(12):
            c ^= sum(1 << int(b) for b in rng.choice(63, 4, replace=False))
            codes.append(c)
    codes = sorted(set(codes))
    near = np.array([[bin(a ^ b).count("1") <= 4 for b in codes] for a in codes])
    want = {codes[i]: codes[j] for i, j in enumerate(closure(near))}
    df = spark.createDataFrame([(c, c) for c in codes], "fp long, v long")
    got = {r["v"]: r["root"] for r in gray_simhash.components(gray_simhash.links(df, split=split)).collect()}
    assert {c: got.get(c, c) for c in codes} == want


def test_near_duplicates(spark):
    rows = TEXTS + [(20, "The cat sat on the mat and looked at the dog\nanother line of words to make up the second line", "en")]
    got = gray_simhash.near_duplicates(documents(spark, rows)).collect()
    prints = [fingerprint(t) for _, t, _ in rows]
    label = closure(np.array([[bin(a ^ b).count("1") <= 4 for b in prints] for a in prints]))
    smallest = {g: min((rows[i][0] for i in range(len(rows)) if label[i] == g and rows[i][0] is not None), default=None) for g in set(label)}
    want = Counter((r[0], p, smallest[g]) for r, p, g in zip(rows, prints, label))
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == want
    assert gray_simhash.near_duplicates(documents(spark, [])).count() == 0


def test_wide_codes_find_similar_texts(spark):
    rng = np.random.default_rng(9)
    made = []
    for g in range(30):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        made.append((2 * g, " ".join(words), "en"))
        words[100] = words[200] = "changed"
        made.append((2 * g + 1, " ".join(words), "en"))
    got = gray_simhash.near_duplicates(documents(spark, made), 5, 10, words=4, limit=46).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(d, d - d % 2) for d, _, _ in made}


def test_verified_near_duplicates_are_all_pairs_of_the_similarity(spark):
    """Components of verified links are those of all pairs of texts by their sets of five-word shingles."""
    rng = np.random.default_rng(9)
    made = []
    for g in range(30):  # four changed words of 300: similarity about 0.87
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        made.append((2 * g, " ".join(words), "en"))
        words[50] = words[100] = words[150] = words[200] = "changed"
        made.append((2 * g + 1, " ".join(words), "en"))
    for g in range(30, 42):  # from 0.6 to 0.85
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        for k in range(6):
            other = list(words)
            for at in rng.choice(60, 2 + 2 * (k % 5), replace=False).tolist():
                other[5 * at] = f"x{at}_{k}"
            made.append((100 + 6 * g + k, " ".join(other), "en"))
    line = " ".join(f"line{k}" for k in range(9))
    for k in range(2):  # a repeated line outvotes all else, and has a small part in the sets
        own = [f"own{k}_{x}" for x in range(700)]
        made.append((1000 + k, " ".join(own[:350]) + "\n" + (line + "\n") * 34 + " ".join(own[350:]), "en"))
    same = " ".join(f"s{x}" for x in range(200))
    made += [(1010, same + " " + (line + " ") * 3, "en"), (1011, same + " " + (line + " ") * 60, "en"), (1012, "", "en"), (1013, None, "en"), (1014, "few words", "en")]
    made += [(None, made[0][1], "en")]
    sets = []
    for _, text, _ in made:
        w = tokens(text)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    near = np.array([[a == b or len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    label = closure(near)
    want = {made[i][0]: min(made[k][0] for k in np.flatnonzero(label == label[i]) if made[k][0] is not None) for i in range(len(made))}
    got = gray_simhash.near_duplicates(documents(spark, made), 5, words=4, limit=72, similarity=0.8).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(made)
    assert all(want[2 * g + 1] == 2 * g for g in range(30)) and want[1001] == 1001 and want[1011] == 1010
    assert len({want[100 + 6 * g + k] for g in range(30, 42) for k in range(6)}) not in (12, 72)


def brute_chunks(rows):
    """Texts without the lines of repeated chunks, in the order of doc_id and line, and the chunks."""
    spans, owner, places = {}, {}, {}
    for i, (_, text, _) in enumerate(rows):
        lines = (text or "").split("\n")
        found = line_chunks.Chunks(pa.array([text]))
        spans[i] = {(a, a + n) for a, n in zip(found.line.tolist(), found.lines.tolist())}
        for a, b in spans[i]:
            words = [len(x.encode().split()) for x in lines[a:b]]
            assert sum(words) >= 50 or (b - a > 1 and sum(words) >= 10)
        for a in range(len(lines)):  # the shortest run of 50 words from every line with words
            b = next((b for b in range(a + 1, len(lines) + 1) if len(" ".join(lines[a:b]).encode().split()) >= 50), None)
            assert b is None or not lines[a].encode().split() or (a, b) in spans[i]
    for i in sorted(spans, key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
        for a, b in sorted(spans[i]):
            chunk = "\n".join(rows[i][1].split("\n")[a:b])
            owner.setdefault(chunk, (rows[i][1], a))
            places.setdefault(chunk, set()).add((rows[i][1], a))
    out = []
    for i, (doc_id, text, _) in enumerate(rows):
        lines = (text or "").split("\n")
        again, stay, gone = set(), set(), set()
        for a, b in spans[i]:
            chunk = "\n".join(lines[a:b])
            if len(places[chunk]) > 1:
                (stay if owner[chunk] == (text, a) else again if owner[chunk][0] == text else gone).update(range(a, b))
        kept = [x for k, x in enumerate(lines) if k not in gone and (k not in again or k in stay)]
        out.append((doc_id, None if text is None else "\n".join(kept)))
    return out


def test_line_chunks(spark):
    lines = [f"line {k} with some words that fill it {k * 7}" for k in range(12)]
    shared = "\n".join(lines)
    pair = "\n".join(" ".join(f"{c}{k}" for k in range(30)) for c in "pq")
    rows = TEXTS + [(30, "before\n" + shared + "\nafter", "en"), (31, shared, "en"), (32, "x y z\nother start\n" + shared + "\n" + PASSAGE, "en"),
                    (33, PASSAGE + "\n" + PASSAGE + "\nshort", "en"), (34, "a b\n" * 40, "en"), (35, "a\n" + pair + "\nb", "en"),
                    (36, "c d\n\n" + pair + "\n\ne", "en"), (37, pair + "\n" + pair, "en"), (38, pair.split("\n")[0] + "\nalone", "en"),
                    (39, "a first line\n" + PASSAGE, "en"), (40, "a first line\n" + PASSAGE + "\n" + "z " * 9, "en")]
    got = line_chunks.dedup(documents(spark, rows))
    assert got.columns == [*(c for c in documents(spark, []).columns if c != "removed"), "removed"]
    got = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(brute_chunks(rows))
    assert {r["doc_id"] for r in got if r["removed"]} >= {9, 31, 32, 33}
    by = {r["doc_id"]: r["text"] for r in got}
    assert PASSAGE not in by[9] and PASSAGE not in by[33] and by[3] == by[5]
    assert by[35] == "a\n" + pair + "\nb" and by[36] == "c d\n\n\ne" and by[37] == "" and by[38].endswith("\nalone")
    assert by[39] == "a first line" and PASSAGE not in by[40]
    assert line_chunks.dedup(documents(spark, [])).count() == 0


def brute_whole(rows):
    """Texts without the lines of chunks that an earlier row holds, whatever its text, and of what a row repeats itself."""
    owner, places, out = {}, {}, []
    spans = [sorted({(a, a + n) for a, n in zip(c.line.tolist(), c.lines.tolist())}) for c in (line_chunks.Chunks(pa.array([r[1]])) for r in rows)]
    lines = [(r[1] or "").split("\n") for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][2:]))
    for i in order:
        for a, b in spans[i]:
            owner.setdefault("\n".join(lines[i][a:b]), (i, a))
            places.setdefault("\n".join(lines[i][a:b]), set()).add((rows[i][1], a))
    for i in range(len(rows)):
        fate = {}
        for a, b in spans[i]:
            chunk = "\n".join(lines[i][a:b])
            at = owner[chunk]
            if at[0] == i and len(places[chunk]) == 1:  # only copies hold it: the first row is as if alone
                continue
            rank = 2 if at[0] != i else 1 if at[1] == a else 0
            fate |= {k: max(rank, fate.get(k, 0)) for k in range(a, b)}
        kept = [x for k, x in enumerate(lines[i]) if fate.get(k, 1) == 1]
        out.append((rows[i][0], None if rows[i][1] is None else "\n".join(kept), *rows[i][2:]))
    return out


def test_chunks_of_whole_copies_go_too(spark):
    """Copies under other ids, rows that come twice, rows without an id: one of the equal texts keeps its lines."""
    text = ["\n".join(f"{c} line {k} with some words that fill it {k * 7}" for k in range(9)) for c in "pqr"]
    twice = text[0] + "\nend\n" + text[0]
    rows = [(4, text[0]), (2, text[0]), (2, text[0]), (9, text[0]), (3, "start\n" + text[1] + "\nx"), (5, text[1]), (6, text[1]), (None, text[1]),
            (None, text[2]), (None, text[2]), (1, twice), (7, twice), (8, "short"), (10, "short"), (11, None), (11, None), (12, ""), (13, PASSAGE), (14, PASSAGE)]
    got = line_chunks.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), copies=True)
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(brute_whole(rows))
    assert {r["doc_id"]: r["text"] for r in got.collect()}[14] == ""
    named = [(d, t, k % 2, f"n{k}") for k, (d, t) in enumerate(rows)]  # of equal texts and ids the first by the other columns stays
    got = line_chunks.dedup(spark.createDataFrame(named, "doc_id long, text string, `_doc` long, `_text_key` string"), copies=True)
    assert Counter(tuple(r)[:4] for r in got.collect()) == Counter(brute_whole(named))
    assert line_chunks.dedup(spark.createDataFrame([], "doc_id long, text string"), copies=True).count() == 0


def test_query_takes_out_whole_copies(spark, tmp_path):
    text = "\n".join(f"line {k} with some words that fill it {k * 7}" for k in range(9))
    spark.createDataFrame([(1, text), (2, text), (2, text), (3, "own\n" + text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["removed"] > 0, r["kept_chars"]) for r in queries.op8_line_chunks(spark, str(tmp_path)).collect())
    assert [r[:2] for r in got] == [(1, False), (2, True), (2, True), (3, True)] and got[0][2] == len(text)


def test_equal_hashes_with_other_bytes_stay():
    rows = [{"hash": 1, "text": t, "first_null": False, "first_doc": d, "first_key": d, "first_line": 0,
             "members": [{"doc_id": d, "text_key": d, "line": 0, "lines": 2}]} for d, t in ((1, b"a"), (2, b"b"), (3, b"a"))]
    got = [r for b in line_chunks._repeats(iter([pa.RecordBatch.from_pylist(rows, schema=line_chunks._OCCURRENCES)])) for r in b.to_pylist()]
    assert [(r["doc_id"], r["fate"]) for r in got] == [(1, line_chunks.STAYS), (2, line_chunks.STAYS), (3, line_chunks.GOES)]


def similarity(a, b):
    common = sum(min(v, b[g]) for g, v in a.items())
    return common / (sum(a.values()) + sum(b.values()) - common)


def bag(grams):
    out = Counter()
    for g in grams:
        out[g] += sum(map(len, g))
    return out


def brute_leaks(docs, items):
    want = {}
    for d, text, _ in docs:
        w = tokens(text)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        for i, item in items:
            v = tokens(item)
            own = [tuple(v[k : k + 5]) for k in range(len(v) - 4)]
            if own and set(own) & set(grams):
                best = max((similarity(bag(grams[s : s + len(own)]), bag(own)) for s in range(len(grams) - len(own) + 1)), default=0)
                if best >= 0.8:
                    want[d, i] = best
    return want


@pytest.mark.parametrize("block_bytes", [window_decontam.BLOCK_BYTES, 200])
def test_decontamination(spark, block_bytes):
    rng = np.random.default_rng(2)
    words = [f"v{k}" for k in range(400)]
    items = [(i, " ".join(rng.choice(words, n))) for i, n in enumerate((5, 12, 30, 30, 60))] + [(9, "too short"), (10, None), (11, ""), (None, "no id here at all ok")]
    near = items[4][1].split()
    near[30] = "other"
    docs = [(1, "start " + items[0][1] + " end", "en"), (2, " ".join(rng.choice(words, 50)) + " " + items[2][1] + " " + items[1][1], "en"),
            (3, "a b c " + " ".join(near) + " d", "en"), (4, items[4][1].upper(), "en"), (5, " ".join(items[3][1].split()[:15]), "en"),
            (6, (items[2][1] + " ") * 3 + "z " * 5000, "en"), (None, items[1][1], "en"), *TEXTS[:8]]
    benchmark = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, doc_id string")
    got = window_decontam.contaminated(documents(spark, docs), benchmark, block_bytes=block_bytes).collect()
    want = brute_leaks(docs, [(i, t) for i, t in items if i is not None and t])
    assert {(r["doc_id"], r["item_id"]): pytest.approx(r["similarity"]) for r in got} == want and len(got) == len(want) >= 7
    w = tokens(docs[2][1])
    row = next(r for r in got if r["doc_id"] == 3)
    assert w[row["first_word"] : row["first_word"] + row["n_words"]] == [x.encode() for x in near]
    assert window_decontam.contaminated(documents(spark, []), benchmark).count() == 0
    assert window_decontam.contaminated(documents(spark, docs), benchmark.limit(0)).count() == 0


def test_decontamination_of_short_documents_and_items_without_id(spark):
    """Documents smaller than an item are compared whole; items without an id count by text."""
    rng = np.random.default_rng(6)
    items = [(1, " ".join(f"p{x}" for x in rng.integers(0, 900, 59))), (2, " ".join(f"q{x}" for x in rng.integers(0, 900, 59))),
             (None, " ".join(f"r{x}" for x in range(25))), (None, " ".join(f"s{x}" for x in range(25))), (3, "one two three four five six")]
    own = [t.split() for _, t in items]
    docs = [(1, " ".join(own[0][:-2]), "en"), (2, " ".join(own[1][:30] + own[1][31:]), "en"), (3, " ".join(own[0][:40]), "en"),
            (4, "before " + items[2][1] + " after", "en"), (5, " ".join(own[3][1:]), "en"), (6, "one two three four five", "en"),
            (7, " ".join(own[1][3:-3]), "en"), (8, " ".join(own[0][:-2]) + " x y z", "en"), (9, items[2][1] + " then " + items[3][1], "en"), *TEXTS[:4]]
    want = Counter()
    for d, text, _ in docs:
        w = tokens(text)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        for i, item in items:
            v = tokens(item)
            its = [tuple(v[k : k + 5]) for k in range(len(v) - 4)]
            size = min(len(its), len(grams))
            best = max((similarity(bag(grams[s : s + size]), bag(its)) for s in range(len(grams) - size + 1)), default=0)
            want[d, i, round(best, 9)] += best >= 0.8
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = window_decontam.contaminated(documents(spark, docs), benchmark).collect()
    assert Counter((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in got) == +want
    assert {(1, 1), (2, 2), (4, None), (5, None), (7, 2)} <= {(r["doc_id"], r["item_id"]) for r in got} and sum(want.values()) >= 8
    row = next(r for r in got if r["doc_id"] == 1)
    assert (row["first_word"], row["n_words"]) == (0, 57)


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    index = window_decontam.build(list(range(50)), [" ".join(f"a{x}" for x in rng.integers(0, 99, 20)) for _ in range(50)])
    codes = index.code[rng.integers(0, 50, 300)]
    for _ in range(15):
        codes ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    w, i, apart = window_decontam.near(index, 16, codes, 15)
    far = np.bitwise_count(codes[:, None] ^ index.code[None])
    assert {(a, b) for a, b in zip(w, i)} == {(a, b) for a, b in zip(*np.nonzero(far <= 15))} and (far[w, i] == apart).all()


@pytest.mark.parametrize("candidates", [8192, 7])
def test_top_k(spark, candidates):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 6)]) for i in range(130)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (220, rows[0][1]), (None, rows[0][1]), (240, None), (260, [None] * 6), (280, [float("nan")] * 6),
             (300, [float("inf")] * 6), (320, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    vectors = df.select(F.col("vec_id").alias("id"), impact_topk.integers(F.col("embedding")).alias("vector"), "score")
    got = impact_topk.top_k(vectors, F.col("id") % 20 == 0, 5, candidates, 3).collect()
    clean = {i: np.floor(64 * np.array(v)).astype(int) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = {(q, r + 1, c, int(s)) for q in clean if q % 20 == 0
            for r, (s, c) in enumerate(sorted(((clean[q] @ v, c) for c, v in clean.items() if c != q), key=lambda x: (-x[0], x[1]))[:5])}
    assert {tuple(r) for r in got} == want
    assert impact_topk.top_k(vectors.limit(0), F.col("id") % 20 == 0).count() == 0
    alone = impact_topk.top_k(vectors.where("id in (0, 3)"), F.col("id") % 20 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in alone] == [(0, 1, 3)]


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    """Two vectors of id 20: each is the other's candidate, no row is its own, and each has its ranking."""
    rows = [(20, [9, 0]), (20, [0, 9]), (21, [1, 1]), (22, [5, 0])]
    df = spark.createDataFrame(rows, "id long, vector array<long>")
    for candidates in (2, 8192):
        got = sorted(map(tuple, impact_topk.top_k(df, F.col("id") == 20, candidates=candidates, k=3).collect()))
        assert got == sorted([(20, 1, 22, 45), (20, 2, 21, 9), (20, 3, 20, 0), (20, 1, 21, 9), (20, 2, 20, 0), (20, 3, 22, 0)])


def test_pairs_left_out_by_the_reference_are_not_similar():
    rng = np.random.default_rng(8)
    base = rng.choice(5000, 300, replace=False)
    sets = [set(np.where(rng.random(300) < rate, rng.integers(5000, 9000, 300), base).tolist()) for rate in rng.uniform(0, 0.5, 120)]
    sets += [set(), set(base.tolist()), set(base[:100].tolist())]
    n = np.array([len(x) for x in sets])
    held = np.zeros((len(sets), gray_simhash.REFERENCE), np.uint8)
    held[:, :300] = [[b in x for b in base.tolist()] for x in sets]
    bits, m = np.packbits(held, axis=1).view(np.uint64), held.sum(1, dtype=np.int64)
    i, j = np.triu_indices(len(sets), 1)
    can = gray_simhash.may_be_similar(n, m, bits, i, j, 0.8)
    real = np.array([len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9 for a, b in zip(i, j)])
    assert (can | ~real).all() and can.sum() < 0.5 * len(i) and real.sum() > 50


def test_pairs_that_met_go_no_further_unless_they_can_be_similar(spark):
    """300 sets of one group share 60 of 100 elements, a similarity of 0.43: no pair of them is sent, those of 0.82 or more are."""
    rng = np.random.default_rng(3)
    common = rng.integers(-(1 << 62), 1 << 62, 60).tolist()
    made = [common + rng.integers(-(1 << 62), 1 << 62, 40).tolist() for _ in range(300)]
    made += [made[k][:-10] + rng.integers(-(1 << 62), 1 << 62, 10).tolist() for k in (0, 1)] + [made[2] + [1, 2]]
    sets = spark.createDataFrame([(v, sorted(x)) for v, x in enumerate(made)], "v long, grams array<long>")
    groups = spark.createDataFrame([(v, 0) for v in range(len(made))], "v long, loose long")
    met = spark.createDataFrame([(v, 250) for v in range(250)], "a long, b long")
    seen = gray_simhash.against_reference(groups, met, sets)
    codes = seen.select("*", F.col("v").alias("part"), *[F.lit(0).cast("long").alias(name) for name in gray_simhash.word_names(4)])
    got = {frozenset(r) for r in gray_simhash.links(codes, 4, 0, 72, masks=16, every=True, similarity=0.8).collect()}
    assert got >= {frozenset(x) for x in ((0, 300), (1, 301), (2, 302))} and len(got) < 100


def test_the_parity_of_a_set_never_leaves_out_a_similar_pair():
    rng = np.random.default_rng(4)
    for size in (5, 60, 400, 3000):  # fewer elements than bits, and many more
        base = rng.choice(1 << 40, size, replace=False)
        made = [set(np.where(rng.random(size) < rate, rng.integers(1 << 40, 1 << 41, size), base).tolist()) for rate in rng.uniform(0, 0.3, 60)]
        odd = np.stack([np.bincount(np.array(list(x)) % gray_simhash.PARITY, minlength=gray_simhash.PARITY) % 2 for x in made]).astype(np.uint8)
        n, m, bits = np.array([len(x) for x in made]), np.zeros(60, np.int64), np.zeros((60, 1), np.uint64)
        i, j = np.triu_indices(60, 1)
        can = gray_simhash.may_be_similar(n, m, bits, i, j, 0.8, np.packbits(odd, axis=1).view(np.uint64))
        real = np.array([len(made[a] & made[b]) >= 0.8 * len(made[a] | made[b]) - 1e-9 for a, b in zip(i, j)])
        assert (can | ~real).all() and real.any() and (size > 400 or can.sum() < len(i))


def test_the_central_entry_of_a_component():
    codes = np.array([[0b1111, 0], [0b0111, 0], [0b0110, 1], [0b0111, 3], [9, 9]], np.uint64)
    assert gray_simhash.central(np.array([0, 0, 0, 0, 4]), codes).tolist() == [1, 1, 1, 1, 4]
