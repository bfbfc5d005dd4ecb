import hashlib
import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexiloom.functions import text
from lexiloom.operators import corpus, labels, ngram, vocab


def test_white_space_is_pythons(spark):
    samples = ["", " ", "\t\n", " ", " 　", "\x1c\x1d", "\x85", " x ", "x \n", "​", "a \n b\t"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    for row in df.select("s", text.is_blank(F.col("s")).alias("b"), text.right_trim(F.col("s")).alias("r")).collect():
        assert row["b"] == (row["s"] == "" or row["s"].isspace()), repr(row["s"])
        assert row["r"] == row["s"].rstrip(), repr(row["s"])


def test_headings_are_tested_before_trimming(spark):
    lines = ["", " = A = ", "= B =", " text", "  = C"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "row_id bigint, text string")
    assert [r["text"] for r in corpus.drop_headings(df).orderBy("row_id").collect()] == lines[2:]
    second = spark.createDataFrame([(0, "more \t")], "row_id bigint, text string")
    both = corpus.two_corpus_documents(df, second, "train").orderBy("corpus_rank", "row_id").collect()
    assert [r["text"] for r in both] == ["= B =", " text", "  = C", "more"]
    assert corpus.two_corpus_documents(df, second, "test").count() == 3


def test_holdout(spark):
    df = spark.range(4000).withColumnRenamed("id", "row_id").withColumn("split", F.lit("train"))
    share = corpus.holdout(df).where("split = 'validation'").count()
    assert 140 < share < 260
    exact = corpus.holdout_exact(df, 0.05)
    assert exact.where("split = 'validation'").count() == 200
    again = corpus.holdout_exact(df.repartition(3), 0.05).where("split = 'validation'")
    assert again.join(exact.where("split = 'validation'"), "row_id").count() == 200
    kept = corpus.split_missing(df.union(spark.sql("SELECT 9999L, 'test'")), has_validation=False)
    assert kept.count() == 4000


def test_shuffle_is_repeatable_and_real(spark):
    df = spark.range(200).withColumnRenamed("id", "row_id")
    first = [r["row_id"] for r in corpus.shuffled(df, 1).collect()]
    assert first == [r["row_id"] for r in corpus.shuffled(df.repartition(5), 1).collect()]
    assert sorted(first) == list(range(200)) != first
    assert first != [r["row_id"] for r in corpus.shuffled(df, 2).collect()]
    placed = corpus.shuffled(df, 1, place="place").collect()
    assert [r["place"] for r in placed] == list(range(200)) and [r["row_id"] for r in placed] == first


def test_vocabulary_and_encoding(spark):
    rng = random.Random(2)
    docs = [(i, ["the"] * rng.randint(0, 6) + [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 9))])
            for i in range(80)]
    docs.append((80, []))
    df = spark.createDataFrame(docs, "row_id bigint, tokens array<string>")
    table = vocab.build_vocab(vocab.token_counts(df), first_id=5).collect()
    assert sorted(r["id"] for r in table) == list(range(5, 5 + len(table)))
    by_id = sorted(table, key=lambda r: r["id"])
    assert by_id[0]["token"] == "the" and all(a["count"] >= b["count"] for a, b in zip(by_id, by_id[1:]))
    small = vocab.build_vocab(vocab.token_counts(df), size=20)
    ids = {r["token"]: r["id"] for r in small.collect()}
    got = {r["row_id"]: r["input_ids"] for r in vocab.encode(df, small).collect()}
    assert got == {i: [ids.get(t, -1) for t in doc] for i, doc in docs}


def test_the_vocabulary_alone_decides_what_has_an_id(spark):
    df = spark.createDataFrame([(0, [f"w{i % (j + 1)}" for i in range(60) for j in range(30)]), (1, ["new"])], "row_id bigint, tokens array<string>")
    counts = vocab.token_counts(df)
    cut = vocab.build_vocab(counts, first_id=5, size=20)
    ids = {r["token"]: r["id"] for r in cut.collect()}
    assert sorted(ids.values()) == list(range(5, 25))
    got = {r["row_id"]: r["input_ids"] for r in vocab.encode(df, cut).collect()}
    assert set(got[0]) == {-1, *range(5, 25)} and got[1] == [-1]
    whole = vocab.encode(df, vocab.build_vocab(counts)).collect()
    assert all(i >= 0 for r in whole for i in r["input_ids"])


@pytest.mark.parametrize("k", [1000, 1001])
def test_kshot_by_text_keys(spark, k):
    rows = [(f"s{i:05d}", ["O", "B-PER", "I-PER"]) for i in range(1500)]
    df = spark.createDataFrame(rows, "name string, tags array<string>")
    got = sorted(r["name"] for r in labels.kshot(df, k, ["name"]).collect())
    assert got == [f"s{i:05d}" for i in range(k)]


def test_encode_lines_with_and_without_padding(spark):
    df = spark.createDataFrame([(0, "a b c d"), (1, "  "), (2, "a")], "row_id bigint, text string")
    table = spark.createDataFrame([("a", 9, 0), ("b", 5, 1)], "token string, count bigint, id bigint")
    loose = {r["row_id"]: r for r in vocab.encode_lines(df, table, 3).collect()}
    assert sorted(loose) == [0, 2]
    assert loose[0]["input_ids"] == [0, 1, -1] and loose[2]["attention_mask"] == [1]
    padded = {r["row_id"]: r for r in vocab.encode_lines(df, table, 3, pad_id=7, special=[7]).collect()}
    assert padded[2]["input_ids"] == [0, 7, 7] and padded[2]["special_tokens_mask"] == [0, 1, 1]


def test_tokenizer_hook(spark):
    df = spark.createDataFrame([(0, "ab c")], "row_id bigint, text string")

    def letters(batches):
        for b in batches:
            yield b.assign(tokens=[list(t.replace(" ", "")) for t in b["text"]])[["row_id", "tokens"]]

    assert vocab.tokenize_with(df, letters, "row_id bigint, tokens array<string>").first()["tokens"] == ["a", "b", "c"]


def test_backward_model_by_hand(spark):
    train = spark.createDataFrame([(["a", "b", "a", "b"],)], "tokens array<string>")
    pairs = {(r["ctx"], r["tok"]): r["n"] for r in ngram.backward_pairs(train).collect()}
    assert pairs == {("b", "a"): 2, ("a", "b"): 1, ("</s>", "b"): 1}
    held = spark.createDataFrame([(["a", "c"],)], "tokens array<string>")
    row = ngram.backward_nll(ngram.backward_pairs(train), ngram.backward_pairs(held), 1.0).first()
    # P(a | c) = (0+1)/(0+3), P(c | </s>) = (0+1)/(1+3)
    import math
    assert row["tokens"] == 2 and abs(row["nll"] - (math.log(3) + math.log(4)) / 2) < 1e-9


def test_catalogues(spark):
    assert labels.label_catalogue(["A", "B"]) == ["O", "B-A", "I-A", "B-B", "I-B"]
    assert labels.fixed_catalogue("news")[:5] == ["O", "B-PER", "I-PER", "B-ORG", "I-ORG"]
    assert len(labels.fixed_catalogue("news")) == 9 and len(labels.fixed_catalogue("social")) == 13
    fine = labels.fixed_catalogue("fine")
    assert len(fine) == len(set(fine)) == 133 and fine[15] == "O" and fine[120] == "B-product-car"
    with pytest.raises(ValueError):
        labels.fixed_catalogue("unknown")


def test_encoding_tags(spark):
    names = labels.fixed_catalogue("social")
    df = spark.createDataFrame([(["O", "B-creative-work", "I-product"],)], "tags array<string>")
    coded = df.select(labels.encode_tags(F.col("tags"), names).alias("i"))
    assert coded.first()["i"] == [0, 3, 12]
    assert coded.select(labels.decode_tags(F.col("i"), names).alias("t")).first()["t"] == ["O", "B-creative-work",
                                                                                          "I-product"]
    with pytest.raises(PySparkException, match="unknown tag"):
        spark.createDataFrame([(["B-nothing"],)], "tags array<string>").select(
            labels.encode_tags(F.col("tags"), names)).collect()


def kshot_by_loop(rows, k):
    seen, kept = {}, []
    for i, tags in rows:
        kinds = set(tags)
        if len(kinds) == 3 and any(t.startswith("I-") for t in kinds):
            kind = min(kinds - {"O"}).split("-", 1)[1]
            if seen.get(kind, 0) < k:
                seen[kind] = seen.get(kind, 0) + 1
                kept.append(i)
    return kept


@pytest.mark.parametrize("k", [1, 4, 2000])
def test_kshot_matches_a_plain_loop(spark, k):
    rng = random.Random(k)
    pool = ["O", "B-X", "I-X", "B-Y", "I-Y", "B-Z-1", "I-Z-1"]
    rows = [(i, [rng.choice(pool[:3] if rng.random() < 0.6 else pool) for _ in range(rng.randint(0, 6))])
            for i in range(500)]
    df = spark.createDataFrame(rows, "sent_id bigint, tags array<string>")
    want = kshot_by_loop(rows, k)
    assert sorted(r["sent_id"] for r in labels.kshot(df, k, ["sent_id"]).collect()) == want
    assert sorted(r["sent_id"] for r in labels.kshot_by_prefix(df, k, ["sent_id"], bits=3).collect()) == want
    dist = labels.kshot_distribution(labels.kshot(df, k, ["sent_id"]), labels.catalogue_frame(
        spark, labels.label_catalogue(["X", "Y", "Z-1", "never"])))
    counts = {r["type"]: r["n"] for r in dist.collect()}
    assert counts["never"] == 0 and counts[""] == 0 and sum(counts.values()) == len(want)


def test_subword_alignment(spark):
    df = spark.createDataFrame([(["abcdefghi", "jk", "lmnop"], [3, 4, 5])], "tokens array<string>, tags array<int>")
    row = labels.subword_rows(df, "tokens", "tags", 8).first()
    assert row["pieces"] == ["abcd", "efgh", "i", "jk", "lmno", "p", "", ""]
    assert row["sub_labels"] == [3, -100, -100, 4, 5, -100, -100, -100]
    assert row["word_ids"] == [0, 0, 0, 1, 2, 2, None, None]
    assert row["attention_mask"] == [1] * 6 + [0] * 2
    short = labels.subword_rows(df, "tokens", "tags", 4).first()
    assert short["sub_labels"] == [3, -100, -100, 4] and short["attention_mask"] == [1] * 4


def test_features_reverse_only_valid_ids(spark):
    df = spark.createDataFrame([([7, 8, 9], [0, -100, 2])], "ids array<int>, labels array<int>")
    row = labels.features(df, 5, pad_id=1).first()
    assert row["input_ids"] == [7, 8, 9, 1, 1] and row["input_ids_backward"] == [9, 8, 7, 1, 1]
    assert row["labels"] == [0, -100, 2, -100, -100] and row["attention_mask"] == [1, 1, 1, 0, 0]
    kept = labels.drop_ignored(labels.features(df, 5), "labels", "input_ids").collect()
    assert [(r["pos"], r["gold"], r["pred"]) for r in kept] == [(0, 0, 7), (2, 2, 9)]


def test_special_pieces_around_a_sentence(spark):
    df = spark.createDataFrame([(["abcde", "fg"], [3, 4])], "tokens array<string>, ids array<int>")
    whole = labels.subword_rows(df, "tokens", "ids", None, before=["<s>"], after=["</s>"]).first()
    assert whole["pieces"] == ["<s>", "abcd", "e", "fg", "</s>"] and whole["sub_labels"] == [-100, 3, -100, 4, -100]
    assert whole["word_ids"] == [None, 0, 0, 1, None] and whole["special_tokens_mask"] == [1, 0, 0, 0, 1]
    assert whole["attention_mask"] == [1] * 5
    cut = labels.subword_rows(df, "tokens", "ids", 4, before=["<s>"], after=["</s>"]).first()
    assert cut["pieces"] == ["<s>", "abcd", "e", "</s>"] and cut["special_tokens_mask"] == [1, 0, 0, 1]
    padded = labels.subword_rows(df, "tokens", "ids", 7, before=["<s>"]).first()
    assert padded["pieces"] == ["<s>", "abcd", "e", "fg", "", "", ""] and padded["special_tokens_mask"] == [1, 0, 0, 0, 1, 1, 1]
    assert padded["attention_mask"] == [1, 1, 1, 1, 0, 0, 0]
    with pytest.raises(ValueError):
        labels.subword_rows(df, "tokens", "ids", 1, before=["<s>"], after=["</s>"])


def test_words_are_cut_by_the_longest_pieces(spark):
    known = [("un", False), ("u", False), ("a", False), ("able", True), ("ab", True), ("l", True), ("e", True), ("ff", True), ("f", True), ("aff", True), ("ü", False), ("日本", False)]
    words = ["unaffable", "unable", "u", "able", "abl", "uffle", "zz", "", "unx", "ü", "日本", "ufff", "aaff"]

    def plain(word):
        out, at = [], 0
        while at < len(word):
            fits = [n for n in range(len(word) - at, 0, -1) if (word[at:at + n], at > 0) in set(known)]
            if not fits:
                return ["[UNK]"]
            out.append(word[at:at + fits[0]])
            at += fits[0]
        return out or ["[UNK]"]

    vocabulary = spark.createDataFrame(known, "piece string, inner boolean")
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r["word"]: r["pieces"] for r in labels.cut_words(df, vocabulary).collect()}
    assert got == {w: plain(w) for w in words}
    rows = spark.createDataFrame([(1, words[:4] * 2), (2, []), (3, words[4:])], "id int, tokens array<string>")
    cut = {r["id"]: r["cut"] for r in labels.vocabulary_pieces(rows, vocabulary, ["id"]).collect()}
    assert cut == {1: [plain(w) for w in words[:4] * 2], 2: [], 3: [plain(w) for w in words[4:]]}


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney_is_a_distribution_and_equals_plain_counting(spark, order):
    rng = random.Random(3)
    letters = ["a", "b", "c", "d", "e", "f"]
    docs = [(i, [rng.choice(letters[: 2 + i % 5]) for _ in range(rng.randint(0, 9))], False) for i in range(40)]
    held = [(100 + i, [x, *c], True) for i, c in enumerate([["a"], ["b", "a"], ["f", "f"], [], ["z", "a"]]) for x in [*letters, "new"]]
    grams = lambda rows: [((*([*t, *["</s>"] * order][p + 1:p + order]),), t[p]) for _, t, _ in rows for p in range(len(t))]
    tables = {order: Counter(grams(docs))}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter((c[:k - 1], t) for c, t in tables[k + 1])

    def taken(k):
        c = [sum(n == i for n in tables[k].values()) for i in (1, 2, 3, 4)]
        y = c[0] / (c[0] + 2 * c[1]) if c[0] else 0.5
        d = [max(i - (i + 1) * y * c[i] / c[i - 1] if c[i - 1] else y, 0.1) for i in (1, 2, 3)]
        return lambda n: d[min(n, 3) - 1]

    def p(context, token, k):
        if k == 0:
            return 1 / (len(tables[1]) + 1)
        here = {t: n for (c, t), n in tables[k].items() if c == context[:k - 1]}
        low = p(context, token, k - 1)
        if not here:
            return low
        d = taken(k)
        return (max(here[token] - d(here[token]), 0) if token in here else 0) / sum(here.values()) + sum(map(d, here.values())) / sum(here.values()) * low

    for context in [("a",) * (order - 1), ("f",) * (order - 1), ("z",) * (order - 1)]:
        assert math.isclose(sum(p(context, t, order) for t in [*letters, "new"]), 1.0, abs_tol=1e-9)
    df = spark.createDataFrame(docs + held, "id int, tokens array<string>, held boolean")
    got = ngram.kneser_ney_nll(ngram.backward_counts(df, order), order).first()
    want = [-math.log(p(c, t, order)) for c, t in grams(held)]
    assert got["tokens"] == len(want) and math.isclose(got["nll"], sum(want) / len(want), rel_tol=1e-9)
    for r in ngram.kneser_ney_nll(ngram.backward_counts(df, 3), 3, (2, 3)).collect():  # both orders from one table of counts
        assert r["order"] != order or math.isclose(r["nll"], got["nll"], rel_tol=1e-9) and r["tokens"] == len(want)


def test_context_totals_are_added_up_once(spark):
    pairs = spark.createDataFrame([("a", "b", 2), ("a", "c", 1), ("b", "a", 4)], "ctx string, tok string, n bigint")
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    ngram.backward_nll(pairs.mapInArrow(run, pairs.schema), pairs, 1.0).collect()
    assert read.value == 9  # the vocabulary, the pairs' counts and the totals


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 64, 65, 1000])
def test_every_epoch_is_a_new_order_of_all_rows(spark, n):
    rows = spark.range(n).withColumnRenamed("id", "index")
    orders = []
    for epoch in (0, 1):
        got = corpus.epoch_batches(rows, n, 10, 5, epoch).orderBy("index").collect()
        orders.append([r["place"] for r in got])
        assert sorted(orders[-1]) == list(range(n)) and all(r["batch_id"] == r["place"] // 10 for r in got)
    assert n < 64 or (orders[0] != orders[1] and sum(a == b for a, b in enumerate(orders[0])) < n / 8)


def test_exact_holdout_moves_no_wide_row(spark):
    df = spark.range(500).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("string").alias("g"), F.lit("wide").alias("text"))
    df = df.withColumn("g", F.when(F.col("g") != "1", F.col("g")))  # a third has no group
    got = corpus.holdout_exact(df, 0.1, by=["g"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("BroadcastExchange") == 1
    counts = {r["g"]: (r["n"], r["v"]) for r in got.groupBy("g").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "validation").alias("v")).collect()}
    assert counts == {k: (n, math.ceil(n * 0.1)) for k, n in (("0", 167), (None, 167), ("2", 166))}
    draw = lambda i: int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:8], 16)
    held = {r["row_id"] for r in got.where("split = 'validation'").collect()}
    for k in range(3):
        ids = sorted((i for i in range(500) if i % 3 == k), key=lambda i: (draw(i), i))
        assert {i for i in held if i % 3 == k} == set(ids[: math.ceil(len(ids) * 0.1)])
    assert corpus.holdout_exact(df.where("false"), 0.1).count() == 0 == corpus.holdout_exact(df.where("false"), 0.1, by=["g"]).count()


def test_encoding_joins_distinct_tokens_of_packs(spark, monkeypatch):
    """Rows of one key become one in the order of places, null tokens go, empty and null arrays stay; a pack holds a token once."""
    rows = [(1, ["a", "b", "a"]), (1, ["c", None, "z"]), (None, ["b"]), (2, []), (3, None), (None, ["a", "q"]), (4, ["z", None, "a"])]
    df = spark.createDataFrame(rows, "k long, tokens array<string>")
    table = spark.createDataFrame([("a", 9, 5), ("b", 4, 6), ("c", 1, 7)], "token string, count long, id long")
    want = {1: [5, 7, 6, -1, 5], None: [5, 6, -1], 2: [], 3: [], 4: [-1, 5]}
    got = vocab.encode(df, table, ["k"]).collect()
    assert {r["k"]: r["input_ids"] for r in got} == want and len(got) == len(want)
    batch = pa.RecordBatch.from_pylist([{"__key": {"k": k}, "__tokens": ["a", "b", None] * 20} for k in range(500)])
    packs = list(vocab._packed(iter([batch.slice(0, 300), batch.slice(300)])))
    assert [p.num_rows for p in packs] == [1] and packs[0].column("__distinct").to_pylist() == [["a", "b"]]
    assert packs[0].column("__sizes").to_pylist() == [[60] * 500] and len(packs[0].column("__codes")[0]) == 30000
    monkeypatch.setattr(vocab, "PACK_TOKENS", 200)
    packs = list(vocab._packed(iter([batch.slice(0, 299), batch.slice(299)])))
    assert [len(p.column("__keys")[0]) for p in packs] == [4] * 125
    assert [x["k"] for p in packs for x in p.column("__keys")[0].as_py()] == list(range(500))


def test_cut_rows_that_repeat_or_hold_nulls(spark):
    """Rows of one key become one, by place and then by pieces; null tokens take no place; a row without an id is a key too."""
    vocabulary = spark.createDataFrame([("ab", False), ("c", True), ("é", False), ("日本", True), ("a", False)], "piece string, inner boolean")
    rows = [(1, ["abc", "x", "é日本"]), (2, ["abc", None, "a"]), (2, ["a", "[UNK]"]), (3, []), (4, [None]), (None, ["ab"]), (5, None), (6, ["", "abc"])]
    df = spark.createDataFrame(rows, "id int, tokens array<string>").withColumn("other", F.col("id") * 10)
    want = {1: [["ab", "c"], ["[UNK]"], ["é", "日本"]], 2: [["a"], ["ab", "c"], ["[UNK]"], ["a"]], 3: [], 4: [], None: [["ab"]], 5: [], 6: [["[UNK]"], ["ab", "c"]]}
    cut = labels.vocabulary_pieces(df, vocabulary, ["id"])
    assert {r["id"]: r["cut"] for r in cut.collect()} == want
    kept = labels.vocabulary_pieces(df, vocabulary, ["id"], keep=["other"])
    assert sorted((r["id"], r["other"], r["cut"]) for r in kept.collect()) == sorted((i, 10 * i, want[i]) for i, _ in rows if i is not None)


def test_pieces_go_back_to_their_rows_as_texts(spark):
    """What is dealt out by word grows with the distinct words of the packs, and no array of arrays is shuffled."""
    vocabulary = spark.createDataFrame([("ab", False)], "piece string, inner boolean")
    df = spark.createDataFrame([(1, ["ab"] * 50)], "id int, tokens array<string>")
    cut = labels.vocabulary_pieces(df, vocabulary, ["id"], keep=["tokens"])
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(__distinct" in plan and "posexplode(tokens" not in plan
    assert cut.first()["cut"] == [["ab"]] * 50


def test_words_are_cut_by_packs(spark, monkeypatch):
    """The walk by the longest piece, whatever the packs; what meets the vocabulary are a pack's distinct substrings."""
    rng = __import__("random").Random(3)
    words = ["".join(rng.choice("abé日") for _ in range(rng.randint(1, 9))) for _ in range(300)] + ["", None]
    known = {(p, i) for p in ("a", "b", "é", "ab", "ba", "aba", "日a", "é日é") for i in (False, True) if (len(p) + i) % 3}
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(3)
    vocabulary = spark.createDataFrame(sorted(known), "piece string, inner boolean")

    def plain(w):
        at, out = 0, []
        while w and at < len(w):
            n = max((n for n in range(1, 4) if at + n <= len(w) and (w[at:at + n], at > 0) in known), default=None)
            if n is None:
                return ["[UNK]"]
            out.append(w[at:at + n])
            at += n
        return out or ["[UNK]"]

    cut = labels.cut_words(df, vocabulary, longest=3)
    assert "posexplode" not in cut._jdf.queryExecution().optimizedPlan().toString() and "sequence(1" not in cut._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(repr, ((r["word"], r["pieces"]) for r in cut.collect()))) == sorted(map(repr, ((w, plain(w)) for w in words)))
    monkeypatch.setattr(labels, "PACK_LETTERS", 40)
    import pyarrow as pa
    packs = list(labels._word_packs(iter([pa.RecordBatch.from_pydict({"word": words})]), 3))
    assert len(packs) > 20 and [w for p in packs for w in p.column("__words")[0].as_py()] == words
