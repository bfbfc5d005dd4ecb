"""Queries over text corpora: preparation, vocabulary, encoding and the backward bigram model."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import corpus, ngram, packing, vocab
from ..operators.ordered import dense_index
from ..session import shared_dir, stored
from ..sources import corpora as readers
from . import inputs
from .registry import registry

QUERIES, ORACLES, query = registry()

# the characters of white space, for RE2
SPACE = r"\t-\r\x1c-\x1f\x{85}\p{Z}"

CORPORA_SQL = """
corpora AS (
  SELECT 'documents' AS corpus, 0 AS corpus_rank, doc_id::VARCHAR AS row_id, text FROM documents
  UNION ALL SELECT 'conversations', 1, conv_id || ':' || turn, text FROM conversations
  UNION ALL SELECT 'benchmark', 2, item_id::VARCHAR, text FROM benchmark)"""

LINES_SQL = r"""
split_lines AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
lines AS (
  SELECT doc_id, line_no,
    CASE WHEN line_no % 10 = 3 THEN ' = ' || line || ' = ' WHEN line_no % 4 = 1 THEN line || ' ' || chr(9)
         ELSE line END AS text
  FROM split_lines)"""

TOKENS_SQL = r"""
toks AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: x <> '') AS toks
  FROM documents)"""

DRAW_SQL = "('0x' || substr(md5('42:' || {key}), 1, 8))::BIGINT"


@query("corpus_union", f"""WITH {CORPORA_SQL}
SELECT corpus, corpus_rank::INT AS corpus_rank, row_id, length(text)::BIGINT AS n_chars FROM corpora""")
def corpus_union(spark, folder):
    united = corpus.union_corpora(inputs.corpora(spark, folder))
    return united.select("corpus", "corpus_rank", "row_id", F.char_length("text").cast("bigint").alias("n_chars"))


@query("corpora_read", """
SELECT 'documents.parquet' AS corpus, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM documents
UNION ALL SELECT 'conversations.parquet', count(*), sum(length(text))::BIGINT FROM conversations""")
def corpora_read(spark, folder):
    """Paired names and configurations; the third name has no configuration and is cut."""
    read = readers.read_corpora(spark, ["documents.parquet", "conversations.parquet", "benchmark.parquet"],
                                ["None", "None"], folder)
    return read.groupBy("corpus").agg(F.count("*").alias("n"),
                                      F.sum(F.char_length("text").cast("bigint")).alias("n_chars"))


@query("shards_read", """SELECT lang, count(*) AS n FROM documents GROUP BY lang""")
def shards_read(spark, folder):
    return readers.read_shards(spark, f"{folder}/docum*.parquet").groupBy("lang").agg(F.count("*").alias("n"))


@query("written_splits", f"""WITH {CORPORA_SQL}, drawn AS (SELECT *,
  CASE WHEN {DRAW_SQL.format(key="corpus || ':' || row_id")} % 10000 < 500 THEN 'validation' ELSE 'train' END AS split
  FROM corpora)
SELECT split, corpus, count(*) AS n FROM drawn GROUP BY split, corpus""")
def written_splits(spark, folder):
    """Written once per split, a second write ignored, read back with the split as a partition column."""
    path = shared_dir(spark, "corpus")
    split = corpus.holdout(corpus.union_corpora(inputs.corpora(spark, folder)), keys=["corpus", "row_id"])
    readers.write_once(split, path)
    readers.write_once(split.where("false"), path)
    return spark.read.parquet(path).groupBy("split", "corpus").agg(F.count("*").alias("n"))


@query("holdout_split", f"""
SELECT doc_id, CASE WHEN {DRAW_SQL.format(key='doc_id')} % 10000 < 500 THEN 'validation' ELSE 'train' END AS split
FROM documents""")
def holdout_split(spark, folder):
    return corpus.holdout(inputs.table(spark, folder, "documents"), keys=["doc_id"]).select("doc_id", "split")


@query("holdout_exact", f"""
WITH drawn AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY
    {DRAW_SQL.format(key='doc_id')}, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, CASE WHEN r <= ceil(n * 0.05::DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM drawn""")
def holdout_exact(spark, folder):
    rows = inputs.table(spark, folder, "documents").select("doc_id", "lang")
    return corpus.holdout_exact(rows, keys=["doc_id"], by=["lang"])


@query("shuffle_order", """
SELECT doc_id, md5('7:' || doc_id) AS shuffle_key, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS place
FROM documents""")
def shuffle_order(spark, folder):
    return corpus.shuffled(inputs.table(spark, folder, "documents").select("doc_id"), 7, ["doc_id"], place="place")


def _permuted_sql(source: str, seed: int, epoch: int) -> str:
    """The rounds of the permutation over the column x of a table with id, x, n, and the number of low bits l and of all bits b."""
    sql = f"SELECT id, n, l, b, x >> l AS high, x & ((1::BIGINT << l) - 1) AS low FROM {source}"
    for r in range(corpus.ROUNDS):
        a, c = corpus._round_constants(seed, epoch, r)
        value, target, mask = ("high", "low", "l") if r % 2 == 0 else ("low", "high", "b - l")
        mixed = f"((({value} % {corpus.PRIME}) * {a} + {c}) % {corpus.PRIME}) & ((1::BIGINT << ({mask})) - 1)"
        sql = f"SELECT id, n, l, b, {value}, xor({target}, {mixed}) AS {target} FROM ({sql})"
    return f"SELECT id, n, l, b, (high << l) + low AS x FROM ({sql})"


EPOCH_BATCH, EPOCHS = 32, 3


def _epoch_sql(epoch: int) -> str:
    return f"""walk{epoch} AS ({_permuted_sql('rows_', 11, epoch)} UNION ALL {_permuted_sql(f'(SELECT * FROM walk{epoch} WHERE x >= n)', 11, epoch)})"""


@query("epoch_batches", f"""WITH RECURSIVE size AS (SELECT count(*) AS n FROM documents),
rows_ AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS x, n, greatest(ceil(log2(n)), 2)::INT AS b, greatest(ceil(log2(n)), 2)::INT // 2 AS l FROM documents, size),
{', '.join(_epoch_sql(e) for e in range(EPOCHS))}
{' UNION ALL '.join(f"SELECT {e} AS epoch, id AS doc_id, x::BIGINT AS place, (x // {EPOCH_BATCH})::BIGINT AS batch_id FROM walk{e} WHERE x < n" for e in range(EPOCHS))}""")
def epoch_batches(spark, folder):
    """Batches of three epochs from one dense index."""
    rows = inputs.table(spark, folder, "documents").select("doc_id")
    n = rows.count()
    indexed = dense_index(rows, "index", ["doc_id"])
    each = [corpus.epoch_batches(indexed, n, EPOCH_BATCH, 11, e).select(F.lit(e).alias("epoch"), "doc_id", "place", "batch_id") for e in range(EPOCHS)]
    return each[0].unionAll(each[1]).unionAll(each[2])


@query("corpus_filter", f"""WITH {LINES_SQL}
SELECT doc_id, line_no::BIGINT AS line_no, text FROM lines WHERE text <> '' AND NOT starts_with(text, ' =')""")
def corpus_filter(spark, folder):
    return corpus.drop_headings(inputs.document_lines(spark, folder)).select("doc_id", "line_no", "text")


@query("blank_lines", f"""WITH {LINES_SQL}
SELECT doc_id, count(*) AS n FROM lines WHERE regexp_matches(text, '[^{SPACE}]') GROUP BY doc_id""")
def blank_lines(spark, folder):
    kept = corpus.drop_blank(inputs.document_lines(spark, folder))
    return kept.groupBy("doc_id").agg(F.count("*").alias("n"))


@query("corpus_clean", f"""WITH {LINES_SQL},
parts AS (SELECT 0 AS corpus_rank, doc_id || ':' || line_no AS row_id, text FROM lines
  UNION ALL SELECT 1, item_id::VARCHAR, text FROM benchmark)
SELECT corpus_rank::INT AS corpus_rank, row_id,
  regexp_replace(text, '[{SPACE}]+\\z', '') AS text
FROM parts WHERE text <> '' AND NOT starts_with(text, ' =')""")
def corpus_clean(spark, folder):
    second = inputs.table(spark, folder, "benchmark").select(inputs.joined_key("item_id").alias("row_id"), "text")
    first = inputs.document_lines(spark, folder).select(inputs.joined_key("doc_id", "line_no").alias("row_id"), "text")
    return corpus.two_corpus_documents(first, second, "train").select("corpus_rank", "row_id", "text")


TWO_BLOCK = 64


@query("two_corpus_blocks", f"""WITH {LINES_SQL},
parts AS (SELECT 0 AS r, doc_id AS a, line_no AS b, text FROM lines UNION ALL SELECT 1, conv_id, turn, text FROM conversations),
clean AS (SELECT r, a, b, list_filter(string_split_regex(regexp_replace(text, '[{SPACE}]+\\z', ''), '[ \\t\\r\\n]+'), lambda x: x <> '') AS l
  FROM parts WHERE text <> '' AND NOT starts_with(text, ' =')),
flat AS (SELECT r, a, b, generate_subscripts(l, 1) AS pos, unnest(l) AS tok FROM clean),
stream AS (SELECT tok, row_number() OVER (ORDER BY r, a, b, pos DESC) - 1 AS g FROM flat)
SELECT (g // {TWO_BLOCK})::BIGINT AS block_id, string_agg(tok, ' ' ORDER BY g) AS block FROM stream
GROUP BY g // {TWO_BLOCK} HAVING count(*) = {TWO_BLOCK}""")
def two_corpus_blocks(spark, folder):
    """Lines of the documents, then the conversations: cleaned, joined, tokenized, every text reversed, one stream cut into blocks."""
    first = inputs.document_lines(spark, folder).select((F.shiftleft("doc_id", 20) + F.col("line_no")).alias("row_id"), "text")
    second = inputs.table(spark, folder, "conversations").select((F.shiftleft("conv_id", 20) + F.col("turn")).alias("row_id"), "text")
    united = corpus.two_corpus_documents(first, second, "train")
    # one integer orders both corpora: the corpus above, the row's id in the 60 bits below
    placed = united.withColumn("place", F.shiftleft(F.col("corpus_rank").cast("bigint"), 60) + F.col("row_id"))
    blocks = packing.pack_stream(vocab.tokenize(placed, ["place"]), TWO_BLOCK, ["place"], bits=20, levels=3)
    return blocks.select("block_id", F.array_join("tokens", " ").alias("block"))


@query("corpus_stats", f"""WITH {CORPORA_SQL}, drawn AS (SELECT *,
  CASE WHEN {DRAW_SQL.format(key="corpus || ':' || row_id")} % 10000 < 500 THEN 'validation' ELSE 'train' END AS split,
  len(list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '')) AS k FROM corpora)
SELECT corpus, split, count(*) AS n_rows, sum(k)::BIGINT AS n_tokens FROM drawn GROUP BY corpus, split""")
def corpus_stats(spark, folder):
    split = corpus.holdout(corpus.union_corpora(inputs.corpora(spark, folder)), keys=["corpus", "row_id"])
    return corpus.corpus_stats(vocab.tokenize(split, ["corpus", "split"]))


@query("tokens", f"""WITH {TOKENS_SQL}
SELECT doc_id, len(toks)::BIGINT AS n, md5(array_to_string(toks, ' ')) AS digest FROM toks""")
def tokens(spark, folder):
    return inputs.document_tokens(spark, folder).select(
        "doc_id", F.size("tokens").cast("bigint").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


VOCAB_SQL = f"""{TOKENS_SQL},
counts AS (SELECT token, count(*) AS count FROM (SELECT unnest(toks) AS token FROM toks) GROUP BY token),
vocab AS (SELECT token, count, row_number() OVER (ORDER BY count DESC, substr(md5(token), 1, 3), token) - 1 AS id
  FROM counts)"""


@query("vocab", f"""WITH {VOCAB_SQL} SELECT token, count, id FROM vocab""")
def vocabulary(spark, folder):
    return vocab.build_vocab(vocab.token_counts(inputs.document_tokens(spark, folder)))


def _stored_vocab(spark, folder):
    """The vocabulary as a table: it is used by every encoding job, so it is made once and written."""
    return stored(vocab.build_vocab(vocab.token_counts(inputs.document_tokens(spark, folder))), "vocab")


@query("encode", f"""WITH {VOCAB_SQL},
flat AS (SELECT doc_id, generate_subscripts(toks, 1) AS pos, unnest(toks) AS token FROM toks)
SELECT doc_id, count(*) AS n, count(*) FILTER (id IS NULL) AS n_unknown,
  string_agg(coalesce(id, -1)::VARCHAR, ',' ORDER BY pos) AS ids
FROM flat LEFT JOIN vocab USING (token) GROUP BY doc_id""")
def encode(spark, folder):
    coded = vocab.encode(inputs.document_tokens(spark, folder), _stored_vocab(spark, folder), ["doc_id"])
    return coded.select("doc_id", F.size("input_ids").cast("bigint").alias("n"),
                        F.size(F.filter("input_ids", lambda i: i == -1)).cast("bigint").alias("n_unknown"),
                        F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("ids"))


@query("encode_lines", f"""WITH {VOCAB_SQL}, {LINES_SQL},
kept AS (SELECT doc_id, line_no, list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '') AS l FROM lines
  WHERE regexp_matches(text, '[^{SPACE}]')),
flat AS (SELECT doc_id, line_no, generate_subscripts(l, 1) AS pos, unnest(l) AS token FROM kept),
coded AS (SELECT doc_id, line_no, list(coalesce(id, -1) ORDER BY pos) AS ids FROM flat LEFT JOIN vocab USING (token)
  GROUP BY doc_id, line_no)
SELECT doc_id, line_no::BIGINT AS line_no, array_to_string(list_resize(ids, 16, 0), ',') AS input_ids,
  least(len(ids), 16)::BIGINT AS n_valid, array_to_string(list_transform(list_resize(ids, 16, 0),
    lambda i: (i IN (0, 1))::INT), ',') AS special_tokens_mask FROM coded""")
def encode_lines(spark, folder):
    lines = inputs.document_lines(spark, folder)
    made = vocab.encode_lines(lines, _stored_vocab(spark, folder), 16, ["doc_id", "line_no"], pad_id=0, special=[0, 1])
    return made.select("doc_id", "line_no", F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"),
                       F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_valid"),
                       F.array_join(F.col("special_tokens_mask").cast("array<string>"), ",")
                       .alias("special_tokens_mask"))


PAIRS_SQL = f"""{TOKENS_SQL},
flat AS (SELECT doc_id, generate_subscripts(toks, 1) AS pos, unnest(toks) AS tok FROM toks),
next_to AS (SELECT doc_id, tok, lead(tok, 1, '</s>') OVER (PARTITION BY doc_id ORDER BY pos) AS ctx,
  {DRAW_SQL.format(key='doc_id')} % 10000 < 500 AS held FROM flat)"""


@query("backward_pairs", f"""WITH {PAIRS_SQL} SELECT ctx, tok, count(*) AS n FROM next_to GROUP BY ctx, tok""")
def backward_pairs(spark, folder):
    return ngram.backward_pairs(inputs.document_tokens(spark, folder))


@query("backward_bigram_nll", f"""WITH {PAIRS_SQL},
pair AS (SELECT ctx, tok, count(*) AS n FROM next_to WHERE NOT held GROUP BY ctx, tok),
ctxs AS (SELECT ctx, count(*) AS t FROM next_to WHERE NOT held GROUP BY ctx),
size AS (SELECT count(DISTINCT tok) AS v FROM next_to WHERE NOT held),
scored AS (SELECT -ln((coalesce(n, 0) + 0.5::DOUBLE) / (coalesce(t, 0) + 0.5::DOUBLE * (v + 1))) AS nll
  FROM next_to LEFT JOIN pair USING (ctx, tok) LEFT JOIN ctxs USING (ctx), size WHERE held)
SELECT count(*) AS tokens, round(avg(nll), 4) AS nll, round(exp(avg(nll)), 2) AS perplexity FROM scored""")
def backward_bigram_nll(spark, folder):
    split = corpus.holdout(inputs.documents(spark, folder), keys=["doc_id"])
    counted = stored(ngram.backward_pairs(vocab.tokenize(split, ["split"]), by=["split"]), "pairs")
    train = counted.where(F.col("split") == "train").drop("split")
    held_out = counted.where(F.col("split") == "validation").drop("split")
    scored = ngram.backward_nll(train, held_out, 0.5)
    return scored.select("tokens", F.round("nll", 4).alias("nll"), F.round("perplexity", 2).alias("perplexity"))


def _kneser_ney_sql(order: int) -> str:
    """Tokens and mean loss of the held-out tokens, one table of counts, discounts and contexts per order."""
    def names(k, prefix=""):
        return [f"{prefix}c{i}" for i in range(1, k)]

    def listed(*columns):
        return ", ".join(columns)

    parts = [f"""g AS MATERIALIZED (SELECT tok, {listed(*[f"lead(tok, {i}, '</s>') OVER (PARTITION BY doc_id ORDER BY pos) AS c{i}" for i in range(1, order)])},
  {DRAW_SQL.format(key='doc_id')} % 10000 < 500 AS held FROM flat)"""]
    for k in range(order, 0, -1):
        source = "g WHERE NOT held" if k == order else f"t{k + 1}"
        parts.append(f"t{k} AS MATERIALIZED (SELECT {listed(*names(k), 'tok')}, count(*) AS n FROM {source} GROUP BY {listed(*names(k), 'tok')})")
        parts.append(f"""k{k} AS (SELECT count(*) FILTER (n = 1) AS a, count(*) FILTER (n = 2) AS b, count(*) FILTER (n = 3) AS c, count(*) FILTER (n = 4) AS d FROM t{k}),
y{k} AS (SELECT *, CASE WHEN a > 0 THEN a / (a + 2.0::DOUBLE * b) ELSE 0.5 END AS y FROM k{k}),
d{k} AS MATERIALIZED (SELECT greatest(CASE WHEN a > 0 THEN 1 - 2 * y * b / a ELSE y END, 0.1) AS d1,
  greatest(CASE WHEN b > 0 THEN 2 - 3 * y * c / b ELSE y END, 0.1) AS d2, greatest(CASE WHEN c > 0 THEN 3 - 4 * y * d / c ELSE y END, 0.1) AS d3 FROM y{k}),
e{k} AS MATERIALIZED (SELECT t{k}.*, CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS taken FROM t{k}, d{k})""")
        group = f"GROUP BY {listed(*names(k))}" if k > 1 else ""
        parts.append(f"h{k} AS MATERIALIZED (SELECT {listed(*names(k), 'sum(n) AS total', 'sum(taken) AS lam')} FROM e{k} {group})")
    parts.append("p0 AS (SELECT g.*, 1.0::DOUBLE / ((SELECT count(*) FROM t1) + 1) AS p FROM g WHERE held)")
    for k in range(1, order + 1):
        on = " AND ".join(f"e.{c} = q.{c}" for c in [*names(k), "tok"])
        context = f"LEFT JOIN h{k} h ON " + " AND ".join(f"h.{c} = q.{c}" for c in names(k)) if k > 1 else f", h{k} h"
        parts.append(f"""p{k} AS (SELECT q.* EXCLUDE (p), CASE WHEN h.total > 0 THEN (coalesce(greatest(e.n - e.taken, 0), 0) + h.lam * q.p) / h.total ELSE q.p END AS p
  FROM p{k - 1} q LEFT JOIN e{k} e ON {on} {context})""")
    return f"""{TOKENS_SQL},
flat AS MATERIALIZED (SELECT doc_id, generate_subscripts(toks, 1) AS pos, unnest(toks) AS tok FROM toks),
{', '.join(parts)}
SELECT {order} AS "order", count(*) AS tokens, round(avg(-ln(p)), 4) AS nll, round(exp(avg(-ln(p))), 2) AS perplexity FROM p{order}"""


@query("backward_trigram_nll", f"SELECT * FROM (WITH {_kneser_ney_sql(2)}) UNION ALL SELECT * FROM (WITH {_kneser_ney_sql(3)})")
def backward_trigram_nll(spark, folder):
    """Held-out loss of the backward model with one and with two tokens of context."""
    split = corpus.holdout(inputs.documents(spark, folder), keys=["doc_id"])
    tokens = vocab.tokenize(split.withColumn("held", F.col("split") == "validation"), ["held"])
    found = ngram.kneser_ney_nll(ngram.backward_counts(tokens, 3), 3, (2, 3))
    return found.select("order", "tokens", F.round("nll", 4).alias("nll"), F.round("perplexity", 2).alias("perplexity"))


BLOCK = 128
BLOCKS_SQL = f"""
parts AS (SELECT 'documents' AS corpus, doc_id AS a, 0 AS b, doc_id::VARCHAR AS key, text FROM documents
  UNION ALL SELECT 'conversations', conv_id, turn, conv_id || ':' || turn, text FROM conversations
  UNION ALL SELECT 'benchmark', item_id, 0, item_id::VARCHAR, text FROM benchmark),
drawn AS (SELECT corpus, a, b, list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '') AS l,
  CASE WHEN {DRAW_SQL.format(key="corpus || ':' || key")} % 10000 < 500 THEN 'validation' ELSE 'train' END AS split FROM parts),
flat AS (SELECT split, corpus, a, b, generate_subscripts(l, 1) AS pos, unnest(l) AS tok FROM drawn),
placed AS (SELECT *, row_number() OVER (PARTITION BY split, corpus ORDER BY a, b, pos) - 1 AS g FROM flat)"""


@query("corpus_to_blocks", f"""WITH {BLOCKS_SQL}
SELECT split, corpus, (g // {BLOCK})::BIGINT AS block_id, string_agg(tok, ' ' ORDER BY g DESC) AS input_ids,
  string_agg(tok, ' ' ORDER BY g DESC) AS labels
FROM placed GROUP BY split, corpus, g // {BLOCK} HAVING count(*) = {BLOCK}""")
def corpus_to_blocks(spark, folder):
    """The whole preparation: corpora, hold-out, tokens, packed blocks, reversal, one folder per split, read back."""
    talks = inputs.table(spark, folder, "conversations")
    united = corpus.union_corpora([
        ("documents", inputs.documents(spark, folder).select(
            F.col("doc_id").alias("a"), F.lit(0).cast("bigint").alias("b"), inputs.joined_key("doc_id").alias("row_id"), "text")),
        ("conversations", talks.select(
            F.col("conv_id").alias("a"), F.col("turn").alias("b"), inputs.joined_key("conv_id", "turn").alias("row_id"), "text")),
        ("benchmark", inputs.table(spark, folder, "benchmark").select(
            F.col("item_id").alias("a"), F.lit(0).cast("bigint").alias("b"), inputs.joined_key("item_id").alias("row_id"), "text"))])
    split = corpus.holdout(united, keys=["corpus", "row_id"])
    words = vocab.tokenize(split, ["split", "corpus", "a", "b"], out="input_ids")
    blocks = packing.pack_stream(words, BLOCK, ["a", "b"], ["input_ids"], ["split", "corpus"], reverse=False)
    path = shared_dir(spark, "packed")
    readers.write_once(packing.reverse_blocks(blocks), path)
    return spark.read.parquet(path).select("split", "corpus", "block_id", F.array_join("input_ids", " ").alias("input_ids"),
                                           F.array_join("labels", " ").alias("labels"))


@query("text_files_read", """
SELECT kind, count(*) AS n, sum(length(text))::BIGINT AS n_chars, sum(item_id)::BIGINT AS ids
FROM (SELECT item_id, text, unnest(['csv', 'json', 'txt']) AS kind FROM (
  SELECT item_id, replace(text, chr(10), ' ') AS text FROM benchmark)) GROUP BY kind""")
def text_files_read(spark, folder):
    """The benchmark as csv, json and txt files, each read by its extension."""
    rows = inputs.table(spark, folder, "benchmark").select("item_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    csv, js, txt = (f"{shared_dir(spark, 'text')}.{kind}" for kind in readers.TEXT_EXTENSIONS)
    rows.write.option("escape", '"').csv(csv, header=True)
    rows.write.json(js)
    rows.select(F.concat_ws("\t", "item_id", "text").alias("value")).write.text(txt)
    lines = readers.read_text_file(spark, txt)
    parts = [readers.read_text_file(spark, csv, "item_id bigint, text string", escape='"').withColumn("kind", F.lit("csv")),
             readers.read_text_file(spark, js, "item_id bigint, text string").withColumn("kind", F.lit("json")),
             lines.select(F.split("text", "\t", 2)[0].cast("bigint").alias("item_id"), F.split("text", "\t", 2)[1].alias("text"),
                          F.lit("txt").alias("kind"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.char_length("text").cast("bigint")).alias("n_chars"),
                                     F.sum("item_id").alias("ids"))


def _python_words(batches):
    for batch in batches:
        batch["tokens"] = [None if t is None else [w for w in re.split("[ \t\r\n]+", t) if w] for t in batch["text"]]
        yield batch[["doc_id", "tokens"]]


@query("tokens_by_function", f"""WITH {TOKENS_SQL}
SELECT doc_id, len(toks)::BIGINT AS n, md5(array_to_string(toks, ' ')) AS digest FROM toks""")
def tokens_by_function(spark, folder):
    """Tokens by a caller's own batch function."""
    rows = inputs.documents(spark, folder).select("doc_id", "text")
    made = vocab.tokenize_with(rows, _python_words, "doc_id bigint, tokens array<string>")
    return made.select("doc_id", F.size("tokens").cast("bigint").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))
