"""Queries over tagged sentences, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.subwords import md5_numbers
from ..functions.tags import is_valid_tag, tag_prefix, tag_type
from ..functions.text import md5_number
from ..operators import labels, metrics, spans
from ..operators.corpus import holdout
from ..operators.ordered import dense_index
from ..session import shared_dir, stored
from ..sources import render, tagged
from ..sources.corpora import read_processed, write_once
from . import inputs
from .registry import registry

TAGS = labels.fixed_catalogue("news")

SENTENCES_SQL = r"""
pieces AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS sent, unnest(l) AS piece
  FROM (SELECT doc_id, string_split_regex(text, '[.\n]+') AS l FROM documents)),
words AS (
  SELECT doc_id, sent, list_filter(string_split_regex(piece, '[ \t\r]+'), lambda x: x <> '') AS toks FROM pieces),
kinds AS (
  SELECT doc_id, sent, pos, tok,
    CASE WHEN length(tok) >= 7 THEN ['PER', 'ORG', 'LOC', 'MISC'][(pos // 4) % 4 + 1] END AS g
  FROM (SELECT doc_id, sent, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS tok FROM words)),
guessed AS (
  SELECT *, CASE WHEN g IS NOT NULL AND length(tok) % 5 <> 4
                 THEN CASE WHEN length(tok) % 11 = 0 THEN 'LOC' ELSE g END END AS p FROM kinds),
tagged AS (
  SELECT doc_id, sent, pos, tok,
    CASE WHEN g IS NULL THEN 'O' WHEN g = lag(g) OVER s THEN 'I-' || g ELSE 'B-' || g END AS gold,
    CASE WHEN p IS NULL THEN 'O' WHEN p = lag(p) OVER s THEN 'I-' || p ELSE 'B-' || p END AS pred
  FROM guessed WINDOW s AS (PARTITION BY doc_id, sent ORDER BY pos))"""

SENT_LISTS_SQL = """
sents AS (
  SELECT doc_id, sent, list(tok ORDER BY pos) AS toks, list(gold ORDER BY pos) AS gold,
    list(pred ORDER BY pos) AS pred FROM tagged GROUP BY doc_id, sent)"""


def chunks_sql(side: str, part: str, order: str) -> str:
    """Chunks of one side by lag and running count."""
    return f"""
{side}_a AS (SELECT *, {side} AS tag, lag({side}, 1, 'O') OVER (PARTITION BY {part} ORDER BY {order}) AS prev
  FROM tagged),
{side}_b AS (SELECT *, tag <> 'O' AND (prev = 'O' OR substr(tag, 3) <> substr(prev, 3)
    OR tag[1] IN ('B', 'S') OR prev[1] IN ('E', 'S')) AS st FROM {side}_a),
{side}_c AS (SELECT *, sum(st::INT) OVER (PARTITION BY {part} ORDER BY {order}) AS n FROM {side}_b),
{side}_chunks AS (SELECT {part}, n, min(({order})) AS first, max(({order})) AS last,
    any_value(substr(tag, 3)) AS type FROM {side}_c WHERE tag <> 'O' GROUP BY {part}, n)"""


def counts_sql(part: str, order: str) -> str:
    return f"""
{chunks_sql('gold', part, order)}, {chunks_sql('pred', part, order)},
counts AS (
  SELECT coalesce(g.type, p.type) AS type,
    count(*) FILTER (g.type IS NOT NULL AND p.type IS NOT NULL) AS correct,
    count(g.type) AS gold, count(p.type) AS pred
  FROM gold_chunks g FULL JOIN pred_chunks p
    ON {' AND '.join(f'g.{c.strip()} = p.{c.strip()}' for c in part.split(','))}
      AND g.first = p.first AND g.last = p.last AND g.type = p.type
  GROUP BY 1)"""


PRF_SQL = """
  round(coalesce(correct::DOUBLE / nullif(pred, 0), 0) * 100.0, 4) AS precision,
  round(coalesce(correct::DOUBLE / nullif(gold, 0), 0) * 100.0, 4) AS recall,
  round(coalesce((2 * correct)::DOUBLE / nullif(gold + pred, 0), 0) * 100.0, 4) AS f1"""

COUNTS = "type, correct::BIGINT AS correct, gold::BIGINT AS gold, pred::BIGINT AS pred"
QUERIES, ORACLES, query = registry()


@query("span_prf", f"""WITH {SENTENCES_SQL}, {counts_sql('doc_id, sent', 'pos')}
SELECT {COUNTS}, {PRF_SQL} FROM counts""")
def span_prf(spark, folder):
    return metrics.with_prf(spans.chunk_counts(inputs.tagged_sentences(spark, folder)), digits=4)


# one stream over all documents: the order is (document, sentence, position)
@query("span_prf_flat", f"""WITH {SENTENCES_SQL.replace('tagged AS (', 'tagged_s AS (')},
tagged AS (SELECT 1 AS one, row_number() OVER (ORDER BY doc_id, sent, pos) AS place, gold, pred FROM tagged_s),
{counts_sql('one', 'place')}
SELECT {COUNTS}, {PRF_SQL} FROM counts""")
def span_prf_flat(spark, folder):
    documents = inputs.tagged_documents(spark, folder)
    return metrics.with_prf(spans.chunk_counts_flat(documents, ["doc_id"]), digits=4)


@query("span_chunks", f"""WITH {SENTENCES_SQL}, {chunks_sql('gold', 'doc_id, sent', 'pos')}
SELECT doc_id, sent::BIGINT AS sent, first::BIGINT AS "start", last::BIGINT AS "end", type FROM gold_chunks""")
def span_chunks(spark, folder):
    return spans.chunks(inputs.tagged_sentences(spark, folder), ["doc_id", "sent"], "gold")


@query("span_errors", f"""WITH {SENTENCES_SQL}, {chunks_sql('gold', 'doc_id, sent', 'pos')},
{chunks_sql('pred', 'doc_id, sent', 'pos')},
pairs AS (SELECT doc_id, sent, first, last, type, 1 AS g, 0 AS p FROM gold_chunks
  UNION ALL SELECT doc_id, sent, first, last, type, 0, 1 FROM pred_chunks)
SELECT doc_id, sent::BIGINT AS sent, first::BIGINT AS "start", last::BIGINT AS "end", type,
  CASE WHEN sum(g) > 0 THEN 'missed' ELSE 'spurious' END AS error
FROM pairs GROUP BY doc_id, sent, first, last, type HAVING sum(g) = 0 OR sum(p) = 0""")
def span_errors(spark, folder):
    matched = spans.chunk_table(inputs.tagged_sentences(spark, folder), ["doc_id", "sent"])
    wrong = matched.where(F.col("in_gold") + F.col("in_pred") == 1)
    return wrong.select("doc_id", "sent", "start", "end", "type",
                        F.when(F.col("in_gold") == 1, "missed").otherwise("spurious").alias("error"))


@query("tag_counts", f"""WITH {SENTENCES_SQL},
sides AS (SELECT gold AS tag, (gold = pred)::INT AS c, 1 AS g, 0 AS p FROM tagged
  UNION ALL SELECT pred, 0, 0, 1 FROM tagged)
SELECT tag, sum(c)::BIGINT AS correct, sum(g)::BIGINT AS gold, sum(p)::BIGINT AS pred FROM sides GROUP BY tag""")
def tag_counts(spark, folder):
    return metrics.tag_counts(metrics.confusion(inputs.tagged_sentences(spark, folder)))


@query("tag_confusion", f"""WITH {SENTENCES_SQL}
SELECT gold, pred, count(*) AS n FROM tagged GROUP BY gold, pred""")
def tag_confusion(spark, folder):
    return metrics.confusion(inputs.tagged_sentences(spark, folder))


REPORT_SQL = """
side_rows AS (SELECT gold AS label, (gold = pred)::INT AS c, 1 AS g, 0 AS p FROM pairs
  UNION ALL SELECT pred, 0, 0, 1 FROM pairs),
per_label AS (SELECT label, sum(c) AS c, sum(g) AS g, sum(p) AS p FROM side_rows GROUP BY label),
scored AS (SELECT *, coalesce(c::DOUBLE / nullif(p, 0), 0) AS pr, coalesce(c::DOUBLE / nullif(g, 0), 0) AS re,
  coalesce((2 * c)::DOUBLE / nullif(g + p, 0), 0) AS f FROM per_label)
SELECT label, round(pr, 4) AS precision, round(re, 4) AS recall, round(f, 4) AS f1, g::BIGINT AS support FROM scored
UNION ALL SELECT 'accuracy', round(sum(c)::DOUBLE / sum(g), 4), round(sum(c)::DOUBLE / sum(g), 4),
  round(sum(c)::DOUBLE / sum(g), 4), sum(g)::BIGINT FROM scored
UNION ALL SELECT 'macro avg', round(avg(pr), 4), round(avg(re), 4), round(avg(f), 4), sum(g)::BIGINT FROM scored
UNION ALL SELECT 'weighted avg', round(sum(pr * g) / sum(g), 4), round(sum(re * g) / sum(g), 4),
  round(sum(f * g) / sum(g), 4), sum(g)::BIGINT FROM scored"""


@query("tag_report", f"WITH {SENTENCES_SQL}, pairs AS (SELECT gold, pred FROM tagged), {REPORT_SQL}")
def tag_report(spark, folder):
    return metrics.label_report(metrics.confusion(inputs.tagged_sentences(spark, folder)), digits=4)


def summary_sql(extra: str = "") -> str:
    return f"""WITH {SENTENCES_SQL}, {counts_sql('doc_id, sent', 'pos')},
kinds_all AS (SELECT false AS overall, type, correct, gold, pred FROM counts
  UNION ALL SELECT true, 'ALL', sum(correct), sum(gold), sum(pred) FROM counts),
pairs AS (SELECT gold, pred FROM tagged {extra}),
toks AS (SELECT count(*) AS tokens, round(100.0 * avg((gold = pred)::INT), 4) AS accuracy,
  round(100.0 * sum((gold = pred AND gold <> 'O')::INT)::DOUBLE / nullif(sum((gold <> 'O')::INT), 0), 4)
    AS accuracy_inside FROM pairs)
SELECT overall, {COUNTS}, {PRF_SQL}, CASE WHEN overall THEN tokens END AS tokens,
  CASE WHEN overall THEN accuracy END AS accuracy,
  CASE WHEN overall THEN accuracy_inside END AS accuracy_inside FROM kinds_all, toks"""


@query("eval_summary", summary_sql())
def eval_summary(spark, folder):
    return metrics.evaluation_summary(inputs.tagged_sentences(spark, folder))


@query("eval_summary_separators", summary_sql(
    "UNION ALL SELECT 'O', 'O' FROM (SELECT DISTINCT doc_id, sent FROM tagged)"))
def eval_summary_separators(spark, folder):
    return metrics.evaluation_summary(inputs.tagged_sentences(spark, folder), separators=True)


@query("eval_report", f"""WITH s AS ({summary_sql()}),
lines AS (SELECT 0 AS part, '' AS type, printf('processed %d tokens with %d phrases; found: %d phrases; correct: %d.', tokens, gold, pred,
    correct) AS line FROM s WHERE overall
  UNION ALL SELECT 1, '', printf('accuracy: %6.2f%%; (non-O)', accuracy_inside) FROM s WHERE overall
  UNION ALL SELECT 2, '', printf('accuracy: %6.2f%%; precision: %6.2f%%; recall: %6.2f%%; FB1: %6.2f', accuracy, precision,
    recall, f1) FROM s WHERE overall
  UNION ALL SELECT 3, type, printf('%17s: precision: %6.2f%%; recall: %6.2f%%; FB1: %6.2f  %d', type, precision, recall, f1,
    pred) FROM s WHERE NOT overall)
SELECT (row_number() OVER (ORDER BY part, type) - 1)::INT AS line_no, line FROM lines""")
def eval_report(spark, folder):
    return metrics.report_lines(metrics.evaluation_summary(inputs.tagged_sentences(spark, folder)))


@query("tag_parts", f"""WITH {SENTENCES_SQL}
SELECT gold AS tag, string_split(gold, '-')[1] AS prefix,
  CASE WHEN gold <> 'O' THEN substr(gold, 3) END AS type, true AS valid, count(*) AS n FROM tagged GROUP BY gold""")
def tag_parts(spark, folder):
    tags = inputs.tagged_sentences(spark, folder).select(F.explode_outer("gold").alias("tag"))
    counted = tags.groupBy("tag").agg(F.count("*").alias("n"))
    tag = F.col("tag")
    return counted.select("tag", tag_prefix(tag).alias("prefix"), tag_type(tag).alias("type"),
                          is_valid_tag(tag).alias("valid"), "n")


@query("label_catalogue", f"""WITH {SENTENCES_SQL},
tags AS (SELECT gold AS label FROM tagged UNION SELECT pred FROM tagged)
SELECT row_number() OVER (ORDER BY label) - 1 AS label_id, label FROM tags""")
def label_catalogue(spark, folder):
    return labels.catalogue_from_data(inputs.tagged_sentences(spark, folder), "gold", "pred")


TAG_LIST_SQL = "[" + ", ".join(f"'{t}'" for t in TAGS) + "]"


@query("encode_tags", f"""WITH {SENTENCES_SQL}, {SENT_LISTS_SQL}
SELECT doc_id, sent::BIGINT AS sent,
  array_to_string(list_transform(gold, lambda t: list_position({TAG_LIST_SQL}, t) - 1), ',') AS ids,
  array_to_string(gold, ',') AS tags FROM sents""")
def encode_tags(spark, folder):
    coded = inputs.tagged_sentences(spark, folder).withColumn("__i", labels.encode_tags(F.col("gold"), TAGS))
    return coded.select("doc_id", "sent", F.array_join(F.col("__i").cast("array<string>"), ",").alias("ids"),
                        F.array_join(labels.decode_tags(F.col("__i"), TAGS), ",").alias("tags"))


def _types(name: str) -> list[str]:
    """Types of a catalogue, in id order."""
    return list(dict.fromkeys(t.split("-", 1)[1] for t in labels.fixed_catalogue(name) if t != "O"))


CATALOGUES = ["news", "social", "fine"]
MOVED_SQL = "UNION ALL ".join(
    f"""SELECT '{name}' AS catalogue, list_position({labels.fixed_catalogue(name)!r},
  CASE WHEN gold = 'O' THEN 'O' ELSE substr(gold, 1, 2) || {_types(name)!r}[1 + (list_position(['PER', 'ORG', 'LOC', 'MISC'],
    substr(gold, 3)) - 1 + tok_size) % {len(_types(name))}] END) - 1 AS label_id FROM sized """ for name in CATALOGUES)


def _moved(types: list[str]):
    kinds, names = (F.array(*[F.lit(t) for t in x]) for x in (inputs.TYPES, types))

    def move(tag, word):
        place = (F.array_position(kinds, tag_type(tag)) - 1 + F.char_length(word)) % len(types)
        return F.when(tag == "O", tag).otherwise(F.concat(F.substring(tag, 1, 2), F.element_at(names, place.cast("int") + 1)))

    return move


@query("fixed_catalogues", f"""WITH {SENTENCES_SQL},
sized AS (SELECT gold, length(tok) AS tok_size FROM tagged), moved AS ({MOVED_SQL})
SELECT catalogue, label_id::INT AS label_id, count(*) AS n FROM moved GROUP BY catalogue, label_id""")
def fixed_catalogues(spark, folder):
    """Tags in the types of every fixed catalogue, encoded with it: a token's type moves on by the token's length."""
    rows = inputs.tagged_sentences(spark, folder)
    coded = [F.struct(F.lit(name).alias("catalogue"), labels.encode_tags(
        F.zip_with("gold", "tokens", _moved(_types(name))), labels.fixed_catalogue(name)).alias("ids")) for name in CATALOGUES]
    each = rows.select(F.inline(F.array(*coded))).select("catalogue", F.explode_outer("ids").alias("label_id"))
    return each.groupBy("catalogue", "label_id").agg(F.count("*").alias("n"))


KSHOT_SQL = f"""WITH {SENTENCES_SQL},
kinds3 AS (SELECT doc_id, sent, min(gold) FILTER (gold <> 'O') AS least FROM tagged GROUP BY doc_id, sent
  HAVING count(DISTINCT gold) = 3 AND bool_or(starts_with(gold, 'I-'))),
shots AS (SELECT doc_id, sent::BIGINT AS sent, substr(least, 3) AS type,
  row_number() OVER (PARTITION BY substr(least, 3) ORDER BY doc_id, sent) AS n FROM kinds3)"""


@query("kshot", f"{KSHOT_SQL} SELECT doc_id, sent, type FROM shots WHERE n <= 16")
def kshot(spark, folder):
    chosen = labels.kshot(inputs.tagged_sentences(spark, folder), 16, ["doc_id", "sent"], "gold")
    return chosen.select("doc_id", "sent", "type")


@query("kshot_by_prefix", f"{KSHOT_SQL} SELECT doc_id, sent, type FROM shots WHERE n <= 64")
def kshot_by_prefix(spark, folder):
    chosen = labels.kshot_by_prefix(inputs.tagged_sentences(spark, folder), 64, ["doc_id", "sent"], "gold")
    return chosen.select("doc_id", "sent", "type")


@query("kshot_distribution", f"""{KSHOT_SQL}
SELECT t.type, count(s.type) AS n
FROM (VALUES (''), ('PER'), ('ORG'), ('LOC'), ('MISC')) t(type) LEFT JOIN shots s ON s.type = t.type AND s.n <= 64
GROUP BY t.type""")
def kshot_distribution(spark, folder):
    chosen = labels.kshot(inputs.tagged_sentences(spark, folder), 64, ["doc_id", "sent"], "gold")
    return labels.kshot_distribution(chosen, labels.catalogue_frame(spark, TAGS))


@query("kshot_tokens", f"""{KSHOT_SQL}, {SENT_LISTS_SQL}
SELECT doc_id, sent::BIGINT AS sent, array_to_string(toks, ' ') AS text FROM sents
SEMI JOIN (SELECT doc_id AS d, sent AS s FROM shots WHERE n <= 4) c ON d = doc_id AND s = sent""")
def kshot_tokens(spark, folder):
    sentences = inputs.tagged_sentences(spark, folder)
    chosen = labels.kshot(sentences, 4, ["doc_id", "sent"], "gold")
    return labels.select_rows(sentences, chosen, ["doc_id", "sent"]).select(
        "doc_id", "sent", F.array_join("tokens", " ").alias("text"))


LENGTH = 64
PIECES_SQL = f"""{SENTENCES_SQL}, {SENT_LISTS_SQL},
cut AS (SELECT *, list_transform(list_zip(toks, gold, pred), lambda z: {{
    'k': greatest((length(z[1]) + 3) // 4, 0), 'g': list_position({TAG_LIST_SQL}, z[2]) - 1,
    'p': list_position({TAG_LIST_SQL}, z[3]) - 1, 't': z[1]}}) AS w FROM sents),
sub AS (SELECT doc_id, sent,
  flatten(list_transform(w, lambda x: list_transform(range(x.k), lambda i: substr(x.t, (4 * i + 1)::INT, 4))))
    AS pieces,
  flatten(list_transform(w, lambda x, n: list_transform(range(x.k), lambda i: n - 1))) AS word_ids,
  flatten(list_transform(w, lambda x: list_transform(range(x.k), lambda i: CASE WHEN i = 0 THEN x.g ELSE -100 END)))
    AS sub_labels,
  flatten(list_transform(w, lambda x: list_transform(range(x.k), lambda i: x.p))) AS sub_pred FROM cut)"""


def _label_sentences(spark, folder):
    return inputs.tagged_sentences(spark, folder).withColumn("ids", labels.encode_tags(F.col("gold"), TAGS))


def _joined(column) -> F.Column:
    return F.array_join(F.col(column).cast("array<string>"), ",", "-")


@query("subword_labels", f"""WITH {PIECES_SQL}
SELECT doc_id, sent::BIGINT AS sent, array_to_string(list_resize(sub_labels, {LENGTH}, -100), ',') AS sub_labels,
  array_to_string(list_transform(list_resize(word_ids, {LENGTH}), lambda x: coalesce(x::VARCHAR, '-')), ',')
    AS word_ids,
  array_to_string(list_resize(pieces, {LENGTH}, ''), ',') AS pieces FROM sub""")
def subword_labels(spark, folder):
    rows = labels.subword_rows(_label_sentences(spark, folder), "tokens", "ids", LENGTH)
    return rows.select("doc_id", "sent", _joined("sub_labels").alias("sub_labels"),
                       _joined("word_ids").alias("word_ids"), F.array_join("pieces", ",").alias("pieces"))


@query("subword_labels_special", f"""WITH {PIECES_SQL}
SELECT doc_id, sent::BIGINT AS sent,
  array_to_string(list_resize(list_concat([-100], sub_labels[1:{LENGTH - 2}], [-100]), {LENGTH}, -100), ',') AS sub_labels,
  array_to_string(list_transform(list_resize(list_concat([NULL], word_ids[1:{LENGTH - 2}]), {LENGTH}),
    lambda x: coalesce(x::VARCHAR, '-')), ',') AS word_ids,
  array_to_string(list_resize(list_concat(['<s>'], pieces[1:{LENGTH - 2}], ['</s>']), {LENGTH}, ''), ',') AS pieces,
  array_to_string(list_transform(range({LENGTH}), lambda i: (i = 0 OR i > len(pieces[1:{LENGTH - 2}]))::INT), ',')
    AS special_tokens_mask FROM sub""")
def subword_labels_special(spark, folder):
    """Sub-word rows between two special pieces."""
    rows = labels.subword_rows(_label_sentences(spark, folder), "tokens", "ids", LENGTH, before=["<s>"], after=["</s>"])
    return rows.select("doc_id", "sent", _joined("sub_labels").alias("sub_labels"), _joined("word_ids").alias("word_ids"),
                       F.array_join("pieces", ",").alias("pieces"), _joined("special_tokens_mask").alias("special_tokens_mask"))


# three quarters of the substrings of up to five characters, drawn by their hash, are pieces: those that begin words, and inner ones
def _known_sql(piece: str) -> str:
    return f"('0x' || substr(md5({piece}), 1, 1))::INT < 12"


VOCABULARY_SQL = f"""{SENTENCES_SQL}, {SENT_LISTS_SQL},
words_ AS MATERIALIZED (SELECT DISTINCT tok AS word FROM tagged),
places AS MATERIALIZED (SELECT word, a::INT AS a, max(n)::INT AS n FROM (SELECT word, a, unnest(range(1, least(5, length(word) - a + 1) + 1)) AS n
    FROM (SELECT word, unnest(range(1, length(word) + 1)) AS a FROM words_))
  WHERE {_known_sql("CASE WHEN a > 1 THEN '##' ELSE '' END || substr(word, a::INT, n::INT)")} GROUP BY word, a),
walk(word, a, pieces) AS (SELECT word, 1, []::VARCHAR[] FROM words_
  UNION ALL SELECT w.word, w.a + p.n, list_append(pieces, substr(w.word, w.a, p.n)) FROM walk w JOIN places p ON p.word = w.word AND p.a = w.a),
whole AS MATERIALIZED (SELECT word, pieces FROM walk WHERE a = length(word) + 1),
cutting AS MATERIALIZED (SELECT w.word, coalesce(pieces, ['[UNK]']) AS pieces FROM words_ w LEFT JOIN whole USING (word)),
sub AS (SELECT doc_id, sent, flatten(list(pieces ORDER BY pos)) AS pieces,
  flatten(list(list_transform(pieces, lambda x, i: CASE WHEN i = 1 THEN list_position({TAG_LIST_SQL}, gold) - 1 ELSE -100 END) ORDER BY pos)) AS sub_labels
  FROM tagged JOIN cutting ON word = tok GROUP BY doc_id, sent)"""


@query("subword_vocab_labels", f"""WITH RECURSIVE {VOCABULARY_SQL}
SELECT doc_id, sent::BIGINT AS sent, array_to_string(list_resize(sub_labels, {LENGTH}, -100), ',') AS sub_labels,
  array_to_string(list_resize(pieces, {LENGTH}, ''), ',') AS pieces FROM sub""")
def subword_vocab_labels(spark, folder):
    """Words cut by the longest pieces of a vocabulary that the table's own words yield."""
    rows = stored(_label_sentences(spark, folder).select("doc_id", "sent", "tokens", "ids"), "label-sentences")  # read four times
    words = rows.select(F.explode_outer("tokens").alias("word")).where("word IS NOT NULL").distinct()
    size, at = F.char_length("word"), F.col("a")
    each = words.select("word", F.explode(F.sequence(F.lit(1), size)).alias("a")).select(
        "word", "a", F.explode(F.sequence(F.lit(1), F.least(F.lit(5), size - at + 1))).alias("n"))
    pieces = each.select(F.substring(F.col("word"), at, F.col("n")).alias("piece"), (at > 1).alias("inner")).distinct()
    marked = F.concat(F.when(F.col("inner"), "##").otherwise(""), "piece")
    known = stored(pieces.where(md5_number(marked, digits=1) < 12), "pieces")  # read for the hot pieces and the others
    cut = labels.vocabulary_pieces(rows, known, ["doc_id", "sent"], longest=5, keep=["tokens", "ids"])
    made = labels.subword_rows(cut, "tokens", "ids", LENGTH, pieces="cut")
    return made.select("doc_id", "sent", _joined("sub_labels").alias("sub_labels"), F.array_join("pieces", ",").alias("pieces"))


@query("features", f"""WITH {PIECES_SQL},
coded AS (SELECT doc_id, sent, sub_labels, list_transform(pieces, lambda p: ('0x' || substr(md5(p), 1, 4))::INT + 1)
  AS ids FROM sub)
SELECT doc_id, sent::BIGINT AS sent, array_to_string(list_resize(ids, 48, 0), ',') AS input_ids,
  array_to_string(list_transform(range(48), lambda i: (i < len(ids))::INT), ',') AS attention_mask,
  array_to_string(list_resize(list_reverse(ids[1:48]), 48, 0), ',') AS input_ids_backward,
  array_to_string(list_resize(sub_labels, 48, -100), ',') AS labels FROM coded""")
def features(spark, folder):
    rows = labels.subword_rows(_label_sentences(spark, folder), "tokens", "ids", None)
    coded = rows.select("doc_id", "sent", "sub_labels", md5_numbers(F.col("pieces"), digits=4, first=1).alias("ids"))
    made = labels.features(coded, 48, 0, "ids", "sub_labels")
    return made.select("doc_id", "sent", *[_joined(c).alias(c) for c in (
        "input_ids", "attention_mask", "input_ids_backward", "labels")])


@query("drop_ignored", f"""WITH {PIECES_SQL},
flat AS (SELECT unnest(sub_labels) AS gold, unnest(sub_pred) AS pred, generate_subscripts(sub_pred, 1) - 1 AS pos
  FROM sub)
SELECT gold::BIGINT AS gold, pred::BIGINT AS pred, count(*) AS n, sum(pos)::BIGINT AS places FROM flat
WHERE gold <> -100 GROUP BY gold, pred""")
def drop_ignored(spark, folder):
    rows = _label_sentences(spark, folder).withColumn("pids", labels.encode_tags(F.col("pred"), TAGS))
    cut = labels.subword_rows(rows, "tokens", "ids", None)
    guessed = cut.withColumn("sub_pred", F.transform("word_ids", lambda w: F.col("pids")[w]))
    kept = labels.drop_ignored(guessed, "sub_labels", "sub_pred", ["doc_id", "sent"])
    return kept.groupBy(F.col("gold").cast("bigint").alias("gold"), F.col("pred").cast("bigint").alias("pred")).agg(
        F.count("*").alias("n"), F.sum("pos").alias("places"))


RENDER_SQL = f"""WITH {SENTENCES_SQL},
shown AS (SELECT *, string_split(gold, '-')[-1] AS y, lag(string_split(gold, '-')[-1]) OVER s AS b,
  CASE WHEN gold = 'O' THEN '' ELSE gold END AS gv, CASE WHEN pred = 'O' THEN '' ELSE pred END AS pv
  FROM tagged WINDOW s AS (PARTITION BY doc_id, sent ORDER BY pos))"""


@query("render_annotations", f"""{RENDER_SQL},
cells AS (SELECT doc_id, sent, pos, CASE WHEN y IS NOT DISTINCT FROM b THEN ' ' ELSE '|' END AS gap, tok, gv,
  greatest(length(tok), length(gold)) AS w FROM shown)
SELECT doc_id, sent::BIGINT AS sent,
  string_agg(gap || tok || repeat(' ', w - length(tok)), '' ORDER BY pos) || '|' AS token_row,
  string_agg(gap || gv || repeat(' ', w - length(gv)), '' ORDER BY pos) || '|' AS tag_row
FROM cells GROUP BY doc_id, sent""")
def render_annotations(spark, folder):
    rows = render.annotation_rows(inputs.tagged_sentences(spark, folder), "tokens", "gold")
    return rows.select("doc_id", "sent", "token_row", "tag_row")


@query("render_predictions", f"""{RENDER_SQL},
cells AS (SELECT *, greatest(length(tok), length(gv), length(pv)) AS w FROM shown)
SELECT doc_id, sent::BIGINT AS sent,
  '|' || string_agg(tok || repeat(' ', w - length(tok)) || '|', '' ORDER BY pos) AS token_row,
  '|' || string_agg(pv || repeat(' ', w - length(pv)) || '|', '' ORDER BY pos) AS pred_row,
  '|' || string_agg(gv || repeat(' ', w - length(gv)) || '|', '' ORDER BY pos) AS gold_row
FROM cells GROUP BY doc_id, sent""")
def render_predictions(spark, folder):
    rows = render.prediction_rows(inputs.tagged_sentences(spark, folder))
    return rows.select("doc_id", "sent", "token_row", "pred_row", "gold_row")


@query("prediction_lines", f"""WITH {SENTENCES_SQL}
SELECT doc_id, sent::BIGINT AS sent,
  string_agg(tok || ' dummy ' || gold || ' ' || pred, chr(10) ORDER BY pos) AS lines FROM tagged GROUP BY doc_id, sent""")
def prediction_lines(spark, folder):
    text = tagged.prediction_text(F.col("tokens"), F.col("gold"), F.col("pred"))
    return inputs.tagged_sentences(spark, folder).select("doc_id", "sent", text.alias("lines"))


def _numbered(rows):
    """Tokens and tags, joined as texts, numbered over all files."""
    runs = rows.withColumn("run", F.shiftright("sent_id", 12))
    return dense_index(runs, "place", ["file", "sent_id"], bucket=["file", "run"]).select("place", "tokens", "tags")


@query("tagged_file_round_trip", f"""WITH {SENTENCES_SQL}, {SENT_LISTS_SQL}
SELECT row_number() OVER (ORDER BY doc_id, sent) - 1 AS place, array_to_string(toks, ' ') AS tokens,
  array_to_string(gold, ' ') AS tags FROM sents""")
def tagged_file_round_trip(spark, folder):
    """Write tagged text in order, read it back, number the sentences over all files."""
    path = shared_dir(spark, "tagged-text")
    sentences = inputs.tagged_sentences(spark, folder, ranged=True, columns=["tokens", "gold"])
    tagged.write_sentences(sentences, tagged.tagged_text(F.col("tokens"), F.col("gold")), path, ["doc_id", "sent"], ranged=True)
    return _numbered(tagged.read_tagged(spark, path, joined=" "))


MARKED_SQL = SENT_LISTS_SQL.replace("list(tok ORDER BY pos)", "list(CASE WHEN pos % 5 = 1 THEN chr(1) || tok ELSE tok END ORDER BY pos)")


@query("tagged_crlf", f"""WITH {SENTENCES_SQL}, {MARKED_SQL}
SELECT row_number() OVER (ORDER BY doc_id, sent) - 1 AS place, array_to_string(toks, ' ') AS tokens,
  array_to_string(gold, ' ') AS tags FROM sents""")
def tagged_crlf(spark, folder):
    """As above, with CR LF line ends, white space on blank lines and control characters in tokens."""
    path = shared_dir(spark, "tagged-text")
    sentences = inputs.tagged_sentences(spark, folder, ranged=True, columns=["tokens", "gold"]).withColumn("tokens", inputs.with_control(F.col("tokens")))
    tagged.write_sentences(sentences, tagged.tagged_text(F.col("tokens"), F.col("gold")), path, ["doc_id", "sent"], "\r\n", " \t", ranged=True)
    return _numbered(tagged.read_tagged(spark, path, joined=" "))


@query("prediction_crlf", f"""WITH {SENTENCES_SQL}, {counts_sql('doc_id, sent', 'pos')}
SELECT {COUNTS}, {PRF_SQL} FROM counts""")
def prediction_crlf(spark, folder):
    """Predictions with CR LF line ends and white space on blank lines, read back and scored."""
    path = shared_dir(spark, "predictions")
    text = tagged.prediction_text(F.col("tokens"), F.col("gold"), F.col("pred"))
    tagged.write_sentences(inputs.tagged_sentences(spark, folder, ranged=True), text, path, ["doc_id", "sent"], "\r\n", "  ", ranged=True)
    return metrics.with_prf(spans.chunk_counts(tagged.read_predictions(spark, path)), digits=4)


@query("prediction_file_eval", f"""WITH {SENTENCES_SQL}, {counts_sql('doc_id, sent', 'pos')}
SELECT {COUNTS}, {PRF_SQL} FROM counts""")
def prediction_file_eval(spark, folder):
    """Write predictions as text, read the file back and score it."""
    path = shared_dir(spark, "predictions")
    sentences = inputs.tagged_sentences(spark, folder, ranged=True)
    text = tagged.prediction_text(F.col("tokens"), F.col("gold"), F.col("pred"))
    tagged.write_sentences(sentences, text, path, ["doc_id", "sent"], ranged=True)
    return metrics.with_prf(spans.chunk_counts(tagged.read_predictions(spark, path)), digits=4)


# every fifth sentence has its first gold tag spoilt
SPOILT_SQL = f"""{SENTENCES_SQL.replace('tagged AS (', 'tagged_s AS (')},
tagged AS (SELECT doc_id, sent, pos, tok, CASE WHEN pos = 0 AND (doc_id + sent) % 5 = 0 THEN 'NN' ELSE gold END AS gold, pred
  FROM tagged_s)"""


@query("span_validity", f"""WITH {SPOILT_SQL},
checked AS (SELECT doc_id, sent, bool_and(regexp_matches(gold, '^(O|[^-]+-.+)$') AND regexp_matches(pred, '^(O|[^-]+-.+)$')) AS valid
  FROM tagged GROUP BY doc_id, sent)
SELECT valid, count(*) AS n FROM checked GROUP BY valid""")
def span_validity(spark, folder):
    """How many sentences have scores, and how many count nothing because of a bad tag."""
    rows = inputs.tagged_sentences(spark, folder)
    spoilt = F.transform("gold", lambda t, i: F.when((i == 0) & ((F.col("doc_id") + F.col("sent")) % 5 == 0), "NN").otherwise(t))
    return spans.validity(rows.withColumn("gold", spoilt)).groupBy("valid").agg(F.count("*").alias("n"))


@query("processed_split", f"""WITH {SENTENCES_SQL},
train AS (SELECT * FROM tagged WHERE ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT % 10000 >= 500),
kinds3 AS (SELECT doc_id, sent, min(gold) FILTER (gold <> 'O') AS least FROM train GROUP BY doc_id, sent
  HAVING count(DISTINCT gold) = 3 AND bool_or(starts_with(gold, 'I-'))),
shots AS (SELECT doc_id, sent, row_number() OVER (PARTITION BY substr(least, 3) ORDER BY doc_id, sent) AS n FROM kinds3)
SELECT doc_id, sent::BIGINT AS sent FROM shots WHERE n <= 4""")
def processed_split(spark, folder):
    """Tagged sentences written once per split, the train split read back with four sentences per type."""
    path = shared_dir(spark, "processed")
    write_once(holdout(inputs.tagged_sentences(spark, folder), keys=["doc_id"]), path)
    return read_processed(spark, path, "train", 4, ["doc_id", "sent"], "gold").select("doc_id", "sent")
