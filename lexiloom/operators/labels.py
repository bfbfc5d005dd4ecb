"""Label catalogues, K-shot selection and sub-word alignment."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.arrays import fit_length, fit_mask, fit_reversed
from ..functions.subwords import fixed_word_pieces, piece_labels, piece_words, pieces_of
from ..functions.tags import tag_type_or_empty
from ..session import stored
from .catalogues import FIXED_CATALOGUES
from .ordered import dense_index, lookup
from .vocab import packed, token_counts

IGNORED = -100


def label_catalogue(types: Sequence[str], scheme: str = "BI") -> list[str]:
    """``O`` and every prefix of ``scheme`` for every type, in the given order."""
    return ["O"] + [f"{prefix}-{t}" for t in types for prefix in scheme]


def fixed_catalogue(name: str) -> list[str]:
    """A fixed label list in id order; an unknown name raises."""
    if name not in FIXED_CATALOGUES:
        raise ValueError(f"no label catalogue for {name!r}; known: {sorted(FIXED_CATALOGUES)}")
    return FIXED_CATALOGUES[name]


def catalogue_frame(spark: SparkSession, labels: Sequence[str]) -> DataFrame:
    """``(label_id, label)`` of a label list."""
    return spark.createDataFrame(list(enumerate(labels)), "label_id bigint, label string")


def catalogue_from_data(df: DataFrame, *tags: str) -> DataFrame:
    """``(label_id, label)`` of all tags in the data, ids by sorted label, one catalogue for all splits.

    Tags are made distinct per sentence and per task before the shuffle. The final numbering is over the
    label set, whose size is that of a tag scheme and does not grow with the sentences.
    """
    distinct = F.array_distinct(F.concat(*[F.col(t) for t in tags]))
    labels = df.select(F.explode_outer(distinct).alias("label")).where("label IS NOT NULL").distinct()
    return labels.select((F.row_number().over(Window.orderBy("label")) - 1).cast("bigint").alias("label_id"),
                         "label")


def encode_tags(tags: Column, labels: Sequence[str]) -> Column:
    """Tags as label ids; a tag outside the catalogue raises, as a lookup would."""
    places = {x: i for i, x in reversed(list(enumerate(labels)))}  # a label's first place
    known = F.create_map(*[F.lit(x) for pair in places.items() for x in pair])
    return F.transform(tags, lambda t: F.coalesce(known[t], F.raise_error(F.concat(F.lit("unknown tag: "), t)).cast("int")))


def decode_tags(ids: Column, labels: Sequence[str]) -> Column:
    known = F.array(*[F.lit(x) for x in labels])
    return F.transform(ids, lambda i: F.element_at(known, i.cast("int") + 1))


def kshot_type(tags: Column) -> Column:
    """The entity type a sentence counts for, NULL if it is not eligible.

    Eligible: exactly three different tags, one of them beginning with ``I-``. The type is that of the
    smallest tag other than ``O``.
    """
    kinds = F.array_distinct(tags)
    eligible = (F.size(kinds) == 3) & F.exists(kinds, lambda t: t.startswith("I-"))
    return F.when(eligible, tag_type_or_empty(F.array_min(F.filter(kinds, lambda t: t != "O"))))


#: runs into which the sentences of a type are dealt for the first cut
KSHOT_RUNS = 64


def kshot(df: DataFrame, k: int, order: Sequence[str], tags: str = "tags") -> DataFrame:
    """The first ``k`` eligible sentences of every type, in ``order``; adds ``type``.

    ``order`` names a row. Only these keys are ranked: first inside ``KSHOT_RUNS`` runs per type, so that a type
    that holds most sentences is many tasks, then among the runs' first ``k``. The chosen keys, ``k`` of each type, are
    broadcast, and the rows meet them where they stand; for a ``k`` too large for that see :func:`kshot_by_prefix`.
    """
    kind = kshot_type(F.col(tags))
    typed = df.select(*order, kind.alias("type")).where(F.col("type").isNotNull())
    run = F.pmod(F.xxhash64(*order), F.lit(KSHOT_RUNS))
    first = typed.withColumn("__run", run)
    for group in (["type", "__run"], ["type"]):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        first = first.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")
    return df.join(F.broadcast(first.drop("__run")), list(order)).select(*df.columns, "type")


def kshot_by_prefix(df: DataFrame, k: int, order: Sequence[str], tags: str = "tags", bits: int = 12) -> DataFrame:
    """As :func:`kshot` for a ``k`` of any size: ranks come from bucketed counts, not from one window."""
    typed = df.withColumn("type", kshot_type(F.col(tags))).where(F.col("type").isNotNull())
    return dense_index(typed, "__rank", order, ["type"], bits=bits).where(F.col("__rank") < k).drop("__rank")


def kshot_distribution(selected: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Selected sentences per type of the catalogue, zeros and the empty type of ``O`` included."""
    types = catalogue.select(tag_type_or_empty(F.col("label")).alias("type")).distinct()
    counts = selected.groupBy("type").agg(F.count("*").alias("n"))
    return types.join(counts, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


def select_rows(df: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is in ``chosen``."""
    return df.join(chosen.select(*keys), list(keys), "left_semi")


UNKNOWN_PIECE = "[UNK]"


def cut_words(words: DataFrame, vocabulary: DataFrame, word: str = "word", unknown: str = UNKNOWN_PIECE, longest: int = 16) -> DataFrame:
    """``(word, pieces)`` of distinct words: at every place the longest piece of ``vocabulary`` (piece, inner) that fits.

    ``inner`` pieces go on a word, the others begin one. A word that cannot be cut to its end is one ``unknown`` piece.
    Words are packed, and each distinct substring of a pack of up to ``longest`` characters meets the vocabulary once; a task
    walks the words of a pack by the pieces that were found. A substring that very many packs share is answered in place
    (:func:`lookup`).
    """
    kind = "__pack string, __words array<string>, __parts array<struct<piece:string,inner:boolean>>"
    packs = stored(words.select(word).mapInArrow(partial(_word_packs, longest=longest), kind), "word-packs")  # a pack's name is drawn
    parts = packs.select("__pack", F.inline("__parts"))
    weighed = vocabulary.select("piece", "inner", F.lit(True).alias("__known"), (-F.char_length("piece")).alias("__weight"))  # short pieces are shared most
    met = lookup(parts, weighed, ["piece", "inner"], "__weight", spread=["__pack", "piece"], how="inner")
    known = met.groupBy("__pack").agg(F.collect_set(F.struct("piece", "inner")).alias("__pieces"))
    whole = packs.select("__pack", "__words").join(known, "__pack", "left").select("__words", "__pieces")
    return whole.mapInArrow(partial(_walked, word=word, unknown=unknown, longest=longest), f"`{word}` string, pieces array<string>")


# characters of words that are cut as one
PACK_LETTERS = 1 << 18


def _word_packs(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """Words of about ``PACK_LETTERS`` characters as one row, with their distinct substrings: those that begin a word, and inner ones."""
    held: list[str | None] = []
    letters = 0

    def pack() -> pa.RecordBatch:
        first, inner = set(), set()
        for w in held:
            for at in range(len(w or "")):
                (inner if at else first).update(w[at:end] for end in range(at + 1, min(at + longest, len(w)) + 1))
        parts = pa.StructArray.from_arrays([pa.array([*first, *inner], pa.string()), pa.array([False] * len(first) + [True] * len(inner), pa.bool_())],
                                           names=["piece", "inner"])
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.array(held, pa.string()), parts)]
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *lists], names=["__pack", "__words", "__parts"])

    for batch in batches:
        for w in batch.column(0).to_pylist():
            held.append(w)
            letters += len(w or "") + 1
            if letters >= PACK_LETTERS:
                yield pack()
                held, letters = [], 0
    if held:
        yield pack()


def _walked(batches: Iterator[pa.RecordBatch], word: str, unknown: str, longest: int) -> Iterator[pa.RecordBatch]:
    """Every word of the packs with its pieces."""
    for batch in batches:
        for k in range(batch.num_rows):
            pieces = batch.column("__pieces")[k].values
            known = [set(), set()]
            if pieces is not None:
                for piece, inner in zip(pieces.field("piece").to_pylist(), pieces.field("inner").to_pylist()):
                    known[inner].add(piece)
            words, out = batch.column("__words")[k].as_py(), []
            for w in words:
                cut, at = [], 0
                while w and at < len(w):
                    found = next((w[at:end] for end in range(min(at + longest, len(w)), at, -1) if w[at:end] in known[at > 0]), None)
                    if found is None:
                        break
                    cut.append(found)
                    at += len(found)
                out.append(cut if w and at == len(w) else [unknown])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(out, pa.list_(pa.string()))], names=[word, "pieces"])


def vocabulary_pieces(df: DataFrame, vocabulary: DataFrame, keys: Sequence[str], tokens: str = "tokens", out: str = "cut",
                      unknown: str = UNKNOWN_PIECE, longest: int = 16, keep: Sequence[str] = ()) -> DataFrame:
    """``(*keys, out)``: every token of a row as its pieces (array of arrays). Only distinct words are cut.

    With ``keep`` the rows themselves, ``(*keys, *keep, out)``, joined before the pieces become arrays.

    ``keys`` name a row. Rows are packed (:func:`.vocab.packed`) and each distinct token of a pack is looked up once; pieces go
    back to the rows as texts and lengths, and are cut out where the rows end.
    """
    if max(longest, len(unknown)) >= _FIRST:
        raise ValueError(f"pieces of {_FIRST} characters or more")
    counted = stored(token_counts(df, tokens).withColumnRenamed("token", "word"), "word-counts")
    # pieces travel as their lengths; those of an unknown word do not make up the word
    lengths = F.when(F.array_join("pieces", "") == F.col("word"), F.transform("pieces", lambda p: F.char_length(p)))
    table = stored(counted.join(cut_words(counted, vocabulary, "word", unknown, longest), "word").select("word", "count", lengths.alias("lengths")), "word-pieces")
    packs = packed(df, keys, tokens)
    distinct = packs.select("__pack", F.posexplode("__distinct").alias("__code", "word"))
    found = lookup(distinct, table, ["word"], "count", spread=["__pack", "__code"], how="left")
    cuts = found.groupBy("__pack").agg(F.collect_list(F.struct("__code", "lengths")).alias("__cuts"))
    whole = packs.join(cuts, "__pack", "left").drop("__pack")
    kind = T.StructType([T.StructField("__key", packs.schema["__keys"].dataType.elementType), *_ROW_CUT.fields])
    # the outer form: the plain one adds a filter on the array's size, which would cut the rows once more
    single = whole.select(F.inline_outer(_cut_rows(kind, unknown)(*whole.columns)))
    each = single.select("__key.*", F.struct(*_ROW_CUT.names).alias("__l")).groupBy(*keys).agg(F.collect_list("__l").alias("__l"))
    rows = df.select(*keys, *keep).join(each, list(keys)) if keep else each  # a Python step would hide that they are dealt out alike
    return rows.select(*keys, *keep, _expanded(F.col("__l")).alias(out))


#: a row's cut: the pieces' texts in one, and two bytes per piece: its characters, with ``_FIRST`` for the first of a token (alone: a null token)
_ROW_CUT = T.StructType([T.StructField("__text", T.StringType()), T.StructField("__form", T.BinaryType())])
_FIRST = 1 << 15


def _runs(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``starts``, one run after the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _cut_rows(kind: T.StructType, unknown: str):
    """A function of the columns of packs: their rows with the cuts of their tokens."""
    def cut_pack(keys: pa.Array, sizes: pa.Array, codes: pa.Array, distinct: pa.Array, cuts: pa.Array | None) -> pa.StructArray:
        n = len(distinct)
        # by token: its text, its number of pieces, and where their lengths are; the last entry is that of a null token
        order = np.zeros(n, np.int64) if cuts is None else np.argsort(cuts.field("__code").to_numpy())
        found = pa.array([], pa.list_(pa.int32())) if cuts is None else cuts.field("lengths").take(pa.array(order))
        lost = found.is_null().to_numpy(zero_copy_only=False)
        found = pc.if_else(pa.array(lost), pa.scalar([len(unknown)], pa.list_(pa.int32())), found)
        text = pa.concat_arrays([pc.if_else(pa.array(lost), unknown, distinct).cast(pa.string()), pa.array([""])])
        pieces = np.append(pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64), 0)
        flat = pc.list_flatten(found).to_numpy(zero_copy_only=False)
        code = codes.to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.where(code < 0, n, code)
        per, size = pieces[code], sizes.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.append(0, np.cumsum(size))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), text.take(pa.array(code))), "")
        form = np.append(flat, 0)[_runs(np.maximum(per, 1), np.where(per > 0, (np.cumsum(pieces) - pieces)[code], len(flat)))].astype("<u2")
        begins = np.append(0, np.cumsum(np.maximum(per, 1)))
        form[begins[:-1]] |= _FIRST
        forms = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((2 * begins[ends]).astype(np.int32)), pa.py_buffer(form)])
        return pa.StructArray.from_arrays([keys, texts, forms], names=kind.names)

    @F.arrow_udf(T.ArrayType(kind))
    def cut(*columns: pa.Array) -> pa.Array:
        rows = [cut_pack(*(c[k].values for c in columns)) for k in range(len(columns[0]))]
        ends = np.append(0, np.cumsum([len(x) for x in rows], dtype=np.int64))
        values = pa.concat_arrays(rows) if rows else pa.array([], to_arrow_type(kind))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    return cut


def _form(forms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The entries of the forms, and where each form's begin."""
    parts = forms.to_pylist()
    return np.frombuffer(b"".join(parts), "<u2"), np.append(0, np.cumsum([len(x) // 2 for x in parts], dtype=np.int64))


def _expanded(cuts: Column) -> Column:
    """The pieces of the tokens of a key's rows; those of several rows by place in their row, then by pieces."""
    kind = pa.list_(pa.list_(pa.string()))

    def tokens_of(rows: pa.StructArray) -> pa.ListArray:
        """One list per row; a null token is a null."""
        form, ends = _form(rows.field("__form"))
        begins = np.append(np.flatnonzero(form & _FIRST), len(form))
        null = form[begins[:-1]] == _FIRST
        solid = form != _FIRST
        flat = pieces_of(rows.field("__text"), (form[solid] & (_FIRST - 1)).astype(np.int64))
        inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(solid))[begins], pa.int32()), flat, mask=pa.array(null))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(begins, ends), pa.int32()), inner)

    def merged(parts: list) -> list:
        placed = [(k, token) for part in parts for k, token in enumerate(part) if token is not None]
        return [token for _, token in sorted(placed)]

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def expanded(lists: pa.Array) -> pa.Array:
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        made = tokens_of(pc.list_flatten(lists))
        if (counts == 1).all() and not pc.list_flatten(made).null_count:
            return made.cast(kind)
        rows, ends = made.to_pylist(), np.append(0, np.cumsum(counts))
        return pa.array([merged(rows[a:b]) for a, b in zip(ends[:-1], ends[1:])], kind)

    return expanded(cuts)


def subword_rows(df: DataFrame, tokens: str, labels: str, length: int | None, width: int = 4,
                 pieces: Callable[[Column], Column] | str | None = None, pad_piece: str = "", before: Sequence[str] = (),
                 after: Sequence[str] = ()) -> DataFrame:
    """Add ``pieces``, ``word_ids``, ``attention_mask`` and ``sub_labels``, cut or padded to ``length``.

    The first piece of a word carries the word's label, other pieces and pads carry -100. ``pieces`` cuts a
    word (a column function) or names a column that has every token's pieces (:func:`vocabulary_pieces`); the default cuts
    every ``width`` characters. A word without pieces takes no
    place and its label is lost, as with a tokenizer that returns nothing for it. ``before`` and ``after`` are
    special pieces around every sentence: they carry -100 and no word, are counted in ``length`` and never cut, and
    ``special_tokens_mask`` marks them and the pads.
    """
    if pieces is None:
        flat, words, every = fixed_word_pieces(F.col(tokens), width), F.col(tokens), width
    else:
        df = df.withColumn("__pieces", F.col(pieces) if isinstance(pieces, str) else F.transform(tokens, pieces))
        flat, words, every = F.flatten("__pieces"), F.transform("__pieces", F.size), None
    kind = df.select(F.concat(F.array(F.get(labels, F.lit(0))), F.array(F.lit(IGNORED)))).schema[0].dataType.elementType
    df = df.withColumns({"pieces": flat, "word_ids": piece_words(words, every),
                         "sub_labels": piece_labels(words, F.col(labels), kind, IGNORED, every)}).drop("__pieces")
    if before or after:
        df = _with_specials(df, before, after, length)
    if length is None:
        return df.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("pieces")))
    return df.withColumns({
        "attention_mask": fit_mask(F.col("pieces"), length),
        "pieces": fit_length(F.col("pieces"), length, pad_piece),
        "word_ids": fit_length(F.col("word_ids"), length, F.lit(None).cast("int")),
        "sub_labels": fit_length(F.col("sub_labels"), length, IGNORED),
    })


def _with_specials(df: DataFrame, before: Sequence[str], after: Sequence[str], length: int | None) -> DataFrame:
    room = None if length is None else length - len(before) - len(after)
    if room is not None and room < 0:
        raise ValueError(f"{length} places hold no {len(before) + len(after)} special pieces")

    def around(name: str, first: list[Column], last: list[Column], kind: str) -> Column:
        body = F.col(name) if room is None else F.slice(name, 1, room)
        ends = [F.array(*x).cast(f"array<{kind}>") for x in (first, last)]
        return F.concat(ends[0], body, ends[1])

    b, a = len(before), len(after)
    size = F.size("pieces") if room is None else F.least(F.size("pieces"), F.lit(room))
    mask = F.concat(F.array_repeat(F.lit(1), b), F.array_repeat(F.lit(0), size), F.array_repeat(F.lit(1), a))
    return df.withColumns({
        "pieces": around("pieces", [F.lit(p) for p in before], [F.lit(p) for p in after], "string"),
        "word_ids": around("word_ids", [F.lit(None)] * b, [F.lit(None)] * a, "int"),
        "sub_labels": around("sub_labels", [F.lit(IGNORED)] * b, [F.lit(IGNORED)] * a, "int"),
        "special_tokens_mask": mask if length is None else fit_length(mask, length, 1),
    })


def features(df: DataFrame, length: int, pad_id: int = 0, ids: str = "ids", labels: str = "labels") -> DataFrame:
    """Training examples: ``input_ids``, ``attention_mask``, ``input_ids_backward``, ``labels``."""
    fitted = df.withColumns({
        "input_ids": fit_length(F.col(ids), length, F.lit(pad_id)),
        "attention_mask": fit_mask(F.col(ids), length),
        "labels": fit_length(F.col(labels), length, IGNORED),
    })
    return fitted.withColumn("input_ids_backward", fit_reversed(F.col(ids), length, F.lit(pad_id)))


def drop_ignored(df: DataFrame, gold: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """``(*keys, pos, gold, pred)``: one row per position whose gold label is not -100."""
    both = F.arrays_zip(F.col(gold).alias("gold"), F.col(pred).alias("pred"))
    return (df.select(*keys, F.posexplode_outer(both).alias("pos", "__x"))
            .where(F.col("__x.gold") != IGNORED).select(*keys, "pos", "__x.gold", "__x.pred"))
