"""Blank-line separated tagged text: reader, evaluation file, prediction writer.

Files are read line by line, by Spark's own reader: LF, CR LF and CR all end a line, and a file of any size is split
between tasks. A task gathers the lines of its byte range into sentences as they come. Only what touches the ends of a
range is not whole yet: one piece before the range's first blank line and one after its last, which meet their
neighbours on rows of (file, range). A line of white space is a blank line.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import UNICODE_SPACE
from ..session import stored

_EDGE_SPACE = f"^[{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+\\z"
# the characters of UNICODE_SPACE
SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Drop white space of every kind at both ends."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


Parse = Callable[[pa.Array, np.ndarray], tuple[list[pa.Array], np.ndarray, list[pa.Array], pa.Array]]


def _pieces(parse: Parse, names: Sequence[str]):
    """Runs of lines between blank lines, by byte range, cut into columns. The last one of a range is open: what follows it lies elsewhere."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[int, int] | None = None
        held: list[pa.Array] = []
        part = 0

        def rows(values: list[pa.Array], offsets: np.ndarray, closed: bool) -> pa.RecordBatch:
            flat = pa.concat_arrays(values) if values else pa.array([], pa.string())
            n = len(offsets) - 1
            columns, ends, extra, bad = parse(flat, offsets.astype(np.int64))
            none = pa.array(ends[1:] == ends[:-1])
            texts = [pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), c, mask=none), "\n") for c in columns]
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * n, pa.int64()), pa.array([key[1]] * n, pa.int64()), pa.array(np.arange(part, part + n)), *texts, *extra, bad, pa.array([closed] * n)],
                names=["file_key", "block", "part", *names, "bad", "closed"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            line = pc.utf8_trim(batch.column("line"), characters=SPACES)
            file, block = (batch.column(c).to_numpy() for c in ("file_key", "block"))
            begin = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), n]
            for a, b in zip(begin[:-1], begin[1:]):
                here = (int(file[a]), int(block[a]))
                if here != key:
                    if key is not None:
                        yield rows(held, np.array([0, sum(map(len, held))]), False)
                    key, held, part = here, [], 0
                values = line.slice(a, b - a)
                solid = pc.greater(pc.binary_length(values), 0)
                ends = np.flatnonzero(~solid.to_numpy(zero_copy_only=False))
                kept = values.filter(solid)
                if not len(ends):
                    held.append(kept)
                    continue
                stop = ends - np.arange(len(ends))  # solid lines before each blank one
                before = sum(map(len, held))
                yield rows([*held, kept.slice(0, stop[-1])], np.concatenate([[0], before + stop]), True)
                held, part = [kept.slice(stop[-1])], part + len(ends)
        if key is not None:
            yield rows(held, np.array([0, sum(map(len, held))]), False)

    return run


def _sentences(spark: SparkSession, path: str | Sequence[str], strict_tail: bool, parse: Parse, lists: Sequence[str], wrong: str,
               counts: Sequence[str] = (), joined: str | None = None) -> DataFrame:
    """``(file, sent_id, *lists, *counts)`` in file order; a missing final blank line handled as asked. ``joined``: as in :func:`read_tagged`.

    Lines are cut where they are read, and the cut pieces stored, a list as one text (null if empty): none of its values holds a
    line end, and an array costs by the entry wherever it goes. A path travels as its hash and comes back by byte range: it is
    much longer than most lines. A line that cannot be cut raises, ``wrong`` before it, once its sentence is known to stay.
    """
    file_key = F.xxhash64("_metadata.file_path").alias("file_key")
    lines = spark.read.text(path).select(F.col("value").alias("line"), file_key, F.col("_metadata.file_block_start").alias("block"))
    columns = [*(f"{c} string" for c in lists), *(f"{c} int" for c in counts)]
    schema = ", ".join(["file_key bigint, block bigint, part bigint", *columns, "bad string, closed boolean"])
    pieces = stored(lines.mapInArrow(_pieces(parse, [*lists, *counts]), schema), "sentence-pieces")
    border = (F.col("part") == 0) | ~F.col("closed")
    before = Window.partitionBy("file_key").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = pieces.where(border).withColumn("run", F.coalesce(F.count_if("closed").over(before), F.lit(0)))  # two rows per byte range
    each = F.struct("block", "part", *lists, *counts, "bad")
    met = (ranges.groupBy("file_key", "run").agg(F.sort_array(F.collect_list(each)).alias("p"), F.bool_or("closed").alias("closed"))
           .select("file_key", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["part"].alias("part"), *[F.when(F.size(F.array_compact(f"p.{c}")) > 0, F.array_join(f"p.{c}", "\n")).alias(c) for c in lists],
                   *[F.aggregate(f"p.{c}", F.lit(0), lambda x, y: x + y).alias(c) for c in counts], F.get(F.array_compact("p.bad"), F.lit(0)).alias("bad"), "closed"))
    # a sentence has no line if none of its lines is kept or left out
    some = F.col(lists[0]).isNotNull() | F.col("bad").isNotNull()
    for c in counts:
        some |= F.col(c) > 0
    kept = F.col("closed") if strict_tail else F.col("closed") | some
    names = ["file_key", "block", "part", *lists, *counts, "bad"]
    rows = pieces.where(~border).select(*names).unionByName(met.where(kept).select(*names))
    rows = rows.where(F.when(F.col("bad").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(wrong), "bad")).cast("boolean"))).drop("bad")
    # a range's sentences have parts without holes, so its first number makes the others: one row per byte range is joined
    sizes = rows.groupBy("file_key", "block").agg(F.min("part").alias("low"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("file_key", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("low")).alias("first"))
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), file_key)  # listed, not read
    named = first.join(F.broadcast(files), "file_key", "left")
    if joined is None:
        values = [F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.split(c, "\n", -1)).alias(c) for c in lists]
    else:
        values = [F.coalesce(F.replace(c, F.lit("\n"), F.lit(joined)), F.lit("")).alias(c) for c in lists]
    return rows.join(F.broadcast(named), ["file_key", "block"]).select("file", (F.col("first") + F.col("part")).alias("sent_id"), *values, *counts)


def _first_in(mask: np.ndarray, offsets: np.ndarray, texts: Callable[[np.ndarray], pa.Array]) -> pa.Array:
    """For each run of lines its first one of the mask, null without one."""
    at = np.flatnonzero(mask)
    run, first = np.unique(np.searchsorted(offsets, at, "right") - 1, return_index=True)
    place = np.full(len(offsets) - 1, -1)
    place[run] = np.arange(len(run))
    return texts(at[first]).cast(pa.string()).take(pa.array(place, mask=place < 0))


def _halves(lines: pa.Array, offsets: np.ndarray) -> tuple[list[pa.Array], np.ndarray, list[pa.Array], pa.Array]:
    good = pc.equal(pc.count_substring(lines, "\t"), 1)
    solid = good.to_numpy(zero_copy_only=False)
    bad = _first_in(~solid, offsets, lambda at: lines.take(pa.array(at)))
    cells = pc.list_flatten(pc.split_pattern(lines.filter(good), "\t"))
    at = np.arange(0, len(cells), 2)
    return [cells.take(pa.array(at)), cells.take(pa.array(at + 1))], np.append(0, np.cumsum(solid))[offsets], [], bad


def _last_two(reject: bool) -> Parse:
    def parse(lines: pa.Array, offsets: np.ndarray) -> tuple[list[pa.Array], np.ndarray, list[pa.Array], pa.Array]:
        cut = pc.utf8_split_whitespace(lines)  # at runs of SPACES
        ends = cut.offsets.to_numpy().astype(np.int64)
        cells, ends = cut.flatten(), ends - ends[0]
        wide = np.diff(ends) >= 3
        short = np.zeros(len(wide), bool) if reject else ~wide
        bad = _first_in(short, offsets, lambda at: pa.array([" ".join(cut[i].as_py()) for i in at.tolist()], pa.string()))
        kept = np.append(0, np.cumsum(wide))[offsets]
        last = ends[1:][wide]
        extra = [pa.array(np.diff(offsets) - np.diff(kept), pa.int32())] if reject else []
        return [cells.take(pa.array(last - 2)), cells.take(pa.array(last - 1))], kept, extra, bad

    return parse


def read_tagged(spark: SparkSession, path: str | Sequence[str], strict_tail: bool = False, joined: str | None = None) -> DataFrame:
    """``(file, sent_id, tokens, tags)`` of ``word<TAB>tag`` lines; ``sent_id`` is dense within a file.

    Consecutive blank lines give empty sentences. A line without exactly one tab raises. The last sentence
    is kept without a blank line after it; ``strict_tail=True`` loses it, as line-driven readers do. With ``joined`` tokens and
    tags are texts, their values joined by it, as ``array_join`` would make them.
    """
    return _sentences(spark, path, strict_tail, _halves, ["tokens", "tags"], "not word<TAB>tag: ", joined=joined)


def read_predictions(spark: SparkSession, path: str | Sequence[str], reject: bool = False) -> DataFrame:
    """``(file, sent_id, gold, pred)`` from white-space columns; the last two are gold and prediction.

    A line with fewer than three columns raises; with ``reject`` it is left out and counted in ``rejected``.
    """
    return _sentences(spark, path, False, _last_two(reject), ["gold", "pred"], "too few columns in line ", ["rejected"] if reject else [])


def _joined_lines(gap: str, *columns: Column | str) -> Column:
    """One line per place of a row's arrays, its values joined by ``gap``; a ``str`` stands in every line.

    Nulls, and values that a shorter array lacks, are left out.
    """
    fixed = [c if isinstance(c, str) else None for c in columns]

    @F.arrow_udf(T.StringType())
    def joined(*arrays: pa.Array) -> pa.Array:
        counts = np.stack([pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in arrays])
        size = counts.max(axis=0)
        offsets = np.append(0, np.cumsum(size))
        inner = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size)
        parts = []
        for x, n in zip(arrays, counts):
            flat = pc.list_flatten(x)
            if not np.array_equal(n, size):
                place = np.where(inner < np.repeat(n, size), np.repeat(np.cumsum(n) - n, size) + inner, -1)
                flat = flat.take(pa.array(place, mask=place < 0))
            parts.append(flat)
        void = functools.reduce(pc.and_, [x.is_null() for x in parts])
        parts[0] = pc.if_else(void, "", parts[0])  # the join would skip a place without any value altogether
        left = iter(parts)
        lines = pc.binary_join_element_wise(*[next(left) if c is None else c for c in fixed], gap, null_handling="skip")
        null = np.any([x.is_null().to_numpy(zero_copy_only=False) for x in arrays], axis=0)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lines, mask=pa.array(null)), "\n")

    return joined(*[c.cast("array<string>") for c in columns if not isinstance(c, str)])


def prediction_text(tokens: Column, gold: Column, pred: Column) -> Column:
    """``token dummy gold pred`` lines of a sentence; unequal lengths raise."""
    same = (F.size(tokens) == F.size(gold)) & (F.size(gold) == F.size(pred))
    return F.when(same, _joined_lines(" ", tokens, "dummy", gold, pred)).otherwise(
        F.raise_error(F.lit("a label is missing or left over")))


def tagged_text(tokens: Column, tags: Column) -> Column:
    """``token<TAB>tag`` lines of a sentence."""
    return _joined_lines("\t", tokens, tags)


def write_sentences(df: DataFrame, text: Column, path: str, order: Sequence[str], line_end: str = "\n", blank: str = "",
                    ranged: bool = False) -> None:
    """One text per row, a blank line after each, files in the order of ``order``. ``blank``: white space on the blank lines.

    ``ranged``: the rows come in ranges of the first column of ``order``, so that each task sorts its own.
    """
    lines = text if line_end == "\n" else F.replace(text, F.lit("\n"), F.lit(line_end))
    made = df.select(*order, lines.alias("__lines"))  # before the sort, which then moves one text per row
    ordered = made.sortWithinPartitions(*order) if ranged else made.orderBy(*order)
    ordered.select(F.col("__lines").alias("value")).write.option("lineSep", f"{line_end}{blank}{line_end}").text(path)
