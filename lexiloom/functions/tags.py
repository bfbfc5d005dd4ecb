"""Tag expressions: prefix and type, chunk borders, and chunk events inside one sentence array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import shifted_left, shifted_right

OUTSIDE = "O"


def tag_prefix(tag: Column) -> Column:
    return F.substring_index(tag, "-", 1)


def tag_type(tag: Column) -> Column:
    """Text after the first dash; NULL without one."""
    return F.when(F.instr(tag, "-") > 0, F.substr(tag, F.instr(tag, "-") + 1))


def tag_type_or_empty(tag: Column) -> Column:
    """Text after the first dash; empty without one."""
    return F.coalesce(tag_type(tag), F.lit(""))


def last_dash_type(tag: Column) -> Column:
    """Text after the last dash; the whole tag without one."""
    return F.substring_index(tag, "-", -1)


def is_valid_tag(tag: Column) -> Column:
    return (tag == OUTSIDE) | (F.instr(tag, "-") > 0)


def _opens(tag: Column) -> Column:
    return tag.startswith("B-") | tag.startswith("S-")


def _closes(tag: Column) -> Column:
    return tag.startswith("E-") | tag.startswith("S-")


def _border(before: Column, after: Column) -> Column:
    """Whether two neighbouring tags other than ``O`` belong to different chunks.

    Equal tags have equal types, so the types are cut out only where the tags differ.
    """
    return _opens(after) | _closes(before) | ((before != after) & ~tag_type(before).eqNullSafe(tag_type(after)))


def chunk_starts(before: Column, here: Column) -> Column:
    """Whether a chunk begins at the tag ``here``."""
    return (here != OUTSIDE) & ((before == OUTSIDE) | _border(before, here))


def chunk_ends(here: Column, after: Column) -> Column:
    """Whether a chunk ends at the tag ``here``."""
    return (here != OUTSIDE) & ((after == OUTSIDE) | _border(here, after))


def _around(tags: str, names: tuple[str, str, str], before: Column, after: Column) -> list[Column]:
    return [shifted_right(F.col(tags), before).alias(names[0]), F.col(tags).alias(names[1]),
            shifted_left(F.col(tags), after).alias(names[2])]


def with_chunks(df: DataFrame, tags: str, out: str) -> DataFrame:
    """Add ``out``: the chunks of one tag array, ``array<struct<start,end,type>>``.

    The k-th chunk start belongs to the k-th chunk end, so no window and no shuffle is needed. Columns are
    added step by step, because an expression referred to inside a lambda would be computed once per entry,
    and none is filtered on, because a pushed-down filter computes its whole expression again. Positions
    outside every chunk leave first, on a comparison of the raw tags.
    """
    s, o = f"__{out}_s", F.lit(OUTSIDE)
    places = F.when(F.size(tags) > 0, F.sequence(F.lit(0), F.size(tags) - 1)).otherwise(
        F.array().cast("array<int>"))
    zipped = F.arrays_zip(*_around(tags, ("b", "h", "a"), o, o), places.alias("i"))

    def border(z: Column) -> Column:
        return F.struct(z["i"].cast("bigint").alias("i"), z["h"].alias("h"), chunk_starts(z["b"], z["h"]).alias("s"),
                        chunk_ends(z["h"], z["a"]).alias("e"))

    return (
        df.withColumn(s, F.filter(zipped, lambda z: (z["h"] != OUTSIDE)))
        .withColumn(s, F.transform(s, border))
        .withColumn(out, F.zip_with(
            F.filter(s, lambda x: x["s"]), F.filter(s, lambda x: x["e"]), lambda a, b: F.struct(
                a["i"].alias("start"), b["i"].alias("end"), tag_type_or_empty(a["h"]).alias("type"))))
        .drop(s)
    )


def with_chunk_events(df: DataFrame, gold: str, pred: str, out: str, edges: bool = False) -> DataFrame:
    """Add ``out``: the positions where a chunk of either side starts or ends, in order.

    Entry: ``struct<g_type, p_type, joint_start, any_end, joint_end>``, types NULL where no chunk starts. NULL
    for a row without chunks and for a row that holds an invalid tag. With ``edges`` the columns ``<gold>_before``, ``<gold>_after`` and
    so on hold the tags around the array; without it the array stands alone.
    """
    def edge(side: str, where: str) -> Column:
        return F.coalesce(F.col(f"{side}_{where}"), F.lit(OUTSIDE)) if edges else F.lit(OUTSIDE)

    zipped = F.arrays_zip(*_around(gold, ("gb", "g", "ga"), edge(gold, "before"), edge(gold, "after")),
                          *_around(pred, ("pb", "p", "pa"), edge(pred, "before"), edge(pred, "after")))

    def flags(z: Column) -> Column:
        return F.struct(
            chunk_starts(z["gb"], z["g"]).alias("gs"), chunk_starts(z["pb"], z["p"]).alias("ps"),
            chunk_ends(z["g"], z["ga"]).alias("ge"), chunk_ends(z["p"], z["pa"]).alias("pe"),
            z["g"].alias("g"), z["p"].alias("p"),
        )

    def event(f: Column) -> Column:
        return F.struct(
            F.when(f["gs"], tag_type(f["g"])).alias("g_type"),
            F.when(f["ps"], tag_type(f["p"])).alias("p_type"),
            (f["gs"] & f["ps"] & ((f["g"] == f["p"]) | (tag_type(f["g"]) == tag_type(f["p"])))).alias("joint_start"),
            (f["ge"] | f["pe"]).alias("any_end"),
            (f["ge"] & f["pe"]).alias("joint_end"),
        )

    raw = f"__{out}_z"
    # most sentences hold no chunk: two compiled loops settle them before any lambda runs
    some = (F.size(F.array_remove(gold, OUTSIDE)) > 0) | (F.size(F.array_remove(pred, OUTSIDE)) > 0)
    good = F.forall(raw, lambda z: is_valid_tag(z["g"]) & is_valid_tag(z["p"]))
    return (
        df.withColumn(raw, F.when(some, F.filter(zipped, lambda z: (z["g"] != OUTSIDE) | (z["p"] != OUTSIDE))))
        .withColumn(out, F.transform(F.when(good, F.col(raw)), flags))
        .withColumn(out, F.transform(
            F.filter(out, lambda f: f["gs"] | f["ps"] | f["ge"] | f["pe"]), event))
        .drop(raw)
    )
