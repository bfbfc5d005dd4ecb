"""Exact chunk spans and their counts, for sentences and for one long stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import is_valid_tag, with_chunk_events, with_chunks
from ..session import stored
from .ordered import BITS, neighbours


def chunks(df: DataFrame, keys: Sequence[str], tags: str) -> DataFrame:
    """One row per chunk of a tag array: ``(*keys, start, end, type)``. Map-only."""
    return with_chunks(df, tags, "__c").select(*keys, F.inline_outer("__c")).where("start IS NOT NULL")


def chunk_table(df: DataFrame, keys: Sequence[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Chunks of both sides matched on start, end and type: ``(*keys, start, end, type, in_gold, in_pred)``.

    A full outer match as one grouping: a chunk is correct when both flags are set.
    """
    both = with_chunks(with_chunks(df, gold, "__g"), pred, "__p")
    tagged = F.concat(
        F.transform("__g", lambda c: F.struct(c["start"], c["end"], c["type"], F.lit(0).alias("side"))),
        F.transform("__p", lambda c: F.struct(c["start"], c["end"], c["type"], F.lit(1).alias("side"))),
    )
    return (
        both.select(*keys, F.inline_outer(tagged)).where("side IS NOT NULL")
        .groupBy(*keys, "start", "end", "type")
        .agg(F.max((F.col("side") == 0).cast("int")).alias("in_gold"),
             F.max((F.col("side") == 1).cast("int")).alias("in_pred"))
    )


def _shares(event: Column, correct: Column) -> Column:
    one, none = F.lit(1), F.lit(0)
    return F.array(
        F.struct(event["g_type"].alias("type"), correct.cast("int").alias("correct"), one.alias("gold"),
                 none.alias("pred")),
        F.struct(event["p_type"].alias("type"), none.alias("correct"), none.alias("gold"), one.alias("pred")),
    )


def _count(shares: DataFrame, by: Sequence[str]) -> DataFrame:
    return (
        shares.where("type IS NOT NULL").groupBy(*by, "type")
        .agg(*[F.sum(c).cast("bigint").alias(c) for c in ("correct", "gold", "pred")])
    )


def chunk_counts(df: DataFrame, gold: str = "gold", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Correct, gold and predicted chunks per type, each row of ``df`` being one sequence.

    A chunk is correct when both sides start it together with the same type and the first end after that
    start, of either side, is an end of both. So the chunk events of a sentence are enough: the plan reads,
    maps and adds up before its only shuffle, which carries one row per type and task. Rows with a tag that
    is neither ``O`` nor ``prefix-type`` count nothing; see :func:`invalid_rows`.
    """
    shares = with_resolved(df.select(*by, gold, pred), gold, pred, "__r").select(*by, F.explode_outer("__r").alias("r")).select(
        *by, F.inline_outer(_shares(F.col("r.event"), F.col("r.correct"))))
    return _count(shares, by)


def with_resolved(df: DataFrame, gold: str, pred: str, out: str) -> DataFrame:
    """Add ``out``: the chunk events of every row, each with whether it begins a correct chunk."""
    return (
        with_chunk_events(df, gold, pred, "__e")
        .withColumn("__n", F.concat(F.slice("__e", F.lit(2), F.greatest(F.size("__e") - 1, F.lit(0))),
                                    F.array(F.lit(None).cast(_EVENT))))
        .withColumn(out, F.zip_with("__e", "__n", _resolved)).drop("__e", "__n")
    )


_EVENT = ("struct<g_type:string,p_type:string,joint_start:boolean,any_end:boolean,joint_end:boolean>")


def _resolved(event: Column, following: Column) -> Column:
    ends_here = F.coalesce(F.when(event["any_end"], event["joint_end"]).otherwise(following["joint_end"]),
                           F.lit(False))
    return F.struct(event.alias("event"), (event["joint_start"] & ends_here).alias("correct"))


def validity(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Add ``valid``: false for rows with a tag that is neither ``O`` nor ``prefix-type``; their counts are none."""
    return df.withColumn("valid", F.forall(gold, is_valid_tag) & F.forall(pred, is_valid_tag))


def invalid_rows(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Rows that hold a tag without a type, with ``valid = false``."""
    return validity(df, gold, pred).where(~F.col("valid"))


def chunk_counts_flat(df: DataFrame, order: Sequence[str], gold: str = "gold", pred: str = "pred",
                      keys: Sequence[str] = (), bucket: Sequence[str] | None = None, bits: int = BITS,
                      levels: int = 1) -> DataFrame:
    """As :func:`chunk_counts`, with all rows of a key read as *one* stream, in the given order.

    A chunk may run on over any number of rows. Each row learns only the last tags before it and the first
    tags after it (bucketed, so one stream may hold every row). An open joint start at a row's end is
    settled by the next row that has any event, found on narrow rows in the same way. The event lists have
    two readers and are written to the shared folder in between.
    """
    df = df.where(F.size(gold) > 0).select(
        *keys, *dict.fromkeys([*order, *(bucket or ())]), gold, pred,
        F.element_at(gold, 1).alias("__gf"), F.element_at(gold, -1).alias("__gl"),
        F.element_at(pred, 1).alias("__pf"), F.element_at(pred, -1).alias("__pl"))
    near = neighbours(df, ["__gf", "__gl", "__pf", "__pl"], order, keys, bucket, "__b", "__a", bits, levels)
    ready = near.select(
        *[c for c in near.columns if not c.startswith("__")],
        F.col("__b.__gl").alias(f"{gold}_before"), F.col("__a.__gf").alias(f"{gold}_after"),
        F.col("__b.__pl").alias(f"{pred}_before"), F.col("__a.__pf").alias(f"{pred}_after"))
    events = (
        with_chunk_events(ready, gold, pred, "__e", edges=True)
        .withColumn("__n", F.concat(F.slice("__e", F.lit(2), F.greatest(F.size("__e") - 1, F.lit(0))),
                                    F.array(F.lit(None).cast(_EVENT))))
        .select(*keys, *dict.fromkeys([*order, *(bucket or ())]),
                F.try_element_at("__e", F.lit(1))["joint_end"].alias("first_end"),
                F.when(F.try_element_at("__e", F.lit(-1))["joint_start"]
                       & ~F.try_element_at("__e", F.lit(-1))["any_end"],
                       F.try_element_at("__e", F.lit(-1))["g_type"]).alias("open"),
                F.flatten(F.transform(F.zip_with("__e", "__n", _resolved),
                                      lambda r: _shares(r["event"], r["correct"]))).alias("shares"))
    )
    events = stored(events, "chunk-events")
    settled = _count(events.select(*keys, F.inline_outer("shares")), keys)
    edge = neighbours(events.drop("shares").where("first_end IS NOT NULL"), ["first_end"], order, keys, bucket,
                      None, "__next", bits, levels)
    late = (
        edge.where(F.col("open").isNotNull() & F.col("__next.first_end"))
        .groupBy(*keys, F.col("open").alias("type"))
        .agg(F.count("*").alias("correct"))
        .select(*keys, "type", "correct", F.lit(0).cast("bigint").alias("gold"),
                F.lit(0).cast("bigint").alias("pred"))
    )
    return _count(settled.unionByName(late), keys)
