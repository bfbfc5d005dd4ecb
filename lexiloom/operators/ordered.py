"""Order-dependent building blocks that never put one key's rows into one task.

Spark rows have no order, and ``Window.partitionBy(key)`` sends all rows of a hot key to a single task. Here
rows are cut into *buckets*: runs of neighbouring rows of one key, by default the rows whose integer order
key agrees above its lowest ``bits`` bits. With unique order keys a bucket holds at most ``2 ** bits`` rows,
whatever the key. The work is done inside buckets, on tasks of bounded size.

What crosses a bucket border comes from a summary with one narrow row per bucket. Its values are put into the
bucket as *border rows* before the first and after the last row, so that one window sees them in place: the
wide rows are shuffled once and joined with nothing. The summary is treated in the same way ``levels`` times,
``bits`` more bits each time: ten billion rows with dense ids make 9.8 million summary rows, then 9,537. Ids
with wide holes make more and need more levels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "__bucket"
BITS = 10
BEFORE, ROW, AFTER = 0, 1, 2


def _bucketed(df: DataFrame, order: Sequence[str], bucket: Sequence[str] | None, bits: int):
    if bucket:
        return df, list(bucket)
    return df.withColumn(BUCKET, F.shiftright(F.col(order[0]).cast("bigint"), bits)), [BUCKET]


def _with_borders(df: DataFrame, border: DataFrame) -> DataFrame:
    return df.withColumn("__kind", F.lit(ROW)).unionByName(border, allowMissingColumns=True)


def running(df: DataFrame, value: Column, out: str, order: Sequence[str], keys: Sequence[str] = (),
            bucket: Sequence[str] | None = None, how: str = "sum", bits: int = BITS, levels: int = 1,
            keep_bucket: bool = False) -> DataFrame:
    """Add ``out``: the ``sum``, ``max`` or ``min`` of ``value`` over all rows *before* this one.

    NULL (0 for ``sum``) on a key's first row. With ``keep_bucket`` the bucket stays, with the total before
    it in ``__low`` and the total up to its end in ``__high`` (for ``sum``).
    """
    fold = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    df, buckets = _bucketed(df, order, bucket, bits)
    df = df.withColumn("__value", value)
    group = [*keys, *buckets]
    carry = _carry(df.groupBy(*group).agg(fold("__value").alias("__total")), fold, keys, buckets,
                   bucket is None, how, bits, levels)
    border = carry.select(*group, F.col("__carry").alias("__value"), F.lit(BEFORE).alias("__kind"),
                          F.struct("__carry", "__total").alias("__edge"))
    rows = _with_borders(df, border)
    inside = Window.partitionBy(*group).orderBy("__kind", *order)
    past = inside.rowsBetween(Window.unboundedPreceding, -1)
    result = fold("__value").over(past)
    made = {out: F.coalesce(result, F.lit(0)) if how == "sum" else result}
    dropped = ["__value", "__kind", "__edge"]
    if keep_bucket:
        edge = F.first("__edge").over(inside.rowsBetween(Window.unboundedPreceding, 0))
        made["__e"] = edge
    done = rows.withColumns(made).where(F.col("__kind") == ROW).drop(*dropped)
    if keep_bucket:
        low = F.coalesce(F.col("__e.__carry"), F.lit(0))
        return done.withColumns({"__low": low, "__high": low + F.col("__e.__total")}).drop("__e")
    return done.drop(BUCKET)


def _carry(summary, fold, keys, buckets, is_integer, how, bits, levels) -> DataFrame:
    group = [*keys, *buckets]
    if is_integer and levels > 0:
        renamed = summary.withColumnsRenamed({BUCKET: "__order", "__total": "__sub"})
        carried = running(renamed, F.col("__sub"), "__carry", ["__order"], keys, None, how, bits, levels - 1)
        return carried.withColumnsRenamed({"__order": BUCKET, "__sub": "__total"})
    before = (Window.partitionBy(*keys).orderBy(*buckets)
              .rowsBetween(Window.unboundedPreceding, -1))
    return summary.select(*group, "__total", fold("__total").over(before).alias("__carry"))


def running_total(df: DataFrame, value: Column, out: str, order: Sequence[str], keys: Sequence[str] = (),
                  **options) -> DataFrame:
    """Exclusive prefix sum; see :func:`running`."""
    return running(df, value, out, order, keys, how="sum", **options)


def dense_index(df: DataFrame, out: str, order: Sequence[str], keys: Sequence[str] = (), **options) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... in the given order, within each key, without holes."""
    return running(df, F.lit(1).cast("bigint"), out, order, keys, how="sum", **options)


def neighbours(df: DataFrame, columns: Sequence[str], order: Sequence[str], keys: Sequence[str] = (),
               bucket: Sequence[str] | None = None, lag: str | None = "__prev", lead: str | None = None,
               bits: int = BITS, levels: int = 1) -> DataFrame:
    """Add structs of ``columns`` of the previous row (``lag``) and of the next row (``lead``) of the key."""
    df, buckets = _bucketed(df, order, bucket, bits)
    group = [*keys, *buckets]
    here, rank = F.struct(*columns), F.struct(*order)
    edges = ([F.max_by(here, rank).alias("__last")] if lag else []) + (
        [F.min_by(here, rank).alias("__first")] if lead else [])
    carry = _edge_carry(df.groupBy(*group).agg(*edges), keys, buckets, bucket is None, lag, lead, bits, levels)
    sides = ([F.struct(F.lit(BEFORE).alias("__kind"), F.col("__before").alias("__v"))] if lag else []) + (
        [F.struct(F.lit(AFTER).alias("__kind"), F.col("__after").alias("__v"))] if lead else [])
    border = (carry.select(*group, F.inline(F.array(*sides))).where("__v IS NOT NULL")
              .select(*group, "__kind", "__v.*"))
    inside = Window.partitionBy(*group).orderBy("__kind", *order)
    made = {}
    if lag:
        made[lag] = F.lag(here).over(inside)
    if lead:
        made[lead] = F.lead(here).over(inside)
    done = _with_borders(df, border).withColumns(made).where(F.col("__kind") == ROW).drop("__kind")
    return done if bucket else done.drop(BUCKET)


def _edge_carry(summary, keys, buckets, is_integer, lag, lead, bits, levels) -> DataFrame:
    group = [*keys, *buckets]
    picked = [F.col(c) for c in group]
    if is_integer and levels > 0:
        table = summary.withColumnRenamed(BUCKET, "__order")
        names = ([] if not lag else ["__last"]) + ([] if not lead else ["__first"])
        table = neighbours(table, names, ["__order"], keys, None, "__p" if lag else None,
                           "__n" if lead else None, bits, levels - 1).withColumnRenamed("__order", BUCKET)
        if lag:
            picked.append(F.col("__p.__last").alias("__before"))
        if lead:
            picked.append(F.col("__n.__first").alias("__after"))
        return table.select(*picked)
    along = Window.partitionBy(*keys).orderBy(*buckets)
    if lag:
        picked.append(F.lag("__last").over(along).alias("__before"))
    if lead:
        picked.append(F.lead("__first").over(along).alias("__after"))
    return summary.select(*picked)


HOT_KEYS = 4096


def lookup(facts: DataFrame, table: DataFrame, on: Sequence[str], weight: str, hot: DataFrame | None = None,
           spread: Sequence[str] = (), how: str = "inner", hot_keys: int = HOT_KEYS) -> DataFrame:
    """Join ``facts`` with ``table``, which is unique on ``on``, when a few keys may hold most facts.

    ``weight`` is a column of ``table`` that orders its keys by their number of facts. The ``hot_keys``
    heaviest keys, a fixed number of rows, are broadcast, and their facts stay where they are. Every other
    key then has at most ``1 / hot_keys`` of the facts, so the shuffle join of the rest is even. Facts that
    the broadcast side has already answered go into that join under a spread key that matches nothing.
    """
    values = [c for c in table.columns if c not in on and c != weight]
    head = hot if hot is not None else table.orderBy(F.desc(weight), *on).limit(hot_keys)
    head = head.select(*on, *[F.col(c).alias(f"__h_{c}") for c in values], F.lit(True).alias("__hot"))
    salted = F.pmod(F.xxhash64(*(spread or [c for c in facts.columns])), F.lit(100_000)).cast("int") + 1
    first = (facts.join(F.broadcast(head), list(on), "left")
             .withColumn("__salt", F.when(F.col("__hot"), salted).otherwise(F.lit(0))))
    tail = table.select(*on, *values).withColumn("__salt", F.lit(0)).withColumn("__cold", F.lit(True))
    both = first.join(tail, [*on, "__salt"], "left")
    chosen = [F.when(F.col("__hot"), F.col(f"__h_{c}")).otherwise(F.col(c)).alias(c) for c in values]
    result = both if how == "left" else both.where(F.col("__hot") | F.col("__cold"))
    return result.select(*facts.columns, *chosen)
