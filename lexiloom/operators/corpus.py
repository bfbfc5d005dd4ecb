"""Corpus preparation: union, hold-out, shuffle, line filters, accounting."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import bind
from ..functions.text import is_blank, is_heading_or_empty, md5_number, right_trim
from ..session import stored
from .ordered import dense_index, lookup

HOLDOUT_RATE = 0.05


def union_corpora(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Bag union in list order; ``(corpus_rank, row_id)`` is the order key of the result.

    Every part needs ``row_id`` and ``text``; a ``split`` column is kept and is NULL where a part has none.
    """
    result = None
    for rank, (name, df) in enumerate(parts):
        named = df.withColumns({"corpus": F.lit(name), "corpus_rank": F.lit(rank)})
        result = named if result is None else result.unionByName(named, allowMissingColumns=True)
    if result is None:
        raise ValueError("no corpus given")
    return result


def holdout(df: DataFrame, rate: float = HOLDOUT_RATE, seed: int = 42, keys: Sequence[str] = ("row_id",),
            split: str = "split") -> DataFrame:
    """Add ``split``: ``validation`` for about ``rate`` of the rows, else ``train``. No shuffle.

    The choice is a function of the row's key, so it survives recomputation, new partitions and new rows.
    """
    draw = md5_number(F.lit(seed), *[F.col(k) for k in keys]) % 10_000
    return df.withColumn(split, F.when(draw < round(rate * 10_000), "validation").otherwise("train"))


def split_missing(df: DataFrame, rate: float = HOLDOUT_RATE, seed: int = 42,
                  keys: Sequence[str] = ("row_id",), has_validation: bool = False) -> DataFrame:
    """Hold-out for a corpus that has no validation split; only its train rows are then used."""
    return df if has_validation else holdout(df.where(F.col("split") == "train"), rate, seed, keys)


#: bins of a draw's 32 bits in the first pass, and groups whose thresholds are broadcast
BIN_BITS, BROADCAST_GROUPS = 16, 4096


def thresholds(draws: DataFrame, rate: float, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``(*by, last)``: of every group the ``ceil(rate * n)``-th row in ``order``, as a struct of these columns.

    ``order`` begins with a draw of 32 bits. A histogram of its upper bits says in which bin of a group that row lies; only
    the rows of that bin, one in ``2 ** BIN_BITS``, are then ranked. Two passes over narrow rows, and no row is sorted
    with the whole of its group.
    """
    bin_ = F.shiftright(F.col(order[0]), 32 - BIN_BITS)
    bins = draws.groupBy(*by, bin_.alias("__bin")).agg(F.count("*").alias("__c"))
    group = Window.partitionBy(*by)
    counted = bins.withColumns({
        "__n": F.sum("__c").over(group),
        "__before": F.coalesce(F.sum("__c").over(group.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    wanted = F.ceil(F.col("__n") * rate)
    found = counted.where((F.col("__before") < wanted) & (wanted <= F.col("__before") + F.col("__c"))).select(
        *[F.col(c).alias(f"__g_{c}") for c in by], F.col("__bin").alias("__b"), (wanted - F.col("__before")).alias("__k"))
    found = stored(found, "bins")
    same = bin_ == F.col("__b")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    inside = draws.join(F.broadcast(found) if found.count() <= BROADCAST_GROUPS else found, same)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return inside.withColumn("__r", place).where(F.col("__r") == F.col("__k")).select(*by, F.struct(*order).alias("last"))


def holdout_exact(df: DataFrame, rate: float = HOLDOUT_RATE, seed: int = 42, keys: Sequence[str] = ("row_id",),
                  by: Sequence[str] = (), split: str = "split") -> DataFrame:
    """As :func:`holdout` with exactly ``ceil(rate * n)`` validation rows of every group of ``by``; ``keys`` name a row.

    The rows with the smallest draws are held out: each row is compared with its group's threshold where it stands. The
    thresholds of up to ``BROADCAST_GROUPS`` groups are broadcast; more are joined by shuffle (:func:`lookup`).
    """
    draw = md5_number(F.lit(seed), *[F.col(k) for k in keys])
    order = ["__draw", *dict.fromkeys(keys)]
    draws = df.select(*dict.fromkeys([*by, *keys]), draw.alias("__draw"))
    last = stored(thresholds(draws, rate, by, order), "thresholds")
    if not by:
        row = last.head()
        most = (F.struct(*[F.lit(v) for v in row["last"]]) if row else F.lit(None)).cast(last.schema["last"].dataType)
        return df.withColumn("__draw", draw).withColumn(split, F.when(F.struct(*order) <= most, "validation").otherwise("train")).drop("__draw")
    renamed = last.select(*[F.col(c).alias(f"__g_{c}") for c in by], F.col("last").alias("__last"), F.lit(1).alias("__weight"))
    here = df.withColumn("__draw", draw)
    if last.count() <= BROADCAST_GROUPS:
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
        joined = here.join(F.broadcast(renamed), same, "left")
    else:
        joined = lookup(here.withColumns({f"__g_{c}": F.col(c) for c in by}), renamed, [f"__g_{c}" for c in by], "__weight", spread=keys, how="left")
    chosen = F.coalesce(F.struct(*order) <= F.col("__last"), F.lit(False))
    return joined.withColumn(split, F.when(chosen, "validation").otherwise("train")).select(*[c for c in df.columns if c != split], split)


PRIME = 2_147_483_647
ROUNDS = 6


def _round_constants(seed: int, epoch: int, round_: int) -> tuple[int, int]:
    digest = hashlib.md5(f"{seed}:{epoch}:{round_}".encode()).hexdigest()
    return int(digest[:7], 16) | 1, int(digest[7:14], 16)


def _round(a: int, c: int, source: str, target: str, mask: int) -> Callable[[Column], Column]:
    """One half of a number's bits changed by a hash of the other half, which undoes itself."""
    def step(s: Column) -> Column:
        mixed = ((s[source] % PRIME) * a + c) % PRIME
        changed = s[target].bitwiseXOR(mixed.bitwiseAND(F.lit(mask).cast("bigint")))
        return F.struct(*[(changed if name == target else s[name]).alias(name) for name in ("high", "low")])

    return step


def permuted(index: Column, n: int, seed: int, epoch: int) -> Column:
    """The place of row ``index`` (0 to n - 1) in a random order of all ``n`` rows: a bijection, computed row by row.

    Rounds that change one half of the index's bits by a hash of the other permute the numbers below the next power of
    two; a number from ``n`` on is permuted again until it is below. Each time at least every second number is, so that 64 times
    are never all needed.
    """
    if not 0 < n <= 1 << 60:
        raise ValueError("the number of rows is 1 to 2 ** 60")
    bits = max((n - 1).bit_length(), 2)
    low_bits = bits // 2
    low_mask, high_mask = (1 << low_bits) - 1, (1 << (bits - low_bits)) - 1

    def once(x: Column) -> Column:
        state = F.struct(F.shiftright(x, low_bits).alias("high"), x.bitwiseAND(F.lit(low_mask).cast("bigint")).alias("low"))
        for r in range(ROUNDS):
            a, c = _round_constants(seed, epoch, r)
            state = bind(state, _round(a, c, *(("high", "low", low_mask) if r % 2 == 0 else ("low", "high", high_mask))))
        return bind(state, lambda s: F.shiftleft(s["high"], low_bits) + s["low"])

    first = once(index.cast("bigint"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), first, lambda x, _: F.when(x >= n, once(x)).otherwise(x))


def epoch_batches(df: DataFrame, n: int, size: int, seed: int, epoch: int, index: str = "index") -> DataFrame:
    """Add ``place`` and ``batch_id``: where a loader that shuffles every epoch meets each row. Nothing is sorted or moved.

    ``index`` is dense over the ``n`` rows (:func:`dense_index`); it serves every epoch.
    """
    return df.withColumn("place", permuted(F.col(index), n, seed, epoch)).withColumn("batch_id", F.floor(F.col("place") / size).cast("bigint"))


def shuffle_key(seed: int, *keys: str) -> Column:
    """A repeatable random order key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def shuffled(df: DataFrame, seed: int, keys: Sequence[str] = ("row_id",), place: str | None = None) -> DataFrame:
    """Rows in a repeatable random order: a range-partitioned sort, no single task.

    ``place`` adds a column with the row's place in that order. Keys are even, so ranges of their first digits
    are bounded buckets.
    """
    keyed = df.withColumn("shuffle_key", shuffle_key(seed, *keys))
    if place:
        head = F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("bigint")
        keyed = dense_index(keyed.withColumn("__head", head), place, ["__head", "shuffle_key", *keys], bits=16).drop("__head")
    return keyed.orderBy("shuffle_key", *keys)


def drop_headings(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(~is_heading_or_empty(F.col(text)))


def drop_blank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(~is_blank(F.col(text)))


def trimmed(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, right_trim(F.col(text)))


def two_corpus_documents(first: DataFrame, second: DataFrame, split: str) -> DataFrame:
    """The first corpus for any split, followed by the second for ``train`` only, both cleaned."""
    parts = [("first", first)] + ([("second", second)] if split == "train" else [])
    return trimmed(drop_headings(union_corpora(parts)))


def corpus_stats(df: DataFrame, tokens: str = "tokens", by: Sequence[str] = ("corpus", "split")) -> DataFrame:
    """Rows and tokens per corpus and split."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"),
                               F.sum(F.size(tokens).cast("bigint")).alias("n_tokens"))
