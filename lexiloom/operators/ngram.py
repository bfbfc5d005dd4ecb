"""Backward n-gram models: every token is predicted from the tokens to its right."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import shifted_left
from ..session import stored
from .ordered import lookup

END = "</s>"


def backward_pairs(df: DataFrame, tokens: str = "tokens", by: Sequence[str] = ()) -> DataFrame:
    """``(*by, ctx, tok, n)``: counts of a token and its right neighbour; the last token sees ``</s>``.

    Neighbours are paired inside the array and counted in the map tasks.
    """
    pairs = F.arrays_zip(shifted_left(F.col(tokens), F.lit(END)).alias("ctx"), F.col(tokens).alias("tok"))
    sized = F.when(F.size(tokens) > 0, pairs)
    return (df.select(*by, F.inline_outer(sized)).where("tok IS NOT NULL")
            .groupBy(*by, "ctx", "tok").agg(F.count("*").alias("n")))


def context_totals(pairs: DataFrame) -> DataFrame:
    """``(ctx, total, kinds)``: occurrences and distinct pairs of every context."""
    return pairs.groupBy("ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))


def backward_nll(train: DataFrame, held_out: DataFrame, alpha: float = 1.0,
                 by: Sequence[str] = ()) -> DataFrame:
    """``(*by, tokens, nll, perplexity)``: mean negative log-likelihood with add-``alpha`` smoothing.

    Both inputs are pair counts, unique on (ctx, tok), so the pair join is even. The vocabulary is that of
    the training tokens plus one place for unknown ones. A context's total comes from :func:`lookup`,
    because a frequent context has very many pairs; the totals are added up once, for its two joins.
    """
    vocabulary = train.select("tok").distinct().count()
    # the held-out pairs are the small side: no sort of the training pairs
    seen = held_out.hint("shuffle_hash").join(train.select("ctx", "tok", F.col("n").alias("__seen")), ["ctx", "tok"], "left")
    totals = stored(context_totals(train), "context-totals")
    known = lookup(seen, totals, ["ctx"], "kinds", spread=["ctx", "tok"], how="left")
    p = ((F.coalesce("__seen", F.lit(0)) + alpha)
         / (F.coalesce("total", F.lit(0)) + alpha * (vocabulary + 1)))
    scored = known.withColumn("__nll", -F.ln(p) * F.col("n"))
    return (scored.groupBy(*by).agg(F.sum("n").alias("tokens"), (F.sum("__nll") / F.sum("n")).alias("nll"))
            .withColumn("perplexity", F.exp("nll")))


# ---- any order: interpolated Kneser-Ney ------------------------------------------------------------


LEAST_DISCOUNT = 0.1


def contexts(order: int) -> list[str]:
    """Names of the context columns, the nearest token to the right first."""
    return [f"ctx{k}" for k in range(1, order)]


def backward_counts(df: DataFrame, order: int, tokens: str = "tokens", held: str = "held") -> DataFrame:
    """``(ctx1, ..., tok, n, held_n)``: counts of every token with the ``order - 1`` tokens to its right, ``</s>`` beyond the end.

    Rows marked ``held`` are counted beside the others in the same row, so that no table is joined with itself.
    """
    shifted, columns = F.col(tokens), []
    for name in contexts(order):
        shifted = shifted_left(shifted, F.lit(END))
        columns.append(shifted.alias(name))
    grams = F.when(F.size(tokens) > 0, F.arrays_zip(*columns, F.col(tokens).alias("tok")))
    flat = df.select(F.coalesce(F.col(held), F.lit(False)).alias("__held"), F.inline_outer(grams)).where("tok IS NOT NULL")
    return flat.groupBy(*contexts(order), "tok").agg(F.count_if(~F.col("__held")).alias("n"), F.count_if("__held").alias("held_n"))


def continuation_tables(counts: DataFrame, order: int) -> dict[int, DataFrame]:
    """Tables ``(ctx1, ..., tok, n, occurrences, held_n)`` of orders ``order`` down to 1: below the highest, ``n`` is the number of
    different tokens that a sequence is continued by to the right, ``occurrences`` how often it stands there in the text.

    Each table is made from the one above, so that the text is read once for all orders. Sequences of held-out text alone have
    ``n`` 0 and stay: the rows with ``held_n`` are those to be scored.
    """
    tables = {order: stored(counts.withColumn("occurrences", F.col("n")), f"grams-{order}")}
    for k in range(order - 1, 0, -1):
        made = tables[k + 1].groupBy(*contexts(k), "tok").agg(
            F.count_if(F.col("n") > 0).alias("n"), F.sum("occurrences").alias("occurrences"), F.sum("held_n").alias("held_n"))
        tables[k] = stored(made, f"grams-{k}")
    return tables


def discounts(table: DataFrame) -> tuple[float, float, float]:
    """What is taken from counts of one, two and more, from how many counts of one to four there are.

    At least ``LEAST_DISCOUNT``, so that a token never seen in a context has a chance there whatever the counts.
    """
    row = table.agg(*[F.count_if(F.col("n") == i).alias(f"c{i}") for i in (1, 2, 3, 4)]).first()
    c = [row[f"c{i}"] or 0 for i in (1, 2, 3, 4)]
    share = c[0] / (c[0] + 2 * c[1]) if c[0] else 0.5
    return tuple(max(i - (i + 1) * share * c[i] / c[i - 1] if c[i - 1] else share, LEAST_DISCOUNT) for i in (1, 2, 3))


def kneser_ney_nll(counts: DataFrame, order: int, orders: Sequence[int] = ()) -> DataFrame:
    """``(order, tokens, nll, perplexity)`` of the held-out counts under the interpolated model of the others.

        P(t | c1 ... ck) = (max(n - D(n), 0) + (D1 N1 + D2 N2 + D3 N3+) P(t | c1 ... ck-1)) / total,

    the shorter context's probability where a context was never seen, and in the end one in the vocabulary and one place
    for unknown tokens. ``orders``: the orders to score, up to ``order``, from the same counts (default: ``order`` alone).

    Chances are worked out from the shortest sequences up, once per held-out sequence, whose count stands in its own row. Only
    held-out sequences are joined: with the chance of the shorter sequence and with their contexts' totals; frequent ones are
    answered in place (:func:`lookup`).
    """
    tables = continuation_tables(counts, order)
    scored = [_kneser_ney_order(tables, k) for k in orders or (order,)]
    return reduce(DataFrame.unionAll, scored)


def _kneser_ney_order(tables: dict[int, DataFrame], order: int) -> DataFrame:
    size = tables[1].where("n > 0").count()
    below = None
    for k in range(1, order + 1):
        names = contexts(k)
        count = F.col("occurrences" if k == order else "n").alias("n")
        table = tables[k].select(*names, "tok", count, "held_n")
        d1, d2, d3 = discounts(table)
        n = F.col("n")
        taken = F.when(n == 0, 0.0).when(n == 1, d1).when(n == 2, d2).otherwise(d3)
        sums = [F.sum("n").alias("__total"), F.sum(taken).alias("__left")]
        scored = table.where("held_n > 0").select(*names, "tok", F.greatest(n - taken, F.lit(0.0)).alias("__kept"), "held_n")
        if names:
            scored = lookup(scored, below, [*names[:-1], "tok"], "__weight", spread=[*names, "tok"], how="left")
            totals = table.groupBy(*names).agg(*sums, F.sum("held_n").alias("__weight")).where("__weight > 0")
            scored = lookup(scored, stored(totals, "gram-totals"), names, "__weight", spread=[*names, "tok"], how="left")
        else:
            row = table.agg(*sums).first()
            scored = scored.withColumns({"__p": F.lit(1.0 / (size + 1)), "__total": F.lit(row[0] or 0), "__left": F.lit(row[1] or 0.0)})
        p = F.when(F.col("__total") > 0, (F.col("__kept") + F.col("__left") * F.col("__p")) / F.col("__total")).otherwise(F.col("__p"))
        below = scored.select(*names, "tok", F.col("held_n").alias("__weight"), p.alias("__p"))
        if k < order:
            below = stored(below, "gram-chances")
    nll = F.sum(-F.ln("__p") * F.col("__weight")) / F.sum("__weight")
    return below.agg(F.sum("__weight").alias("tokens"), nll.alias("nll")).select(F.lit(order).alias("order"), "tokens", "nll", F.exp("nll").alias("perplexity"))
