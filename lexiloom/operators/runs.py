"""Run tables: grids, random trials, run logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import md5_number


def expand_grid(df: DataFrame, lists: Mapping[str, Column | Sequence]) -> DataFrame:
    """Every combination of the candidate lists, for each row of ``df``.

    Lists are array columns or Python lists. Each is exploded in turn, as nested loops would be: every row
    multiplies in its own task, and nothing is joined.
    """
    for name, values in lists.items():
        items = values if isinstance(values, Column) else F.array(*[F.lit(v) for v in values])
        df = df.withColumn(name, F.explode(items))
    return df


def with_run_id(df: DataFrame, template: str, *columns: str, out: str = "run_id") -> DataFrame:
    """Run id or output path by a format string."""
    return df.withColumn(out, F.format_string(template, *[F.col(c).cast("string") for c in columns]))


def draw(values: Column, seed: int, *key: Column) -> Column:
    """One entry of a candidate list, evenly drawn, the same for the same seed and key."""
    return F.element_at(values, (md5_number(F.lit(seed), *key) % F.size(values)).cast("int") + 1)


def random_trials(df: DataFrame, candidates: str, trials: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """``(*keys, trial, key, value)``: one draw per trial and candidate key.

    ``candidates`` is ``map<string, array<string>>``. Each (trial, key) pair draws on its own.
    """
    rows = df.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"), candidates)
    rows = rows.select(*keys, "trial", F.explode(candidates).alias("key", "__values"))
    return rows.select(*keys, "trial", "key",
                       draw(F.col("__values"), seed, *[F.col(k) for k in keys], F.col("trial"), F.col("key"))
                       .alias("value"))


def run_log(metrics: DataFrame, names: Sequence[str], by: Sequence[str] = ("run_id", "epoch"),
            phase: str = "phase", metric: str = "metric", value: str = "value",
            end_time: str = "end_time") -> DataFrame:
    """The wide log: one row per run and epoch, a column per phase and metric of ``names``, last end time."""
    parts = []
    for name in names:
        p, m = name.split(".", 1)
        here = (F.col(phase) == p) & (F.col(metric) == m)
        parts.append(F.max(F.when(here, F.col(value))).alias(name.replace(".", "_")))
    return metrics.groupBy(*by).agg(*parts, F.max(end_time).alias("end_time"))
