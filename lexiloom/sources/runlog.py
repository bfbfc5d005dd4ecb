"""Metrics logs as nested JSON: ``{"Epoch k": {"<phase>_log": {metric: value | {label: {...}}}, "end_time": ...}}``.

A log is parsed once into a VARIANT and unfolded level by level into leaves, rows of a path (a list of names) and a JSON
value; folding leaves again gives the log back, at any depth and with any characters in its names. The rows of a log name
a metric by its path below the phase, joined by dots; a dot or backslash inside a name has a backslash before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

EMPTY_NAME = "\\e"


# ---- any JSON object -------------------------------------------------------------------------------


def _depth(text: Column) -> Column:
    """How deep objects are nested: the highest number of braces open at once, strings left out."""
    braces = F.regexp_replace(F.regexp_replace(text, r'"(?:\\.|[^"\\])*"', ""), "[^{}]", "")
    step = F.aggregate(F.filter(F.split(braces, ""), lambda c: c != ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, c: F.struct(
        (a["now"] + F.when(c == "{", 1).otherwise(-1)).alias("now"), F.greatest(a["most"], a["now"] + F.when(c == "{", 1).otherwise(-1)).alias("most")))
    return step["most"]


def leaves(objects: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``(*keys, path, json)``: the values of JSON objects that hold no further names: scalars, arrays and empty objects."""
    objects = stored(objects.select(*keys, column), "objects")  # read for the depth and for the values
    depth = objects.agg(F.max(_depth(F.col(column)))).head()[0] or 0
    rows = objects.where(F.col(column).isNotNull()).select(*keys, F.array().cast("array<string>").alias("path"), F.parse_json(column).alias("v"))
    for _ in range(depth):
        inner = F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))
        below = F.transform(inner, lambda e: F.struct(F.concat("path", F.array(e["key"])).alias("path"), e["value"].alias("v")))
        whole = F.array(F.struct(F.col("path"), F.col("v")))
        rows = rows.select(*keys, F.inline_outer(F.when(F.size(inner) > 0, below).otherwise(whole)))
    return rows.select(*keys, "path", F.to_json("v").alias("json"))


def nest(rows: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """``(*keys, out)``: the JSON objects whose leaves are given. The innermost names are folded first."""
    rows = stored(rows.select(*keys, "path", "json"), "leaves")  # read for the depth and for the folding
    depth = rows.agg(F.max(F.size("path"))).head()[0] or 0
    for d in range(depth, 0, -1):
        deep = F.size("path") == d
        entry = F.struct(F.when(deep, F.element_at("path", -1)).alias("key"), F.col("json").alias("json"))
        parent = F.when(deep, F.slice("path", 1, d - 1)).otherwise(F.col("path"))
        listed = rows.select(*keys, parent.alias("path"), entry.alias("e")).groupBy(*keys, "path").agg(F.sort_array(F.collect_list("e")).alias("e"))
        members = F.transform("e", lambda x: F.struct(x["key"], F.parse_json(x["json"])))
        folded = F.when(F.col("e")[0]["key"].isNull(), F.col("e")[0]["json"]).otherwise(F.to_json(F.map_from_entries(members)))
        rows = listed.select(*keys, "path", folded.alias("json"))
    return rows.select(*keys, F.col("json").alias(out))


# ---- metrics logs ----------------------------------------------------------------------------------


def _joined(names: Column) -> Column:
    escaped = F.transform(names, lambda n: F.when(n == "", F.lit(EMPTY_NAME)).otherwise(F.replace(F.replace(n, F.lit("\\"), F.lit("\\\\")), F.lit("."), F.lit("\\."))))
    return F.array_join(escaped, ".")


def _split(metric: Column) -> Column:
    names = F.regexp_extract_all(metric, F.lit(r"(?:\\.|[^.\\])+"), F.lit(0))
    return F.transform(names, lambda n: F.when(n == EMPTY_NAME, F.lit("")).otherwise(F.regexp_replace(n, r"\\(.)", "$1")))


def _number(value: Column) -> Column:
    """A number as JSON; what JSON has no number for is a string."""
    text, x = value.cast("string"), value.cast("double")
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(value.isNull(), F.lit("null")).when(odd, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)


def write_log(metrics: DataFrame, run: Sequence[str] = ("run_id",), out: str = "log") -> DataFrame:
    """``(*run, log)``: one JSON object per run from the long table ``(run, epoch, phase, metric, value)``.

    A dotted metric is nested by its names. A column ``json``, as :func:`read_log` gives it, is written in place of
    ``value``. An optional ``end_time`` column becomes the epoch's last end time.
    """
    json = F.coalesce("json", _number(F.col("value"))) if "json" in metrics.columns else _number(F.col("value"))
    epoch = F.concat(F.lit("Epoch "), F.col("epoch").cast("string"))
    path = F.concat(F.array(epoch, F.concat("phase", F.lit("_log"))), _split(F.col("metric")))
    rows = metrics.where("metric IS NOT NULL").select(*run, path.alias("path"), json.alias("json"))
    if "end_time" in metrics.columns:
        ends = metrics.groupBy(*run, "epoch").agg(F.max("end_time").alias("t")).where("t IS NOT NULL")
        quoted = F.regexp_extract(F.to_json(F.array("t")), r"^\[(.*)\]$", 1)
        rows = rows.unionByName(ends.select(*run, F.array(epoch, F.lit("end_time")).alias("path"), quoted.alias("json")))
    return nest(rows, run, out)


def read_log(logs: DataFrame, run: Sequence[str] = ("run_id",), column: str = "log") -> DataFrame:
    """``(*run, epoch, phase, metric, value, end_time, json)`` of JSON logs; nested reports get dotted metric names.

    ``value`` is the number, NULL for a value that is none; ``json`` is the value as it stands.
    """
    top = logs.where(F.col(column).isNotNull()).select(*run, F.explode(F.map_entries(F.try_variant_get(F.parse_json(column), "$", "map<string,variant>"))).alias("e"))
    epochs = top.select(*run, F.regexp_extract("e.key", "([0-9]+)", 1).cast("bigint").alias("epoch"), F.to_json("e.value").alias("__log"),
                        F.try_variant_get("e.value", "$.end_time", "string").alias("end_time"))
    rows = leaves(epochs, [*run, "epoch", "end_time"], "__log").where((F.size("path") > 1) & F.col("path")[0].endswith("_log"))
    rows = rows.select("*", F.try_variant_get(F.parse_json("json"), "$", "double").alias("value"))
    return rows.select(*run, "epoch", F.regexp_replace(F.col("path")[0], "_log$", "").alias("phase"),
                       _joined(F.slice("path", 2, F.size("path") - 1)).alias("metric"), "value", "end_time", "json")


def resume_points(rows: DataFrame, phase: str, metric: str, run: Sequence[str] = ("run_id",), higher: bool = True) -> DataFrame:
    """``(*run, epoch, score)``: from the rows of a log the number of the next epoch and the best score so far."""
    here = F.when((F.col("phase") == phase) & (F.col("metric") == metric), F.col("value"))
    return rows.groupBy(*run).agg((F.max("epoch") + 1).alias("epoch"), (F.max(here) if higher else F.min(here)).alias("score"))
