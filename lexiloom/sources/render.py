"""Aligned text views of tagged sentences, one row per sentence, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import shifted_right
from ..functions.tags import OUTSIDE, last_dash_type


def _hidden(tag: Column) -> Column:
    return F.when(tag == OUTSIDE, "").otherwise(tag)


def _fill(text: Column, width: Column) -> Column:
    return F.rpad(text, width, F.lit(" "))


def annotation_rows(df: DataFrame, tokens: str = "tokens", tags: str = "tags") -> DataFrame:
    """Add ``token_row`` and ``tag_row``: columns as wide as the longer of token and tag (``O`` counts 1).

    ``O`` is shown blank. A bar stands where the type after the last dash changes, else a blank.
    """
    typed = df.withColumn("__y", F.transform(tags, last_dash_type))
    zipped = F.arrays_zip(F.col(tokens).alias("t"), F.col(tags).alias("g"), F.col("__y").alias("y"),
                          shifted_right(F.col("__y"), F.lit(None).cast("string")).alias("b"))

    def gap(z: Column) -> Column:
        return F.when(z["y"].eqNullSafe(z["b"]), " ").otherwise("|")

    def width(z: Column) -> Column:
        return F.greatest(F.char_length(z["t"]), F.char_length(z["g"]))

    return (
        typed.withColumn("__z", F.when(F.size(tokens) > 0, zipped).otherwise(F.slice(zipped, 1, 0)))
        .withColumns({
            "token_row": F.concat(F.array_join(F.transform(
                "__z", lambda z: F.concat(gap(z), _fill(z["t"], width(z)))), ""), F.lit("|")),
            "tag_row": F.concat(F.array_join(F.transform(
                "__z", lambda z: F.concat(gap(z), _fill(_hidden(z["g"]), width(z)))), ""), F.lit("|")),
        }).drop("__y", "__z"))


def prediction_rows(df: DataFrame, tokens: str = "tokens", gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Add ``token_row``, ``pred_row``, ``gold_row``: bars between all columns, ``O`` blank and 0 wide."""
    zipped = F.arrays_zip(F.col(tokens).alias("t"), F.transform(gold, _hidden).alias("g"),
                          F.transform(pred, _hidden).alias("p"))

    def line(field: str) -> Column:
        def cell(z: Column) -> Column:
            width = F.greatest(F.char_length(z["t"]), F.char_length(z["g"]), F.char_length(z["p"]))
            return F.concat(_fill(z[field], width), F.lit("|"))
        return F.concat(F.lit("|"), F.array_join(F.transform("__z", cell), ""))

    return df.withColumn("__z", zipped).withColumns(
        {"token_row": line("t"), "pred_row": line("p"), "gold_row": line("g")}).drop("__z")


def annotation_text(number: Column, token_row: Column, tag_row: Column) -> Column:
    """The block written for one sentence: its number and the two rows."""
    return F.concat_ws("\n", F.concat(F.lit("Line "), number.cast("string")), token_row, tag_row)
