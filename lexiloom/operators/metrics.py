"""Precision, recall, F1, label reports, losses, best epochs and learning curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import cross_entropy
from ..functions.tags import OUTSIDE
from .ordered import running
from .spans import with_resolved


def ratio(part: Column, whole: Column, percent: bool = True) -> Column:
    """``part / whole``, 0 when the whole is 0."""
    value = F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
    return value * 100.0 if percent else value


def with_prf(counts: DataFrame, correct: str = "correct", gold: str = "gold", pred: str = "pred",
             percent: bool = True, digits: int | None = None) -> DataFrame:
    """Add ``precision``, ``recall`` and ``f1``; 0 where a denominator is 0.

    With p = c/pred and r = c/gold, 2pr/(p+r) is 2c/(pred+gold).
    """
    parts = {
        "precision": ratio(F.col(correct), F.col(pred), percent),
        "recall": ratio(F.col(correct), F.col(gold), percent),
        "f1": ratio(2 * F.col(correct), F.col(gold) + F.col(pred), percent),
    }
    return counts.select("*", *[(c if digits is None else F.round(c, digits)).alias(n) for n, c in parts.items()])


def confusion(df: DataFrame, gold: str = "gold", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """``(*by, gold, pred, n)`` from tag arrays. Added up in the map tasks; as small as the tag set squared."""
    pairs = F.arrays_zip(F.col(gold).alias("gold"), F.col(pred).alias("pred"))
    return (df.select(*by, F.inline_outer(pairs)).where("gold IS NOT NULL")
            .groupBy(*by, "gold", "pred").agg(F.count("*").alias("n")))


def tag_counts(confused: DataFrame) -> DataFrame:
    """``(tag, correct, gold, pred)`` of a confusion table: both margins in one pass."""
    sides = F.array(
        F.struct(F.col("gold").alias("tag"), F.when(F.col("gold") == F.col("pred"), F.col("n"))
                 .otherwise(0).alias("correct"), F.col("n").alias("gold"), F.lit(0).cast("bigint").alias("pred")),
        F.struct(F.col("pred").alias("tag"), F.lit(0).cast("bigint").alias("correct"),
                 F.lit(0).cast("bigint").alias("gold"), F.col("n").alias("pred")),
    )
    return (confused.select(F.inline(sides)).groupBy("tag")
            .agg(*[F.sum(c).cast("bigint").alias(c) for c in ("correct", "gold", "pred")]))


def label_report(confused: DataFrame, digits: int | None = None) -> DataFrame:
    """Precision, recall, F1 and support per label, with ``accuracy``, ``macro avg``, ``weighted avg`` rows.

    Values are shares of 1. The accuracy row repeats the accuracy in all three columns.
    """
    counts = tag_counts(confused)
    rows = with_prf(counts, percent=False)
    per_label = rows.select(F.col("tag").alias("label"), "precision", "recall", "f1",
                            F.col("gold").alias("support"))
    scores = ["precision", "recall", "f1"]
    averages = rows.agg(
        F.sum("gold").alias("__n"),
        ratio(F.sum("correct"), F.sum("gold"), False).alias("__accuracy"),
        *[F.avg(c).alias(f"__macro_{c}") for c in scores],
        *[ratio(F.sum(F.col(c) * F.col("gold")), F.sum("gold"), False).alias(f"__weighted_{c}") for c in scores],
    )
    summary = averages.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("label"), *[F.col("__accuracy").alias(c) for c in scores],
                 F.col("__n").alias("support")),
        F.struct(F.lit("macro avg").alias("label"), *[F.col(f"__macro_{c}").alias(c) for c in scores],
                 F.col("__n").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), *[F.col(f"__weighted_{c}").alias(c) for c in scores],
                 F.col("__n").alias("support")),
    )))
    report = per_label.unionByName(summary)
    return report if digits is None else report.select(
        "label", *[F.round(c, digits).alias(c) for c in scores], "support")


def token_summary(confused: DataFrame) -> DataFrame:
    """One row: tokens, accuracy and accuracy without ``O`` (NULL if every gold tag is ``O``), in percent."""
    same, inside = F.col("gold") == F.col("pred"), F.col("gold") != OUTSIDE
    return confused.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
        (100.0 * F.try_divide(F.sum(F.when(same, F.col("n")).otherwise(0)).cast("double"),
                              F.sum("n").cast("double"))).alias("accuracy"),
        (100.0 * F.try_divide(F.sum(F.when(same & inside, F.col("n")).otherwise(0)).cast("double"),
                              F.sum(F.when(inside, F.col("n"))).cast("double"))).alias("accuracy_inside"),
    )


def evaluation_summary(df: DataFrame, gold: str = "gold", pred: str = "pred", separators: bool = False,
                       digits: int | None = 4) -> DataFrame:
    """Chunk scores per type and overall (``overall``, type ``ALL``), with the token counts on the overall row.

    ``separators`` counts one ``O`` pair per sequence as a token, as files with blank-line separators do. Chunk
    shares and tag pairs of a row leave it together, so the rows are read once and their counts shuffled once; what
    follows works on types and pairs of tags.
    """
    names = ["correct", "gold", "pred", "tokens", "same", "inside", "same_inside"]

    def cell(overall: bool, kind: Column, **counts: Column) -> Column:
        return F.struct(F.lit(overall).alias("overall"), kind.alias("type"),
                        *[counts.get(n, F.lit(0)).cast("int").alias(n) for n in names])

    one = F.lit(1)
    rows = with_resolved(df.select(gold, pred), gold, pred, "__r")
    zipped = F.arrays_zip(F.col(gold).alias("g"), F.col(pred).alias("p"))
    rows = rows.withColumn("__same", F.filter(zipped, lambda z: z["g"] == z["p"]))
    outside = F.size("__same") - F.size(F.array_remove(F.col("__same.g"), OUTSIDE))
    between = one if separators else F.lit(0)
    facts = F.struct((F.size(gold) + between).alias("tokens"), (F.size("__same") + between).alias("same"),
                     F.size(F.array_remove(gold, OUTSIDE)).alias("inside"), (F.size("__same") - outside).alias("same_inside"))
    events = rows.select(facts.alias("t"), F.posexplode_outer("__r").alias("i", "r"))
    # a row's token counts leave with its first event; a row without events has one empty one
    first = F.when(F.coalesce("i", F.lit(0)) == 0, F.lit("ALL"))
    cells = events.select(F.inline(F.array(
        cell(False, F.col("r.event.g_type"), correct=F.coalesce("r.correct", F.lit(False)), gold=one),
        cell(False, F.col("r.event.p_type"), pred=one),
        cell(True, first, **{n: F.col(f"t.{n}") for n in ("tokens", "same", "inside", "same_inside")})))).where("type IS NOT NULL")
    counted = cells.groupBy("overall", "type").agg(*[F.sum(n).cast("bigint").alias(n) for n in names])
    # chunks also go to the overall row, which is there without any
    start = df.sparkSession.createDataFrame([(True, "ALL", *[0] * 7)], "overall boolean, type string, " + ", ".join(f"{n} bigint" for n in names))
    total = F.struct(F.lit(True).alias("overall"), F.lit("ALL").alias("type"), *names)
    shares = counted.select(F.inline(F.array(F.when(~F.col("overall"), F.struct("overall", "type", *names)), total))).where("type IS NOT NULL")
    both = shares.unionByName(start).groupBy("overall", "type").agg(*[F.sum(n).alias(n) for n in names])
    top = F.col("overall")
    percent = {"accuracy": F.try_divide(F.col("same").cast("double"), F.col("tokens").cast("double")),
               "accuracy_inside": F.try_divide(F.col("same_inside").cast("double"), F.col("inside").cast("double"))}
    shown = [F.when(top, 100.0 * c if digits is None else F.round(100.0 * c, digits)).alias(n) for n, c in percent.items()]
    return with_prf(both, digits=digits).select(
        "overall", "type", "correct", "gold", "pred", "precision", "recall", "f1", F.when(top, F.col("tokens")).alias("tokens"), *shown)


def report_lines(summary: DataFrame) -> DataFrame:
    """``(line_no, line)``: the summary as text, overall lines first, then one line per type."""
    overall = F.col("overall")
    # fixed values: the formats of the report's lines
    head = F.array(
        F.format_string("processed %d tokens with %d phrases; found: %d phrases; correct: %d.",
                        "tokens", "gold", "pred", "correct"),
        F.when(F.col("accuracy_inside").isNull(), "accuracy: undefined; (non-O)").otherwise(
            F.format_string("accuracy: %6.2f%%; (non-O)", "accuracy_inside")),
        F.format_string("accuracy: %6.2f%%; precision: %6.2f%%; recall: %6.2f%%; FB1: %6.2f",
                        "accuracy", "precision", "recall", "f1"),
    )
    row = F.array(F.format_string("%17s: precision: %6.2f%%; recall: %6.2f%%; FB1: %6.2f  %d",
                                  "type", "precision", "recall", "f1", "pred"))
    lines = summary.select("overall", "type", F.posexplode(F.when(overall, head).otherwise(row)).alias("i", "line"))
    # as many rows as there are types
    place = F.row_number().over(Window.orderBy(F.desc("overall"), "type", "i"))
    return lines.select((place - 1).alias("line_no"), "line").orderBy("line_no")


def mean_loss(df: DataFrame, logits: str = "logits", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Mean cross-entropy over the labels that are not ignored."""
    return df.groupBy(*by).agg(F.avg(cross_entropy(F.col(logits), F.col(label))).alias("loss"))


def epoch_loss(df: DataFrame, batch: str, by: Sequence[str] = (), logits: str = "logits",
               label: str = "label") -> DataFrame:
    """Mean over batches of the batch means: every batch weighs the same, whatever its token count."""
    return mean_loss(df, logits, label, [*by, batch]).groupBy(*by).agg(F.avg("loss").alias("loss"))


def improvements(df: DataFrame, score: str, order: Sequence[str], run: Sequence[str] = ("run_id",),
                 higher: bool = True, bucket: Sequence[str] | None = None, start: float | None = None,
                 **options) -> DataFrame:
    """Add ``improved``: strictly better than every earlier epoch of the run.

    The start value is 0 for a score and infinity for a loss, so an epoch at or below 0 never improves. A run that is
    resumed from its log starts from the best value there (``start``).
    """
    start = start if start is not None else 0.0 if higher else float("inf")
    best = running(df, F.col(score).cast("double"), "__best", order, run, bucket=bucket,
                   how="max" if higher else "min", **options)
    if higher:
        better = F.col(score) > F.greatest(F.coalesce("__best", F.lit(start)), F.lit(start))
    else:
        better = F.col(score) < F.least(F.coalesce("__best", F.lit(start)), F.lit(start))
    return best.withColumn("improved", better).drop("__best")


def resumed(df: DataFrame, points: DataFrame, score: str, order: Sequence[str], run: Sequence[str] = ("run_id",), higher: bool = True,
            epoch: str = "epoch", bucket: Sequence[str] | None = None, **options) -> DataFrame:
    """Epochs that go on from logged runs: ``epoch``, counted on from each run's log, and ``improved`` over the best score there.

    ``points``: ``(*run, epoch, score)`` with the next epoch's number and the best score. A point enters its run as the
    row before the first one, so only one row per run is joined and a run may hold any share of the rows. Runs without a
    point start anew.
    """
    first = df.groupBy(*run).agg(*[F.min(F.struct(*dict.fromkeys([*(bucket or []), *order]))).alias("__f")])
    state = points.select(*run, F.col("epoch").alias("__next"), F.col("score").cast("double").alias(score)).join(first, list(run)).select(
        *run, F.col("__f.*"), "__next", score, F.lit(0).alias("__row"))
    rows = df.withColumn("__row", F.lit(1)).unionByName(state, allowMissingColumns=True)
    along = [*order, "__row"]
    numbered = running(rows, F.when(F.col("__row") == 0, F.col("__next")).otherwise(F.lit(1).cast("bigint")), epoch, along, run, bucket=bucket, **options)
    found = improvements(numbered, score, along, run, higher, bucket=bucket, **options)
    return found.where("__row = 1").drop("__row", "__next")


def best_epochs(improved: DataFrame, order: Sequence[str], columns: Sequence[str],
                run: Sequence[str] = ("run_id",)) -> DataFrame:
    """The last improving epoch of every run: ``(*run, *columns, n_improved)``."""
    rank = F.struct(*order)
    return (improved.where("improved").groupBy(*run)
            .agg(F.max_by(F.struct(*columns), rank).alias("__b"), F.count("*").alias("n_improved"))
            .select(*run, *[F.col("__b")[c].alias(c) for c in columns], "n_improved"))


def learning_curve(scores: DataFrame, model: Sequence[str] = ("model",), k: str = "k", variant: str = "variant",
                   score: str = "f1", variants: tuple[str, str] = ("concat", "forward"),
                   digits: int | None = 4) -> DataFrame:
    """Mean and deviation over seeds per model and K, one column per variant, with the gain of the first.

    ``log4_k`` is the axis value. The averages are taken in one grouping, with one condition per variant.
    """
    shown = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    parts = []
    for name in variants:
        here = F.when(F.col(variant) == name, F.col(score))
        parts += [F.avg(here).alias(f"__m_{name}"), F.stddev_samp(here).alias(f"__s_{name}")]
    curve = scores.groupBy(*model, k).agg(*parts, F.count("*").alias("n_runs"))
    first, second = variants
    return curve.select(
        *model, k, shown(F.log(4.0, F.col(k).cast("double"))).alias("log4_k"), "n_runs",
        *[shown(F.col(f"__m_{v}")).alias(f"{v}_mean") for v in variants],
        *[shown(F.col(f"__s_{v}")).alias(f"{v}_std") for v in variants],
        shown(F.col(f"__m_{first}") - F.col(f"__m_{second}")).alias("gain"))


def size_curve(scores: DataFrame, sizes: DataFrame, model: str = "model", params: str = "params_millions",
               score: str = "f1", k: str = "k", digits: int | None = 4) -> DataFrame:
    """Mean score against the base-2 logarithm of the model size, one line per K.

    Scores are averaged per model first, so the join is between two small tables.
    """
    shown = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    means = scores.groupBy(model, k).agg(F.avg(score).alias("__m"))
    return means.join(sizes.select(model, params), model).select(
        k, model, shown(F.log2(F.col(params).cast("double"))).alias("log2_params"), shown("__m").alias("score"))
