"""Queries over runs: best epochs, logs, curves, grids and trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, runs
from ..operators.ordered import dense_index
from ..session import stored
from ..sources import runlog
from . import inputs
from .registry import registry

QUERIES, ORACLES, query = registry()

EPOCHS_SQL = """
ep AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch,
  value AS score FROM events)"""


def _epochs(spark, folder):
    return dense_index(inputs.epochs(spark, folder), "epoch", ["ts", "event_id"], ["run_id"], bucket=["bucket"])


def best_sql(fold: str, start: str, compare: str) -> str:
    return f"""WITH {EPOCHS_SQL},
seen AS (SELECT *, coalesce({fold}(score) OVER (PARTITION BY run_id ORDER BY epoch
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {start}) AS b FROM ep),
better AS (SELECT * FROM seen WHERE score {compare} b)
SELECT run_id, max(epoch)::BIGINT AS epoch, arg_max(score, epoch) AS score, count(*) AS n_improved FROM better
GROUP BY run_id"""


@query("best_epoch", best_sql("max", "0", ">"))
def best_epoch(spark, folder):
    improved = metrics.improvements(_epochs(spark, folder), "score", ["epoch"])
    return metrics.best_epochs(improved, ["epoch"], ["epoch", "score"])


@query("best_epoch_loss", best_sql("min", "'infinity'::DOUBLE", "<"))
def best_epoch_loss(spark, folder):
    improved = metrics.improvements(_epochs(spark, folder), "score", ["epoch"], higher=False)
    return metrics.best_epochs(improved, ["epoch"], ["epoch", "score"])


@query("improving_epochs", f"""WITH {EPOCHS_SQL},
seen AS (SELECT *, coalesce(max(score) OVER (PARTITION BY run_id ORDER BY epoch
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM ep)
SELECT run_id, epoch::BIGINT AS epoch, score FROM seen WHERE score > b""")
def improving_epochs(spark, folder):
    """The epochs at which a test score would be taken."""
    improved = metrics.improvements(_epochs(spark, folder), "score", ["epoch"])
    return improved.where("improved").select("run_id", "epoch", "score")


METRICS_SQL = """
raw AS (SELECT user_id AS run_id, event_id % 7 AS epoch,
  CASE event_type WHEN 'view' THEN 'train' WHEN 'click' THEN 'valid' ELSE 'test' END AS phase,
  CASE WHEN event_id % 2 = 1 THEN 'loss' ELSE 'score' END AS metric, value,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS end_time FROM events),
metrics AS (SELECT run_id, epoch, phase, metric, max(value) AS value, max(end_time) AS end_time FROM raw
  GROUP BY run_id, epoch, phase, metric)"""


def _metrics(spark, folder):
    phase = (F.when(F.col("event_type") == "view", "train").when(F.col("event_type") == "click", "valid")
             .otherwise("test"))
    return inputs.table(spark, folder, "events").select(
        F.col("user_id").alias("run_id"), (F.col("event_id") % 7).alias("epoch"), phase.alias("phase"),
        F.when(F.col("event_id") % 2 == 1, "loss").otherwise("score").alias("metric"), "value",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("end_time"))


@query("run_log", f"""WITH {METRICS_SQL}
SELECT run_id, epoch, max(value) FILTER (phase = 'train' AND metric = 'loss') AS train_loss,
  max(value) FILTER (phase = 'valid' AND metric = 'loss') AS valid_loss,
  max(value) FILTER (phase = 'valid' AND metric = 'score') AS valid_score,
  max(value) FILTER (phase = 'test' AND metric = 'score') AS test_score, max(end_time) AS end_time
FROM metrics GROUP BY run_id, epoch""")
def run_log(spark, folder):
    return runs.run_log(_metrics(spark, folder), ["train.loss", "valid.loss", "valid.score", "test.score"])


@query("run_log_json", f"""WITH {METRICS_SQL}
SELECT run_id, epoch, phase, metric, value, max(end_time) OVER (PARTITION BY run_id, epoch) AS end_time FROM metrics""")
def run_log_json(spark, folder):
    """One nested JSON log per run, written and read back as rows."""
    once = _metrics(spark, folder).groupBy("run_id", "epoch", "phase", "metric").agg(
        F.max("value").alias("value"), F.max("end_time").alias("end_time"))
    return runlog.read_log(runlog.write_log(once)).drop("json")


@query("run_log_tree", f"""WITH {METRICS_SQL}
SELECT run_id, epoch, phase, metric, value, max(end_time) OVER (PARTITION BY run_id, epoch) AS end_time FROM metrics""")
def run_log_tree(spark, folder):
    """Logs with reports in reports and names of dots, quotes, backslashes and braces: written, read, written and read again."""
    once = _metrics(spark, folder).groupBy("run_id", "epoch", "phase", "metric").agg(
        F.max("value").alias("value"), F.max("end_time").alias("end_time"))
    odd = 'report.a\\.b.say "{hi}" \\\\.'
    named = runlog.write_log(once.withColumn("metric", F.concat(F.lit(odd), F.col("metric"))))
    again = runlog.write_log(runlog.read_log(named))
    return runlog.read_log(again).withColumn("metric", F.when(F.startswith("metric", F.lit(odd)), F.substr("metric", F.lit(len(odd) + 1)))).drop("json")


@query("run_log_resume", f"""WITH {EPOCHS_SQL},
seen AS (SELECT *, coalesce(max(score) OVER (PARTITION BY run_id ORDER BY epoch
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM ep)
SELECT run_id, epoch::BIGINT AS epoch, score, score > b AS improved FROM seen WHERE epoch >= 3""")
def run_log_resume(spark, folder):
    """The first three epochs of every run stand in its log; the others go on from it as if it had not stopped."""
    epochs = stored(_epochs(spark, folder), "epochs")
    logged = epochs.where("epoch < 3").select("run_id", "epoch", F.lit("valid").alias("phase"), F.lit("score").alias("metric"), F.col("score").alias("value"))
    points = runlog.resume_points(runlog.read_log(runlog.write_log(logged)), "valid", "score")
    later = epochs.where("epoch >= 3").drop("epoch")
    return metrics.resumed(later, points, "score", ["ts", "event_id"], bucket=["bucket"]).select("run_id", "epoch", "score", "improved")


SCORES_SQL = """
scores AS (SELECT event_type AS model, [4, 16, 64, 128, 256][regexp_extract(props, '"k": *([0-9]+)', 1)::INT % 5 + 1]
  AS k, CASE WHEN event_id % 2 = 1 THEN 'forward' ELSE 'concat' END AS variant, value AS f1 FROM events)"""


def _scores(spark, folder):
    shots = F.array(*[F.lit(k) for k in (4, 16, 64, 128, 256)])
    place = F.get_json_object("props", "$.k").cast("int") % 5
    return inputs.table(spark, folder, "events").select(
        F.col("event_type").alias("model"), shots[place].alias("k"),
        F.when(F.col("event_id") % 2 == 1, "forward").otherwise("concat").alias("variant"),
        F.col("value").alias("f1"))


@query("fewshot_curve", f"""WITH {SCORES_SQL}
SELECT model, k, round(ln(k) / ln(4), 4) AS log4_k, count(*) AS n_runs,
  round(avg(f1) FILTER (variant = 'concat'), 4) AS concat_mean,
  round(avg(f1) FILTER (variant = 'forward'), 4) AS forward_mean,
  round(stddev_samp(f1) FILTER (variant = 'concat'), 4) AS concat_std,
  round(stddev_samp(f1) FILTER (variant = 'forward'), 4) AS forward_std,
  round(avg(f1) FILTER (variant = 'concat') - avg(f1) FILTER (variant = 'forward'), 4) AS gain
FROM scores GROUP BY model, k""")
def fewshot_curve(spark, folder):
    return metrics.learning_curve(_scores(spark, folder))


SIZES = [("view", 124), ("click", 335), ("purchase", 774), ("signup", 1500), ("error", 7000)]


@query("size_curve", f"""WITH {SCORES_SQL},
sizes AS (SELECT * FROM (VALUES {', '.join(f"('{m}', {p})" for m, p in SIZES)}) t(model, params))
SELECT k, model, round(log2(params), 4) AS log2_params, round(avg(f1), 4) AS score FROM scores JOIN sizes USING (model)
GROUP BY k, model, params""")
def size_curve(spark, folder):
    sizes = spark.createDataFrame(SIZES, "model string, params_millions int")
    return metrics.size_curve(_scores(spark, folder), sizes)


@query("grid", """
WITH base AS (SELECT DISTINCT user_id, event_type AS dataset FROM events)
SELECT user_id, dataset, k, lr, seed, format('runs/{}/{}/{}shot/lr{}/seed{}', user_id, dataset, k, lr, seed) AS run_id
FROM base, (SELECT unnest([4, 16, 64, 128, 256]) AS k), (SELECT unnest(['1e-3', '5e-4']) AS lr),
  (SELECT unnest([10, 11, 12]) AS seed)""")
def grid(spark, folder):
    """Every user's datasets by K, learning rate and seed."""
    base = inputs.table(spark, folder, "events").select("user_id", F.col("event_type").alias("dataset")).distinct()
    cells = runs.expand_grid(base, {"k": [4, 16, 64, 128, 256], "lr": ["1e-3", "5e-4"], "seed": [10, 11, 12]})
    return runs.with_run_id(cells, "runs/%s/%s/%sshot/lr%s/seed%s", "user_id", "dataset", "k", "lr", "seed")


CANDIDATES = {"batch_size": ["4", "8", "16", "32"], "lr": ["1e-3", "5e-4", "1e-4"], "dropout": ["0", "0.1", "0.2"]}


@query("trials", f"""
WITH users AS (SELECT DISTINCT user_id FROM events),
cands AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in CANDIDATES.items())}) t(key, vals))
SELECT user_id, trial::INT AS trial, key,
  vals[('0x' || substr(md5('42:' || user_id || ':' || trial || ':' || key), 1, 8))::BIGINT % len(vals) + 1] AS value
FROM users, (SELECT unnest(range(1, 11)) AS trial), cands""")
def trials(spark, folder):
    """Ten trials per user, each key drawn from its candidate list."""
    pairs = [x for k, v in CANDIDATES.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))]
    users = inputs.table(spark, folder, "events").select("user_id").distinct()
    return runs.random_trials(users.withColumn("candidates", F.create_map(*pairs)), "candidates", 10, 42, ["user_id"])
