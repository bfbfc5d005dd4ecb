"""Queries over vectors: losses, reports, the mirror join, heads and the CRF."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import crf, crf_long, heads, metrics, represent
from ..operators.ordered import dense_index
from ..session import stored
from . import inputs
from .registry import registry
from .tagging import REPORT_SQL

QUERIES, ORACLES, query = registry()

K = 10
PARAMS = crf.CrfParams.of(
    [[((3 * i + 5 * j) % 7 - 3) / 10.0 for j in range(K)] for i in range(K)],
    [(i - 2) / 10.0 for i in range(K)], [(2 - i) / 10.0 for i in range(K)])

LOGITS_SQL = """
logits AS (SELECT vec_id, vec_id // 32 AS batch, list_transform(embedding[1:10], lambda v: v::DOUBLE) AS x,
  CASE WHEN vec_id % 7 = 0 THEN -100 ELSE label END AS label FROM embeddings),
losses AS (SELECT *, CASE WHEN label <> -100 THEN
  ln(list_sum(list_transform(x, lambda v: exp(v)))) - x[label + 1] END AS loss FROM logits)"""


def _logits(spark, folder):
    """Ten dimensions as tag scores; every seventh label is ignored."""
    return inputs.table(spark, folder, "embeddings").select(
        "vec_id", F.floor(F.col("vec_id") / 32).alias("batch"),
        F.slice("embedding", 1, 10).cast("array<double>").alias("logits"),
        F.when(F.col("vec_id") % 7 == 0, -100).otherwise(F.col("label")).cast("int").alias("label"))


@query("argmax", """
SELECT vec_id, (list_position(embedding[1:10], list_max(embedding[1:10])) - 1)::BIGINT AS pred FROM embeddings""")
def argmax(spark, folder):
    return _logits(spark, folder).select("vec_id", numeric.argmax(F.col("logits")).cast("bigint").alias("pred"))


@query("argmax_report", f"""WITH {LOGITS_SQL}, pairs AS (SELECT label::VARCHAR AS gold,
  (list_position(x, list_max(x)) - 1)::VARCHAR AS pred FROM logits WHERE label <> -100), {REPORT_SQL}""")
def argmax_report(spark, folder):
    rows = _logits(spark, folder).where(F.col("label") != -100)
    pairs = rows.select(F.col("label").cast("string").alias("gold"),
                        numeric.argmax(F.col("logits")).cast("string").alias("pred"))
    confused = pairs.groupBy("gold", "pred").agg(F.count("*").alias("n"))
    return metrics.label_report(confused, digits=4)


@query("cross_entropy", f"WITH {LOGITS_SQL} SELECT round(avg(loss), 4) AS loss FROM losses")
def cross_entropy(spark, folder):
    return metrics.mean_loss(_logits(spark, folder)).select(F.round("loss", 4).alias("loss"))


@query("mean_batch_loss", f"""WITH {LOGITS_SQL}, batches AS (SELECT batch, avg(loss) AS l FROM losses GROUP BY batch)
SELECT round(avg(l), 4) AS loss FROM batches""")
def mean_batch_loss(spark, folder):
    return metrics.epoch_loss(_logits(spark, folder), "batch").select(F.round("loss", 4).alias("loss"))


def _placed_vectors(spark, folder, valid):
    """Ten neighbouring ids are one sequence, whichever of them there are; ``place`` counts its ``n`` positions from 0.

    ``mask`` marks its ``n_valid`` valid ones.
    """
    rows = inputs.table(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / 10).cast("bigint").alias("seq_id"), (F.col("vec_id") % 10).alias("pos"),
        "embedding").withColumn("mask", valid.cast("int"))
    whole = Window.partitionBy("seq_id")
    return rows.withColumns({
        "place": F.dense_rank().over(whole.orderBy("pos")) - 1, "n": F.size(F.collect_set("pos").over(whole)),
        "n_valid": F.size(F.collect_set(F.when(F.col("mask") == 1, F.col("pos"))).over(whole))})


def _sides(rows, place):
    return (rows.select("seq_id", "pos", "place", "mask", F.slice("embedding", 1, 32).alias("vec")),
            rows.select("seq_id", place.alias("place"), F.slice("embedding", 33, 32).alias("vec")))


def _states(spark, folder):
    """Forward states are dimensions 1-32; backward states, 33-64, stand at the mirrored position.

    Sequences of up to ten, in which the last ``seq_id % 4`` of ten positions are pads.
    """
    rows = _placed_vectors(spark, folder, F.col("pos") < 10 - F.col("seq_id") % 4)
    return _sides(rows, F.when(F.col("mask") == 1, F.col("n_valid") - 1 - F.col("place")).otherwise(F.col("place")))


def _joined_states(forward, backward):
    joined = represent.mirror_join(forward, backward, pos="place", mask="mask", keep=["pos"])
    weighted = F.transform("vec", lambda v, i: v.cast("double") * (i + 1))
    return joined.select("seq_id", "pos", F.size("vec").cast("bigint").alias("width"),
                         F.round(numeric.total(weighted), 4).alias("checksum"))


@query("mirror_join", """
SELECT vec_id // 10 AS seq_id, vec_id % 10 AS pos, len(embedding)::BIGINT AS width,
  round(list_sum(list_transform(embedding, lambda v, i: v::DOUBLE * i)), 4) AS checksum FROM embeddings""")
def mirror_join(spark, folder):
    return _joined_states(*_states(spark, folder))


@query("mirror_join_left", """
SELECT vec_id // 10 AS seq_id, vec_id % 10 AS pos, len(embedding)::BIGINT AS width,
  round(list_sum(list_transform(embedding, lambda v, i: v::DOUBLE * i)), 4) AS checksum FROM embeddings""")
def mirror_join_left(spark, folder):
    """Pads in front: the backward states of valid positions stand behind them, in reversed order."""
    rows = _placed_vectors(spark, folder, F.col("pos") >= F.col("seq_id") % 4)
    return _joined_states(*_sides(rows, F.when(F.col("place") < F.col("n_valid"), F.col("n") - 1 - F.col("place"))
                                  .otherwise(F.col("place") - F.col("n_valid"))))


@query("forward_states", """
SELECT vec_id // 10 AS seq_id, vec_id % 10 AS pos,
  round(list_sum(list_transform(embedding[1:32], lambda v, i: v::DOUBLE * i)), 4) AS checksum FROM embeddings""")
def forward_states(spark, folder):
    kept = represent.mirror_join(*_states(spark, folder), mask="mask", mode="forward")
    weighted = F.transform("vec", lambda v, i: v.cast("double") * (i + 1))
    return kept.select("seq_id", "pos", F.round(numeric.total(weighted), 4).alias("checksum"))


HIDDEN, LABELS = 8, 10


@query("head_scores", f"""
WITH h AS (SELECT vec_id, list_transform(range({HIDDEN}), lambda i: greatest(0.0::DOUBLE, (i - 4) / 10.0::DOUBLE
    + list_sum(list_transform(embedding, lambda v, j: v::DOUBLE * (((3 * i + 5 * (j - 1)) % 7) - 3) / 10.0::DOUBLE))))
    AS hid FROM embeddings)
SELECT vec_id, array_to_string(list_transform(range({LABELS}), lambda k: format('{{:.3f}}', abs(round(
  (k - 5) / 10.0::DOUBLE + list_sum(list_transform(hid, lambda v, j: v * (((2 * k + 3 * (j - 1)) % 5) - 2)
  / 10.0::DOUBLE)), 3)))), ',') AS logits FROM h""")
def head_scores(spark, folder):
    hidden = np.array([[((3 * i + 5 * j) % 7 - 3) / 10.0 for j in range(64)] for i in range(HIDDEN)])
    out = np.array([[((2 * k + 3 * j) % 5 - 2) / 10.0 for j in range(HIDDEN)] for k in range(LABELS)])
    scored = represent.head_scores(
        inputs.table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vec")),
        hidden, (np.arange(HIDDEN) - 4) / 10.0, out, (np.arange(LABELS) - 5) / 10.0)
    shown = F.transform("logits", lambda x: F.format_number(F.abs(F.round(x, 3)), 3))
    return scored.select("vec_id", F.array_join(shown, ",").alias("logits"))


@query("head_gradient", f"""
WITH z AS (SELECT vec_id, label, k, embedding, (k - 5) / 10.0::DOUBLE + list_sum(list_transform(embedding,
    lambda v, j: v::DOUBLE * (((3 * k + 5 * (j - 1)) % 7) - 3) / 50.0::DOUBLE)) AS z FROM embeddings, range({LABELS}) t(k)),
d AS (SELECT k, embedding, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) - (label = k)::INT AS d FROM z),
flat AS (SELECT k, d, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS v FROM d)
SELECT k::INT AS label, dim::INT AS dim, round(avg(d * v), 5) + 0.0::DOUBLE AS slope FROM flat GROUP BY k, dim
UNION ALL SELECT k::INT, -1, round(avg(d), 5) + 0.0::DOUBLE FROM d GROUP BY k""")
def head_gradient(spark, folder):
    """Slope of the mean cross-entropy of the linear head in every weight, and (dim -1) in every bias."""
    rows = inputs.table(spark, folder, "embeddings").select(F.col("embedding").alias("vec"), "label")
    weights = np.array([[((3 * k + 5 * j) % 7 - 3) / 50.0 for j in range(64)] for k in range(LABELS)])
    found = represent.head_gradient(rows, weights, (np.arange(LABELS) - 5) / 10.0)
    return found.select("label", "dim", (F.round("slope", 5) + F.lit(0.0)).alias("slope"))


def _fits(spark, checks):
    """One row per thing that a fit must reach, and whether it did."""
    return spark.createDataFrame([(name, bool(holds)) for name, holds in checks.items()], "reached string, holds boolean")


def _reached(*names):
    return " UNION ALL ".join(f"SELECT '{name}' AS reached, true AS holds" for name in names)


@query("head_fit", _reached("flat", "better than chance"))
def head_fit(spark, folder):
    """Linear head fitted by distributed L-BFGS: the slope of its loss (with its penalty) all but vanishes."""
    rows = inputs.table(spark, folder, "embeddings").select(F.col("embedding").alias("vec"), "label")
    model = represent.fit_head(rows, "linear", maxIter=100, regParam=0.01, standardization=False, tol=1e-9)
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    slopes = represent.head_gradient(rows, weights, bias)
    kept = {(r["label"], r["dim"]): r["slope"] for r in slopes.collect()}  # labels x (dimensions + 1)
    most = max((abs(v + (0.01 * weights[k, d] if d >= 0 else 0.0)) for (k, d), v in kept.items()), default=0.0)
    wrong = represent.apply_head(model, rows).agg(F.avg((F.col("pred") != F.col("label")).cast("int"))).first()[0] or 0.0
    return _fits(spark, {"flat": most < 1e-3, "better than chance": wrong < 0.9})


LAYERS = {"hidden": [[((3 * i + 5 * j) % 7 - 3) / 10.0 for j in range(64)] for i in range(HIDDEN)], "hidden_bias": [(i - 4) / 10.0 for i in range(HIDDEN)],
          "out": [[((2 * k + 3 * j) % 5 - 2) / 10.0 for j in range(HIDDEN)] for k in range(LABELS)], "out_bias": [(k - 5) / 10.0 for k in range(LABELS)]}


def _forward_sql(n: int) -> str:
    """Hidden units, probabilities and slopes at the weights u{n} (hidden; dim -1 is the bias) and o{n} (out)."""
    return f"""
a{n} AS MATERIALIZED (SELECT vec_id, label, u.i, sum(v * u.w) AS a FROM flat JOIN u{n} u USING (j) GROUP BY vec_id, label, u.i),
h{n} AS MATERIALIZED (SELECT vec_id, label, i, greatest(a, 0) AS h, a > 0 AS fires FROM a{n} UNION ALL SELECT vec_id, label, -1, 1.0, false FROM embeddings),
z{n} AS MATERIALIZED (SELECT h.vec_id, h.label, o.k, sum(h.h * o.w) AS z FROM h{n} h JOIN o{n} o USING (i) GROUP BY h.vec_id, h.label, o.k),
p{n} AS MATERIALIZED (SELECT vec_id, label, k, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) AS p FROM z{n}),
gu{n} AS MATERIALIZED (SELECT b.i, f.j, avg(b.d * f.v) AS g FROM (SELECT p.vec_id, o.i, sum((p.p - (p.label = p.k)::INT) * o.w) * any_value(h.fires)::INT AS d
    FROM p{n} p JOIN o{n} o USING (k) JOIN h{n} h ON h.vec_id = p.vec_id AND h.i = o.i WHERE o.i >= 0 GROUP BY p.vec_id, o.i) b
  JOIN flat f USING (vec_id) GROUP BY b.i, f.j),
go{n} AS MATERIALIZED (SELECT p.k, h.i, avg((p.p - (p.label = p.k)::INT) * h.h) AS g FROM p{n} p JOIN h{n} h USING (vec_id) GROUP BY p.k, h.i)"""


LAYERS_SQL = f"""WITH flat AS MATERIALIZED (SELECT vec_id, label, j::INT AS j, CASE WHEN j < 0 THEN 1.0 ELSE embedding[j + 1]::DOUBLE END AS v FROM embeddings, range(-1, 64) t(j)),
u0 AS (SELECT i::INT AS i, j::INT AS j, CASE WHEN j < 0 THEN (i - 4) / 10.0::DOUBLE ELSE (((3 * i + 5 * j) % 7) - 3) / 10.0::DOUBLE END AS w FROM range({HIDDEN}) a(i), range(-1, 64) b(j)),
o0 AS (SELECT k::INT AS k, i::INT AS i, CASE WHEN i < 0 THEN (k - 5) / 10.0::DOUBLE ELSE (((2 * k + 3 * i) % 5) - 2) / 10.0::DOUBLE END AS w FROM range({LABELS}) a(k), range(-1, {HIDDEN}) b(i)),{_forward_sql(0)}"""


def _layers():
    return heads.TwoLayer(*[np.array(LAYERS[x]) for x in ("hidden", "hidden_bias", "out", "out_bias")])


@query("two_layer_gradient", f"""{LAYERS_SQL}
SELECT 'hidden' AS layer, i AS unit, j AS input, round(g, 5) + 0.0::DOUBLE AS slope FROM gu0
UNION ALL SELECT 'out', k, i, round(g, 5) + 0.0::DOUBLE FROM go0""")
def two_layer_gradient(spark, folder):
    """Slope of the mean cross-entropy of a two-layer head in every weight; input -1 is the bias."""
    rows = inputs.table(spark, folder, "embeddings").select(F.col("embedding").alias("vec"), "label")
    head = _layers()
    _, flat, _ = heads.two_layer_loss(rows, head)
    slope = head.like(flat)
    found = []
    for layer, weights, bias in (("hidden", slope.hidden, slope.hidden_bias), ("out", slope.out, slope.out_bias)):
        table = np.column_stack([bias, weights])
        found += [(layer, i, j - 1, round(float(x), 5) + 0.0) for (i, j), x in np.ndenumerate(table)]
    return spark.createDataFrame(found, "layer string, unit int, input int, slope double")


@query("two_layer_step", f"""{LAYERS_SQL},
u1 AS MATERIALIZED (SELECT i, j, w - 0.5 * g AS w FROM u0 JOIN gu0 USING (i, j)), o1 AS MATERIALIZED (SELECT k, i, w - 0.5 * g AS w FROM o0 JOIN go0 USING (k, i)),{_forward_sql(1)}
SELECT 0 AS step, round(avg(-ln(p)), 5) AS loss FROM p0 WHERE k = label UNION ALL SELECT 1, round(avg(-ln(p)), 5) FROM p1 WHERE k = label""")
def two_layer_step(spark, folder):
    """The loss before and after one step of a half along the slope."""
    rows = inputs.table(spark, folder, "embeddings").select(F.col("embedding").alias("vec"), "label")
    head = _layers()
    before, slope, _ = heads.two_layer_loss(rows, head)
    after, _, _ = heads.two_layer_loss(rows, head.like(head.flat() - 0.5 * slope))
    return spark.createDataFrame([(0, round(before, 5)), (1, round(after, 5))], "step int, loss double")


@query("head_fit_two_layer", _reached("falls", "better than chance"))
def head_fit_two_layer(spark, folder):
    """Two-layer head fitted by L-BFGS: no step raises the loss, and it ends below that of even odds."""
    rows = inputs.table(spark, folder, "embeddings").select(F.col("embedding").alias("vec"), "label")
    _, losses = heads.fit_two_layer(rows, heads.two_layer_start(64, 16, LABELS), iterations=6)
    return _fits(spark, {"falls": len(losses) > 1 and all(b < a for a, b in zip(losses, losses[1:])), "better than chance": losses[-1] < math.log(LABELS)})


GRID = [heads.Setting(rate, penalty) for rate in (0.5, 2.0) for penalty in (0.0, 0.1)]


def _descent_sql(steps: int) -> str:
    cells = ", ".join(f"({i}, {x.rate}::DOUBLE, {x.penalty}::DOUBLE)" for i, x in enumerate(GRID))
    parts = [f"""WITH cells AS (SELECT * FROM (VALUES {cells}) t(s, rate, penalty)),
rows AS MATERIALIZED (SELECT vec_id, label, embedding, ('0x' || substr(md5('42:' || vec_id), 1, 8))::BIGINT % 10000 < 2000 AS held FROM embeddings),
flat AS MATERIALIZED (SELECT vec_id, j::INT AS j, held, CASE WHEN j = 0 THEN 1.0 ELSE embedding[j]::DOUBLE END AS v FROM rows, range(65) t(j)),
size AS (SELECT count(*) AS n FROM rows WHERE NOT held),
w0 AS (SELECT s, k::INT AS k, j::INT AS j, 0.0::DOUBLE AS w FROM cells, range({LABELS}) a(k), range(65) b(j))"""]
    for t in range(steps + 1):
        parts.append(f"""
z{t} AS MATERIALIZED (SELECT vec_id, w.s, w.k, sum(v * w.w) AS z FROM flat JOIN w{t} w USING (j) GROUP BY vec_id, w.s, w.k),
p{t} AS MATERIALIZED (SELECT z.*, rows.label, rows.held, exp(z) / sum(exp(z)) OVER (PARTITION BY z.vec_id, s) AS p FROM z{t} z JOIN rows USING (vec_id)),
l{t} AS MATERIALIZED (SELECT s, {t} AS steps, avg(-ln(p)) FILTER (NOT held) AS train_loss, avg(-ln(p)) FILTER (held) AS held_loss FROM p{t} WHERE k = label GROUP BY s),
c{t} AS MATERIALIZED (SELECT s, avg((best = label)::INT) AS accuracy FROM (SELECT s, vec_id, label, arg_max(k, z) AS best FROM p{t} WHERE held GROUP BY s, vec_id, label) GROUP BY s)""")
        if t < steps:
            parts.append(f"""
g{t} AS MATERIALIZED (SELECT p.s, p.k, f.j, sum((p.p - (p.label = p.k)::INT) * f.v) / any_value(n) AS g FROM p{t} p JOIN flat f USING (vec_id), size
  WHERE NOT p.held GROUP BY p.s, p.k, f.j),
w{t + 1} AS MATERIALIZED (SELECT s, k, j, w - rate * (g + penalty * w) AS w FROM w{t} JOIN g{t} USING (s, k, j) JOIN cells USING (s))""")
    return ",".join(parts)


def _scores_sql(source: str) -> str:
    return f"""SELECT rate, penalty, steps, round(train_loss, 4) AS train_loss, round(held_loss, 4) AS held_loss, round(accuracy, 4) AS accuracy
FROM ({source}) JOIN cells USING (s)"""


def _searched(spark, folder, steps):
    rows = inputs.table(spark, folder, "embeddings").select(F.col("embedding").alias("vec"), "label", heads.held_out(0.2, 42, F.col("vec_id")).alias("held"))
    found = heads.grid_descent(rows, GRID, LABELS, 64, steps)
    return spark.createDataFrame([(x.setting.rate, x.setting.penalty, x.steps, round(x.train_loss, 4), round(x.held_loss, 4), round(x.accuracy, 4)) for x in found],
                                 "rate double, penalty double, steps int, train_loss double, held_loss double, accuracy double")


@query("head_grid", f"{_descent_sql(3)} {_scores_sql('SELECT * FROM l3 JOIN c3 USING (s)')}")
def head_grid(spark, folder):
    """Losses of every setting of a small grid after three steps, all settings in the same scans."""
    return _searched(spark, folder, [3])


@query("head_halving", f"""{_descent_sql(4)},
kept AS (SELECT s FROM l2 QUALIFY row_number() OVER (ORDER BY round(held_loss, 9), s) <= 2)
{_scores_sql("SELECT * FROM l4 JOIN c4 USING (s) WHERE s IN (SELECT s FROM kept) UNION ALL SELECT * FROM l2 JOIN c2 USING (s) WHERE s NOT IN (SELECT s FROM kept)")}""")
def head_halving(spark, folder):
    """The better half of the settings after two steps takes two more."""
    return _searched(spark, folder, [2, 2])


EMISSIONS_SQL = f"""
em AS (SELECT vec_id // 10 AS s, vec_id % 10 AS p, label::INT AS tag, j::INT AS j,
  embedding[j + 1]::DOUBLE AS x FROM embeddings, range({K}) t(j)),
tr AS (SELECT i::INT AS i, j::INT AS j, (((3 * i + 5 * j) % 7) - 3) / 10.0::DOUBLE AS w
  FROM range({K}) a(i), range({K}) b(j)),
ends AS (SELECT s, max(p) AS z FROM em GROUP BY s)"""

PATH_SQL = """
path AS (SELECT s, p, x, tag, lag(tag) OVER (PARTITION BY s ORDER BY p) AS prev FROM em WHERE j = tag),
scores AS (SELECT path.s, sum(x + coalesce(w, 0) + CASE WHEN p = 0 THEN (tag - 2) / 10.0::DOUBLE ELSE 0 END
  + CASE WHEN p = z THEN (2 - tag) / 10.0::DOUBLE ELSE 0 END) AS score
  FROM path JOIN ends ON ends.s = path.s LEFT JOIN tr ON tr.i = prev AND tr.j = tag GROUP BY path.s)"""
SCORE_SQL = f"{EMISSIONS_SQL},{PATH_SQL}"

PARTITION_SQL = """
al(s, p, j, v) AS (
  SELECT s, p, j, x + (j - 2) / 10.0::DOUBLE FROM em WHERE p = 0
  UNION ALL
  SELECT e.s, e.p, e.j, any_value(e.x) + ln(sum(exp(al.v + tr.w)))
  FROM al JOIN tr ON tr.i = al.j JOIN em e ON e.s = al.s AND e.p = al.p + 1 AND e.j = tr.j GROUP BY e.s, e.p, e.j),
logz AS (SELECT al.s, ln(sum(exp(v + (2 - j) / 10.0::DOUBLE))) AS log_z FROM al JOIN ends ON ends.s = al.s AND p = z
  GROUP BY al.s)"""


def _sequences(spark, folder, rows=None):
    rows = inputs.emissions(spark, folder) if rows is None else rows
    return crf.assemble_sequences(rows, columns=["vec", "tag"],
                                  names=["emissions", "tags"])


@query("crf_score", f"WITH {SCORE_SQL} SELECT s AS seq_id, round(score, 4) AS score FROM scores")
def crf_score(spark, folder):
    score = crf.sequence_score(F.col("emissions"), F.col("tags"), PARAMS)
    return _sequences(spark, folder).select("seq_id", F.round(score, 4).alias("score"))


@query("crf_partition", f"""WITH RECURSIVE {EMISSIONS_SQL}, {PARTITION_SQL}
SELECT s AS seq_id, round(log_z, 4) AS log_z FROM logz""")
def crf_partition(spark, folder):
    return _sequences(spark, folder).select(
        "seq_id", F.round(crf.log_partition(F.col("emissions"), PARAMS), 4).alias("log_z"))


@query("crf_nll", f"""WITH RECURSIVE {SCORE_SQL}, {PARTITION_SQL}
SELECT round(avg(log_z - score), 4) AS nll FROM logz JOIN scores USING (s)""")
def crf_nll(spark, folder):
    return crf.mean_nll(_sequences(spark, folder), PARAMS).select(F.round("nll", 4).alias("nll"))


# every third vector's label is ignored: its position is left out, or counts as tag 0
MASKED_SQL = EMISSIONS_SQL.replace("em AS (", "em_all AS (", 1).replace("label::INT AS tag", "CASE WHEN vec_id % 3 = 0 THEN -100 ELSE label END AS tag") .replace(
    "tr AS (", """em AS (SELECT s, dense_rank() OVER (PARTITION BY s ORDER BY p) - 1 AS p, tag::INT AS tag, j, x FROM em_all
  WHERE tag <> -100),
tr AS (""", 1)
ZERO_SQL = EMISSIONS_SQL.replace("label::INT AS tag", "CASE WHEN vec_id % 3 = 0 THEN 0 ELSE label END::INT AS tag")


def _masked(spark, folder):
    rows = inputs.table(spark, folder, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 10).cast("bigint").alias("seq_id"))
    ignored = rows.where("vec_id % 3 = 0").select("seq_id", (F.col("vec_id") % 10).alias("pos"), F.lit(True).alias("off"))
    return _sequences(spark, folder, inputs.emissions(spark, folder).join(ignored, ["seq_id", "pos"], "left").withColumn(
        "tag", F.when(F.col("off"), -100).otherwise(F.col("tag"))))


@query("crf_nll_masked", f"""WITH RECURSIVE {MASKED_SQL},{PATH_SQL}, {PARTITION_SQL}
SELECT round(avg(log_z - score), 4) AS nll FROM logz JOIN scores USING (s)""")
def crf_nll_masked(spark, folder):
    return crf.mean_nll(_masked(spark, folder), PARAMS).select(F.round("nll", 4).alias("nll"))


@query("crf_nll_pad_zero", f"""WITH RECURSIVE {ZERO_SQL},{PATH_SQL}, {PARTITION_SQL}
SELECT round(avg(log_z - score), 4) AS nll FROM logz JOIN scores USING (s)""")
def crf_nll_pad_zero(spark, folder):
    return crf.mean_nll(_masked(spark, folder), PARAMS, pad_as_zero=True).select(F.round("nll", 4).alias("nll"))


# observed less expected counts, by the forward and backward recursions
GRADIENT_SQL = f"""{PARTITION_SQL},
bt(s, p, j, v) AS (
  SELECT em.s, em.p, em.j, (2 - em.j) / 10.0::DOUBLE FROM em JOIN ends ON ends.s = em.s AND em.p = z
  UNION ALL
  SELECT e.s, e.p - 1, tr.i, ln(sum(exp(tr.w + e.x + bt.v)))
  FROM bt JOIN em e ON e.s = bt.s AND e.p = bt.p AND e.j = bt.j JOIN tr ON tr.j = e.j WHERE e.p > 0
  GROUP BY e.s, e.p, tr.i),
parts(slot, v) AS (
  SELECT prev * {K} + tag, 1.0::DOUBLE FROM path WHERE prev IS NOT NULL
  UNION ALL SELECT {K * K} + tag, 1.0 FROM path WHERE prev IS NULL
  UNION ALL SELECT {K * K + K} + tag, 1.0 FROM path JOIN ends ON ends.s = path.s AND p = z
  UNION ALL SELECT tr.i * {K} + tr.j, -exp(al.v + tr.w + e.x + bt.v - log_z) FROM al JOIN tr ON tr.i = al.j
    JOIN em e ON e.s = al.s AND e.p = al.p + 1 AND e.j = tr.j
    JOIN bt ON bt.s = e.s AND bt.p = e.p AND bt.j = e.j JOIN logz ON logz.s = al.s
  UNION ALL SELECT {K * K} + al.j, -exp(al.v + bt.v - log_z) FROM al JOIN bt USING (s, p, j) JOIN logz USING (s) WHERE p = 0
  UNION ALL SELECT {K * K + K} + al.j, -exp(al.v + (2 - al.j) / 10.0::DOUBLE - log_z) FROM al
    JOIN ends ON ends.s = al.s AND p = z JOIN logz ON logz.s = al.s
  UNION ALL SELECT -1, score - log_z FROM scores JOIN logz USING (s)
  UNION ALL SELECT -2, 1.0 FROM logz)"""


@query("crf_gradient", f"""WITH RECURSIVE {MASKED_SQL},{PATH_SQL}, {GRADIENT_SQL}
SELECT slot::INT AS slot, round(sum(v), 4) + 0.0::DOUBLE AS value FROM parts GROUP BY slot""")
def crf_gradient(spark, folder):
    """Slope of the log-likelihood in every transition, start and stop score, with ignored labels."""
    found = crf.gradient(_masked(spark, folder), PARAMS)
    return found.select("slot", (F.round("value", 4) + F.lit(0.0)).alias("value"))


@query("crf_viterbi", f"""WITH RECURSIVE {EMISSIONS_SQL},
vit(s, p, j, v, path) AS (
  SELECT s, p, j, x + (j - 2) / 10.0::DOUBLE, j::VARCHAR FROM em WHERE p = 0
  UNION ALL
  SELECT e.s, e.p, e.j, any_value(e.x) + max(vit.v + tr.w), arg_max(vit.path, vit.v + tr.w) || ',' || e.j
  FROM vit JOIN tr ON tr.i = vit.j JOIN em e ON e.s = vit.s AND e.p = vit.p + 1 AND e.j = tr.j
  GROUP BY e.s, e.p, e.j)
SELECT vit.s AS seq_id, arg_max(path, v + (2 - j) / 10.0::DOUBLE) AS path FROM vit JOIN ends ON ends.s = vit.s AND p = z
GROUP BY vit.s""")
def crf_viterbi(spark, folder):
    path = crf.viterbi(F.col("emissions"), PARAMS)
    return _sequences(spark, folder).select(
        "seq_id", F.array_join(path.cast("array<string>"), ",").alias("path"))


# ---- one sequence of all vectors, and 133 labels ----

LONG_SQL = EMISSIONS_SQL.replace("vec_id // 10 AS s, vec_id % 10 AS p", "0::BIGINT AS s, p").replace(
    "FROM embeddings,", "FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS p FROM embeddings),")
WIDE = 133
WIDE_PARAMS = crf.CrfParams.of(
    [[((3 * i + 5 * j) % 7 - 3) / 10.0 for j in range(WIDE)] for i in range(WIDE)],
    [(i - 2) / 100.0 for i in range(WIDE)], [(2 - i) / 100.0 for i in range(WIDE)])
WIDE_SQL = EMISSIONS_SQL.replace(f"range({K})", f"range({WIDE})").replace(
    "embedding[j + 1]::DOUBLE AS x", "embedding[(j % 64)::INT + 1]::DOUBLE * (1 + j // 64) AS x")


def _hundredths(sql):
    return sql.replace("(j - 2) / 10.0", "(j - 2) / 100.0").replace("(2 - j) / 10.0", "(2 - j) / 100.0")


def _long(spark, folder):
    """All vectors in one sequence, in the order of their ids."""
    rows = inputs.table(spark, folder, "embeddings").select(
        "vec_id", F.lit(0).cast("long").alias("seq_id"), F.slice("embedding", 1, K).cast("array<double>").alias("vec"), F.col("label").cast("int").alias("tag"))
    return dense_index(rows, "pos", ["vec_id"], ["seq_id"]).drop("vec_id")


def _wide(spark, folder):
    """Sequences of ten vectors; the 133 scores are the 64 dimensions once, twice and three times as large."""
    vec = F.transform(F.sequence(F.lit(0), F.lit(WIDE - 1)), lambda j: F.element_at("embedding", j % 64 + 1).cast("double") * (1 + F.floor(j / 64)))
    return inputs.table(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / 10).cast("bigint").alias("seq_id"), (F.col("vec_id") % 10).alias("pos"), vec.alias("vec"))


def _stable(sql):
    """Sums of exponentials taken from their greatest term, as the scores of a long sequence need it."""
    lse = "list_max(l) + ln(list_sum(list_transform(l, lambda q: exp(q - list_max(l)))))"
    forward = """SELECT e.s, e.p, e.j, any_value(e.x) + ln(sum(exp(al.v + tr.w)))
  FROM al JOIN tr ON tr.i = al.j JOIN em e ON e.s = al.s AND e.p = al.p + 1 AND e.j = tr.j GROUP BY e.s, e.p, e.j"""
    ends = """SELECT al.s, ln(sum(exp(v + (2 - j) / 10.0::DOUBLE))) AS log_z FROM al JOIN ends ON ends.s = al.s AND p = z
  GROUP BY al.s"""
    back = """SELECT e.s, e.p - 1, tr.i, ln(sum(exp(tr.w + e.x + bt.v)))
  FROM bt JOIN em e ON e.s = bt.s AND e.p = bt.p AND e.j = bt.j JOIN tr ON tr.j = e.j WHERE e.p > 0
  GROUP BY e.s, e.p, tr.i"""
    for old, columns, plus in ((forward, "s, p, j", "x + "), (ends, "s", ""), (back, "s, p, i", "")):
        inner = old.replace("any_value(e.x) + ", "any_value(e.x) AS x, ").replace(" AS log_z", "").replace("e.p - 1", "e.p - 1 AS p")
        inner = inner.replace("ln(sum(exp(", "list(").replace(")))", ") AS l", 1) if old is not ends else inner.replace("ln(sum(exp(v + (2 - j) / 10.0::DOUBLE)))", "list(v + (2 - j) / 10.0::DOUBLE) AS l")
        sql = sql.replace(old, f"SELECT {columns}, {plus}{lse}{' AS log_z' if old is ends else ''} FROM ({inner})")
    return sql


@query("crf_partition_long", f"""WITH RECURSIVE {LONG_SQL}, {_stable(PARTITION_SQL)}
SELECT s AS seq_id, round(log_z, 4) AS log_z FROM logz""")
def crf_partition_long(spark, folder):
    return crf_long.log_partition(_long(spark, folder), PARAMS, ["seq_id"]).withColumn("log_z", F.round("log_z", 4))


@query("crf_partition_wide", f"""WITH RECURSIVE {WIDE_SQL}, {_hundredths(PARTITION_SQL)}
SELECT s AS seq_id, round(log_z, 4) AS log_z FROM logz""")
def crf_partition_wide(spark, folder):
    return crf_long.log_partition(_wide(spark, folder), WIDE_PARAMS, ["seq_id"]).withColumn("log_z", F.round("log_z", 4))


VITERBI_SQL = """
vit(s, p, j, v, path) AS (
  SELECT s, p, j, x + (j - 2) / 10.0::DOUBLE, j::VARCHAR FROM em WHERE p = 0
  UNION ALL
  SELECT e.s, e.p, e.j, any_value(e.x) + max(vit.v + tr.w), arg_max(vit.path, vit.v + tr.w) || ',' || e.j
  FROM vit JOIN tr ON tr.i = vit.j JOIN em e ON e.s = vit.s AND e.p = vit.p + 1 AND e.j = tr.j
  GROUP BY e.s, e.p, e.j),
best AS (SELECT vit.s, arg_max(path, v + (2 - j) / 10.0::DOUBLE) AS path FROM vit JOIN ends ON ends.s = vit.s AND p = z GROUP BY vit.s)
SELECT s AS seq_id, generate_subscripts(string_split(path, ','), 1) - 1 AS pos, unnest(string_split(path, ','))::INT AS tag FROM best"""


@query("crf_viterbi_long", f"WITH RECURSIVE {LONG_SQL}, {VITERBI_SQL}")
def crf_viterbi_long(spark, folder):
    return crf_long.viterbi(_long(spark, folder), PARAMS, ["seq_id"])


@query("crf_viterbi_wide", f"WITH RECURSIVE {WIDE_SQL}, {_hundredths(VITERBI_SQL)}")
def crf_viterbi_wide(spark, folder):
    return crf_long.viterbi(_wide(spark, folder), WIDE_PARAMS, ["seq_id"])


@query("crf_gradient_long", f"""WITH RECURSIVE {LONG_SQL},{PATH_SQL}, {_stable(GRADIENT_SQL)}
SELECT slot::INT AS slot, round(sum(v), 4) + 0.0::DOUBLE AS value FROM parts GROUP BY slot""")
def crf_gradient_long(spark, folder):
    found = crf_long.gradient(_long(spark, folder), PARAMS, ["seq_id"])
    return found.select("slot", (F.round("value", 4) + F.lit(0.0)).alias("value"))


@query("crf_fit", _reached("even odds first", "falls"))
def crf_fit(spark, folder):
    """Six gradient steps over all sequences from zero: the first loss is known, and every step lowers it."""
    rows = stored(_sequences(spark, folder), "sequences")
    _, losses = crf.fit(rows, K, iterations=6, rate=0.5)
    start, _ = crf.fit(rows, K, iterations=0)
    first = crf.mean_nll(rows, start).first()["nll"]
    return _fits(spark, {"even odds first": abs(losses[0] - first) < 1e-6, "falls": all(b < a for a, b in zip(losses, losses[1:]))})


BIGRAMS_SQL = """
steps AS (SELECT role, lag(role, 1, '<s>') OVER c AS prev, lead(role) OVER c AS next FROM conversations
  WINDOW c AS (PARTITION BY conv_id ORDER BY turn)),
bigrams AS (SELECT prev, cur, count(*) AS n FROM (SELECT prev, role AS cur FROM steps
  UNION ALL SELECT role, '</s>' FROM steps WHERE next IS NULL) GROUP BY prev, cur)"""


@query("label_bigrams", f"WITH {BIGRAMS_SQL} SELECT prev, cur, n FROM bigrams")
def label_bigrams(spark, folder):
    return crf.label_bigrams(inputs.table(spark, folder, "conversations"), "role", ["turn"], ["conv_id"])


@query("bigram_scores", f"""WITH {BIGRAMS_SQL},
tags AS (SELECT unnest(['assistant', 'system', 'user']) AS t),
pairs AS (SELECT p.t AS prev, c.t AS cur FROM (SELECT t FROM tags UNION ALL SELECT '<s>') p,
  (SELECT t FROM tags UNION ALL SELECT '</s>') c WHERE NOT (p.t = '<s>' AND c.t = '</s>')),
filled AS (SELECT prev, cur, coalesce(n, 0) AS n FROM pairs LEFT JOIN bigrams USING (prev, cur))
SELECT prev, cur, n, round(ln((n + 1.0::DOUBLE) / (sum(n) OVER (PARTITION BY prev)
  + count(*) OVER (PARTITION BY prev))), 4) AS log_p FROM filled""")
def bigram_scores(spark, folder):
    counted = crf.label_bigrams(inputs.table(spark, folder, "conversations"), "role", ["turn"], ["conv_id"])
    scored = crf.bigram_scores(counted, ["assistant", "system", "user"])
    return scored.withColumn("log_p", F.round("log_p", 4))
