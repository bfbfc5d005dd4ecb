import json
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexiloom.operators import metrics
from lexiloom.sources import corpora, render, runlog, tagged


def put(tmp_path, text, name="a.txt"):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


def by_lines(text):
    """Sentences of a tagged file, line by line; the second result is the sentence left open at the end."""
    done, open_ = [], []
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if lines[-1] == "":
        lines.pop()
    for line in (x.strip() for x in lines):
        if line == "":
            done.append(open_)
            open_ = []
        else:
            open_.append(tuple(line.split("\t")))
    return done, open_


TEXTS = ["a\tX\nb\tO\n\nc\tY\n\n", "a\tX\n\nb\tO", "a\tX\n\nb\tO\n", "\n\na\tX\n\n\n\nb\tO\n\n\n", "a\tX\n \t \nb\tO\n\n",
         "a\tX\r\n\r\nb\tO\r\n\r\nc\tO\r\n", "a\tX", "\n", "a\tX\n\n \n", "  a\tX  \n\n\nb\tO\n \n",
         "a\tX\r\n \t\r\nb\tO\r\n\u3000\r\n", "a\u0001\tX\nb\u0001c\tO\n\n\u0001\tX\n", "a\tX\rb\tO\r\rc\tO", ""]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("strict", [False, True])
def test_tagged_text_reads_like_lines(spark, tmp_path, text, strict):
    done, open_ = by_lines(text)
    want = done + ([open_] if open_ and not strict else [])
    rows = tagged.read_tagged(spark, put(tmp_path, text), strict_tail=strict).orderBy("sent_id").collect()
    assert [list(zip(r["tokens"], r["tags"])) for r in rows] == want
    assert [r["sent_id"] for r in rows] == list(range(len(want)))


@pytest.mark.parametrize("end,blank", [("\n", ""), ("\r\n", ""), ("\r\n", " \t"), ("\r", "  ")])
@pytest.mark.parametrize("size", [40, 700])
def test_file_split_over_tasks(spark, tmp_path, end, blank, size):
    """Byte ranges of less than a sentence and of many: the rows are those of the lines, whatever ends them."""
    rng = random.Random(4)
    text = "".join("".join(f"w{rng.randint(0, 99)}\tO\n" for _ in range(rng.choice([0, 1, 3, 9, 20]))) + "\n" for _ in range(60))
    path = put(tmp_path, text.replace("\n\n", f"\n{blank}\n").replace("\n", end))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        df = tagged.read_tagged(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() >= 3
        rows = df.orderBy("sent_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [list(zip(r["tokens"], r["tags"])) for r in rows] == by_lines(text)[0]
    assert [r["sent_id"] for r in rows] == list(range(len(rows)))


def test_several_files_in_one_task(spark, tmp_path):
    texts = {"a.txt": "a\tX\n\nb\tO", "b.txt": "\nc\tY\n", "c.txt": "d\tO\n\n"}
    for name, text in texts.items():
        put(tmp_path, text, name)
    rows = tagged.read_tagged(spark, str(tmp_path)).orderBy("file", "sent_id").collect()
    got = {}
    for r in rows:
        got.setdefault(os.path.basename(r["file"]), []).append(list(zip(r["tokens"], r["tags"])))
    assert got == {n: done + ([open_] if open_ else []) for n, (done, open_) in ((n, by_lines(t)) for n, t in texts.items())}


def test_bad_lines_raise(spark, tmp_path):
    with pytest.raises(PySparkException, match="not word<TAB>tag"):
        tagged.read_tagged(spark, put(tmp_path, "a\tX\tY\n\n")).collect()
    path = put(tmp_path, "a dummy X Y\nb X\n\nc B C\n")
    with pytest.raises(PySparkException, match="too few columns"):
        tagged.read_predictions(spark, path).collect()
    rows = tagged.read_predictions(spark, path, reject=True).orderBy("sent_id").collect()
    assert [(r["gold"], r["pred"], r["rejected"]) for r in rows] == [(["X"], ["Y"], 1), (["B"], ["C"], 0)]


def test_prediction_text_checks_lengths(spark):
    df = spark.createDataFrame([(["a"], ["O"], ["O", "O"])], "t array<string>, g array<string>, p array<string>")
    with pytest.raises(PySparkException, match="label is missing"):
        df.select(tagged.prediction_text(F.col("t"), F.col("g"), F.col("p"))).collect()


def test_text_file_extensions(spark, tmp_path):
    assert corpora.read_text_file(spark, put(tmp_path, "x\ny\n")).columns == ["text"]
    assert corpora.read_text_file(spark, put(tmp_path, "text\nx\n", "a.csv")).first()["text"] == "x"
    assert corpora.read_text_file(spark, put(tmp_path, json.dumps({"text": "x"}), "a.json")).first()["text"] == "x"
    with pytest.raises(ValueError, match="csv, a json or a txt"):
        corpora.read_text_file(spark, "a.parquet")


def test_missing_shards_raise(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        corpora.read_shards(spark, f"{tmp_path}/data-*.parquet")


def test_write_once_and_read_processed(spark, tmp_path):
    path = os.path.join(str(tmp_path), "tok")
    rows = [(i, ["O", "B-X", "I-X"], "train" if i < 8 else "test") for i in range(10)]
    df = spark.createDataFrame(rows, "sent_id bigint, tags array<string>, split string")
    corpora.write_once(df, path)
    corpora.write_once(df.limit(1), path)
    assert corpora.read_processed(spark, path, "train").count() == 8
    few = corpora.read_processed(spark, path, "train", k=3)
    assert sorted(r["sent_id"] for r in few.collect()) == [0, 1, 2]


def test_rendered_rows(spark):
    df = spark.createDataFrame([(["Ada", "of", "NYC", "x"], ["B-PER", "O", "B-LOC", "I-LOC"],
                                 ["B-PER", "O", "O", "I-LOC"])],
                               "tokens array<string>, gold array<string>, pred array<string>")
    row = render.annotation_rows(df, "tokens", "gold").first()
    assert row["token_row"] == "|Ada  |of|NYC   x    |" and row["tag_row"] == "|B-PER|  |B-LOC I-LOC|"
    row = render.prediction_rows(df).first()
    assert row["token_row"] == "|Ada  |of|NYC  |x    |"
    assert row["pred_row"] == "|B-PER|  |     |I-LOC|" and row["gold_row"] == "|B-PER|  |B-LOC|I-LOC|"
    text = spark.range(1).select(render.annotation_text(F.lit(1), F.lit("|a|"), F.lit("|b|"))).first()[0]
    assert text == "Line 1\n|a|\n|b|"


def test_nested_log_is_read(spark):
    log = {"Epoch 0": {"train_log": {"loss": 1.5}, "valid_log": {"loss": 2.0, "cls_report": {
        "B-X": {"precision": 0.5, "support": 3}, "accuracy": 0.75}, "span-f1": 40.0}, "end_time": "2024-01-01T00:00:00"},
        "Epoch 10": {"train_log": {"loss": 1.0}, "end_time": "2024-01-02T00:00:00"}}
    df = spark.createDataFrame([("r", json.dumps(log, indent=4))], "run_id string, log string")
    rows = {(r["epoch"], r["phase"], r["metric"]): (r["value"], r["end_time"]) for r in runlog.read_log(df).collect()}
    assert rows[(0, "valid", "cls_report.B-X.precision")] == (0.5, "2024-01-01T00:00:00")
    assert rows[(0, "valid", "cls_report.accuracy")][0] == 0.75 and rows[(0, "valid", "span-f1")][0] == 40.0
    assert rows[(10, "train", "loss")] == (1.0, "2024-01-02T00:00:00") and len(rows) == 7


AWKWARD = {"Epoch 0": {"valid_log": {"a.b": {"c\\\\d": {'e"f{': {"g": {"h": {"deep": 1}}}}}, "": 2.5, "list": [1, {"x": 2}], "none": None, "text": "a{b", "ok": True, "empty": {}}},
           "Epoch 12": {"train_log": {"loss": 1e-30, "n": 12345678901}, "end_time": "2024-01-02T00:00:00"}}


def test_any_log_is_written_as_it_was_read(spark):
    df = spark.createDataFrame([("r", json.dumps(AWKWARD)), ("s", json.dumps({"Epoch 1": {"test_log": {"x": 0.5}}})), ("t", None), ("u", "{}")], "run_id string, log string")
    rows = runlog.read_log(df)
    assert {r["run_id"]: json.loads(r["log"]) for r in runlog.write_log(rows).collect()} == {"r": AWKWARD, "s": {"Epoch 1": {"test_log": {"x": 0.5}}}}
    got = {(r["epoch"], r["metric"]): r["value"] for r in rows.where("run_id = 'r'").collect()}
    assert got[0, 'a\\.b.c\\\\\\\\d.e"f{.g.h.deep'] == 1.0 and got[0, "\\e"] == 2.5 and got[0, "text"] is None and got[12, "n"] == 12345678901.0


def test_any_object_is_its_leaves(spark):
    texts = [json.dumps(AWKWARD), '{"a":{"b":{}}}', "{}", '{"x":[{"y":{"z":1}}]}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, j string")
    found = {r["id"]: json.loads(r["j"]) for r in runlog.nest(runlog.leaves(df, ["id"], "j"), ["id"], "j").collect()}
    assert found == {i: json.loads(t) for i, t in enumerate(texts)}


def test_resumed_runs_go_on(spark):
    rows = [(u, e, float((e * 7 + u * 3) % 11) - (5 if u == 2 else 0)) for u in range(4) for e in range(12)]
    df = spark.createDataFrame(rows, "run_id int, at int, score double")
    whole = {(r["run_id"], r["at"]): r["improved"] for r in metrics.improvements(df, "score", ["at"]).collect()}
    cut = {0: 5, 1: 1, 2: 9}
    part = lambda u: F.coalesce(F.create_map(*[F.lit(x) for p in cut.items() for x in p])[u], F.lit(0))
    logged = df.where(F.col("at") < part(F.col("run_id"))).select("run_id", F.col("at").alias("epoch"), F.lit("valid").alias("phase"), F.lit("f1").alias("metric"), F.col("score").alias("value"))
    points = runlog.resume_points(runlog.read_log(runlog.write_log(logged)), "valid", "f1")
    got = metrics.resumed(df.where(F.col("at") >= part(F.col("run_id"))), points, "score", ["at"], bits=1).collect()
    assert len(got) == 48 - sum(cut.values())
    assert all(r["epoch"] == r["at"] and r["improved"] == whole[r["run_id"], r["at"]] for r in got)


def test_log_is_json(spark):
    rows = [("r", e, "valid", m, v) for e in (0, 1) for m, v in (("loss", 0.5), ("score", 2.0))]
    df = spark.createDataFrame(rows, "run_id string, epoch int, phase string, metric string, value double")
    text = runlog.write_log(df).first()["log"]
    assert json.loads(text) == {f"Epoch {e}": {"valid_log": {"loss": 0.5, "score": 2.0}} for e in (0, 1)}


def _counted(spark, df):
    """The rows, and how many were made."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), made


def test_logs_are_worked_out_once(spark):
    df = spark.createDataFrame([("r", e, "valid", "a.b", float(e)) for e in range(5)], "run_id string, epoch int, phase string, metric string, value double")
    rows, made = _counted(spark, df)
    log = runlog.write_log(rows)
    assert log.count() == 1 and made.value == 5
    logs, made = _counted(spark, log)
    assert runlog.read_log(logs).count() == 5 and made.value == 1


def test_ranged_sentences_are_written_in_order_and_made_once(spark, tmp_path):
    df = spark.createDataFrame([(d, s, f"w{d}-{s}", "O") for d in range(9, -1, -1) for s in (1, 0)], "doc_id int, sent int, w string, t string")
    rows, made = _counted(spark, df.select("doc_id", "sent", F.array("w").alias("tokens"), F.array("t").alias("tags")).repartitionByRange(3, "doc_id"))
    tagged.write_sentences(rows, tagged.tagged_text(F.col("tokens"), F.col("tags")), f"{tmp_path}/out", ["doc_id", "sent"], ranged=True)
    assert made.value == 20
    back = tagged.read_tagged(spark, f"{tmp_path}/out").orderBy("file", "sent_id").collect()
    assert [r["tokens"] for r in back] == [[f"w{d}-{s}"] for d in range(10) for s in (0, 1)]


@pytest.mark.parametrize("size", [700, 1 << 20])
def test_sentences_are_numbered_without_a_shuffle_of_them(spark, tmp_path, size):
    lines = [["a\tO", "b\u00a0\tB-X"], [], ["c\tO"] * 400, [], [], *([f"d{i}-{k}\tO" for i in range(5)] for k in range(40))]
    (tmp_path / "x.txt").write_bytes("\r\n".join(w for s in lines for w in [*s, " \u2003"]).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        frame = tagged.read_tagged(spark, str(tmp_path / "x.txt"))
        got = {r["sent_id"]: list(zip(r["tokens"], r["tags"])) for r in frame.collect()}
        shuffled = [x for x in frame._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in x and "sent_id" in x]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i: [tuple(w.split("\t")) for w in s] for i, s in enumerate(lines)} and not shuffled


def test_lines_are_cut_once_where_they_are_read(spark, tmp_path):
    """What reads the sentences again, for their number or their order, parses no line again."""
    path = put(tmp_path, "a\tX\nb\tO\n\n\nc\u0001 d\tY\n\ne\tbad\tline")
    frame = tagged.read_tagged(spark, path, strict_tail=True)
    assert "MapInArrow" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r)[1:] for r in frame.orderBy("sent_id").collect()] == [(0, ["a", "b"], ["X", "O"]), (1, [], []), (2, ["c\u0001 d"], ["Y"])]
    joined = tagged.read_tagged(spark, path, strict_tail=True, joined=" ").orderBy("sent_id").collect()
    assert [tuple(r)[1:] for r in joined] == [(0, "a b", "X O"), (1, "", ""), (2, "c\u0001 d", "Y")]
    with pytest.raises(PySparkException, match="not word<TAB>tag: e\tbad\tline"):  # the tail that is kept
        tagged.read_tagged(spark, path).count()
    path = put(tmp_path, "only two\n\na b C D\nx y\nz y X Y\n\nlast one", "p.txt")
    rows = tagged.read_predictions(spark, path, reject=True).orderBy("sent_id").collect()
    assert [tuple(r)[1:] for r in rows] == [(0, [], [], 1), (1, ["C", "X"], ["D", "Y"], 1), (2, [], [], 1)]


def test_lines_of_unequal_and_null_lists(spark):
    rows = [(["a", "b"], ["X"]), (["a", None], ["X", "Y"]), ([], []), (None, ["X"]), (["a"], ["X", "Y", None]), ([None], [None])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t array<string>, g array<string>").coalesce(1)
    got = [r["x"] for r in df.select("i", tagged.tagged_text(F.col("t"), F.col("g")).alias("x")).orderBy("i").collect()]
    assert got == ["a\tX\nb", "a\tX\nY", "", None, "a\tX\nY\n", ""]
