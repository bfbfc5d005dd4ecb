import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators.packing import pack_batches, reverse_blocks
from lexiloom.streaming import packing, text


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """Six files of lines, in order of their names and ids."""
    base = tmp_path_factory.mktemp("stream")
    rng, row, rows = random.Random(1), 0, []
    for f in range(6):
        part = []
        for _ in range(40):
            words = " ".join(f"w{row}_{j}" for j in range(rng.randint(0, 7)))
            part.append((row, words if rng.random() < 0.9 else rng.choice(["", "  ", " = H = "])))
            row += 1
        rows += part
        spark.createDataFrame(part, "row_id bigint, text string").coalesce(1).write.mode("append").parquet(str(base))
    return str(base), rows


def stream(spark, source):
    return text.read_stream(spark, source[0], "row_id bigint, text string", files_per_trigger=1)


def test_stream_tokens_equal_batch(spark, source):
    done = text.drain(text.clean_tokens(stream(spark, source), ["row_id"]), "t")
    batch = text.clean_tokens(spark.read.parquet(source[0]), ["row_id"])
    assert sorted(map(tuple, ((r["row_id"], tuple(r["tokens"])) for r in done.collect()))) == sorted(
        (r["row_id"], tuple(r["tokens"])) for r in batch.collect())


def carried(spark, source, tmp_path, words, keys, **options):
    out = str(tmp_path / "carried")
    packing.pack_carry(words, 8, out, str(tmp_path / "log"), keys, **options).awaitTermination()
    return out


@pytest.mark.parametrize("ids", [1000, 90])
def test_remainders_are_carried_over_micro_batches(spark, source, tmp_path, ids):
    words = stream(spark, source).select("row_id", F.filter(F.split("text", " "), lambda w: w != "").alias("tokens"))
    out = carried(spark, source, tmp_path, packing.with_shard(words, "row_id", ids), ["shard"], bits=3)
    got = packing.blocks(spark, out).collect()
    assert len({r["micro_batch"] for r in got}) == 6
    rest = {r["shard"]: (r["block_id"], r["tokens"]) for r in packing.rests(spark, out, ["shard"]).collect()}
    for s in range(239 // ids + 1):
        flat = [w for i, line in source[1] if i // ids == s for w in line.split(" ") if w]
        full = len(flat) // 8
        assert {r["block_id"]: r["tokens"] for r in got if r["shard"] == s} == {i: flat[8 * i:8 * i + 8][::-1] for i in range(full)}
        assert rest[s] == (full, flat[8 * full:])


def test_state_is_one_short_row_per_key_and_a_repeated_batch_changes_nothing(spark, source, tmp_path):
    words = stream(spark, source).select(F.lit("all").alias("key"), "row_id", F.filter(F.split("text", " "), lambda w: w != "").alias("tokens"))
    out = carried(spark, source, tmp_path, words, ["key"])
    for n in range(6):
        state = spark.read.parquet(f"{out}/state/{n}").collect()
        assert len(state) == 1 and len(state[0]["tokens"]) < 8
    want = sorted(map(str, packing.blocks(spark, out).collect()))
    log = tmp_path / "log" / "commits" / "5"  # as if the last micro-batch had not been confirmed
    log.unlink()
    (tmp_path / "log" / "commits" / ".5.crc").unlink(missing_ok=True)
    packing.pack_carry(words, 8, out, str(tmp_path / "log"), ["key"]).awaitTermination()
    assert sorted(map(str, packing.blocks(spark, out).collect())) == want


def test_a_key_that_rests_keeps_its_remainder(spark, tmp_path):
    source = str(tmp_path / "in")
    for part in ([("a", 0, "x y z"), ("b", 1, "p q r s")], [("b", 2, "t u")], [("a", 3, "w v u")], [("c", 4, "")]):
        spark.createDataFrame(part, "key string, row_id bigint, text string").coalesce(1).write.mode("append").parquet(source)
    words = text.read_stream(spark, source, "key string, row_id bigint, text string", files_per_trigger=1).select(
        "key", "row_id", F.filter(F.split("text", " "), lambda w: w != "").alias("tokens"))
    out = str(tmp_path / "out")
    packing.pack_carry(words, 4, out, str(tmp_path / "log"), ["key"], reverse=False).awaitTermination()
    assert sorted((r["key"], r["block_id"], r["tokens"]) for r in packing.blocks(spark, out).collect()) == [("a", 0, list("xyzw")), ("b", 0, list("pqrs"))]
    assert sorted((r["key"], r["block_id"], r["tokens"]) for r in packing.rests(spark, out, ["key"]).collect()) == [("a", 1, ["v", "u"]), ("b", 1, ["t", "u"])]


def test_drop_packing_equals_the_batch_operator(spark, source, tmp_path):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    words = stream(spark, source).select("row_id", F.split("text", " ").alias("tokens"))
    packing.pack_drop(words, 8, out, log, rows_per_batch=10).awaitTermination()
    got = spark.read.parquet(out)
    assert got.select("micro_batch").distinct().count() == 6
    batch = spark.read.parquet(source[0]).select("row_id", F.split("text", " ").alias("tokens"))
    want = reverse_blocks(pack_batches(batch, 8, rows_per_batch=10), "tokens")
    assert sorted(tuple(r["tokens"]) for r in got.collect()) == sorted(tuple(r["tokens"]) for r in want.collect())
