import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexiloom.operators import packing


def documents(seed, n=90, longest=30, step=1):
    rng = random.Random(seed)
    return [(i * step, [f"{i}_{j}" for j in range(rng.choice([0, 1, 3, longest]))]) for i in range(n)]


def cut(stream, length):
    return [stream[i:i + length] for i in range(0, len(stream) // length * length, length)]


@pytest.mark.parametrize("length", [1, 4, 7, 50])
@pytest.mark.parametrize("bits,step", [(1, 1), (3, 5), (12, 1)])
@pytest.mark.parametrize("reverse", [True, False])
def test_pack_stream(spark, length, bits, step, reverse):
    rows = documents(length + bits, step=step)
    df = spark.createDataFrame(rows, "row_id bigint, tokens array<string>")
    got = packing.pack_stream(df, length, bits=bits, reverse=reverse).orderBy("block_id").collect()
    stream = [t for _, doc in rows for t in (doc[::-1] if reverse else doc)]
    want = cut(stream, length)
    assert [r["tokens"] for r in got] == want
    assert [r["block_id"] for r in got] == list(range(len(want)))
    assert sum(len(r["tokens"]) for r in got) + len(stream) % length == len(stream)


def test_pack_stream_per_key(spark):
    rows = [(k, i, doc) for k in "ab" for i, doc in documents(ord(k))]
    df = spark.createDataFrame(rows, "split string, row_id bigint, tokens array<string>")
    got = packing.pack_stream(df, 5, keys=["split"], bits=2, reverse=False)
    for key in "ab":
        stream = [t for k, _, doc in rows if k == key for t in doc]
        mine = got.where(F.col("split") == key).orderBy("block_id").collect()
        assert [r["tokens"] for r in mine] == cut(stream, 5)


@pytest.mark.parametrize("rows_per_batch,length", [(1, 3), (7, 4), (1000, 4), (10, 10_000)])
def test_pack_batches_drops_each_remainder(spark, rows_per_batch, length):
    rows = documents(4, step=3)
    df = spark.createDataFrame(rows, "row_id bigint, tokens array<string>")
    got = packing.pack_batches(df, length, rows_per_batch=rows_per_batch).collect()
    want = {}
    for b in range(0, len(rows), rows_per_batch):
        stream = [t for _, doc in rows[b:b + rows_per_batch] for t in doc]
        want.update({(b // rows_per_batch, i): x for i, x in enumerate(cut(stream, length))})
    assert {(r["batch_id"], r["block_id"]): r["tokens"] for r in got} == want


@pytest.mark.parametrize("shards", [1, 4, 7])
def test_batches_do_not_cross_shards(spark, shards):
    rows = documents(6, n=45)
    df = spark.createDataFrame(rows, "row_id bigint, tokens array<string>")
    got = packing.pack_batches(df, 4, rows_per_batch=10, shards=shards, rows=45).collect()
    small, larger = divmod(45, shards)
    want, begin = {}, 0
    for s in range(shards):
        part = rows[begin:begin + small + (s < larger)]
        begin += len(part)
        for b in range(0, len(part), 10):
            stream = [t for _, doc in part[b:b + 10] for t in doc]
            want.update({(s, b // 10, i): x for i, x in enumerate(cut(stream, 4))})
    assert {(r["shard"], r["batch_id"], r["block_id"]): r["tokens"] for r in got} == want


def test_reverse_blocks_masks(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 1, 1], [0, 0, 1])],
                               "input_ids array<int>, attention_mask array<int>, special_tokens_mask array<int>")
    masks = ["attention_mask", "special_tokens_mask"]
    plain = packing.reverse_blocks(df, masks=masks).first()
    assert plain["input_ids"] == plain["labels"] == [3, 2, 1] and plain["special_tokens_mask"] == [0, 0, 1]
    aligned = packing.reverse_blocks(df, masks=masks, reverse_masks=True).first()
    assert aligned["special_tokens_mask"] == [1, 0, 0]


def test_stack_batches_checks_lengths(spark):
    rows = [(i, [i] * 3) for i in range(7)]
    df = spark.createDataFrame(rows, "id bigint, input_ids array<int>")
    got = packing.stack_batches(df, 3, 3, ["id"]).orderBy("batch_id").collect()
    assert [len(r["input_ids"]) for r in got] == [3, 3, 1]
    assert got[1]["input_ids"] == [[3] * 3, [4] * 3, [5] * 3]
    bad = spark.createDataFrame(rows + [(7, [1])], "id bigint, input_ids array<int>")
    assert packing.wrong_lengths(bad, 3).count() == 1
    with pytest.raises(PySparkException, match="length 1, not 3"):
        packing.stack_batches(bad, 3, 3, ["id"]).collect()
