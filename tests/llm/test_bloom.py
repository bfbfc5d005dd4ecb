from pyspark.sql import functions as F

from lexiloom.llm import bloom


def test_every_key_passes_and_few_others(spark):
    keys = spark.range(0, 20_000, 2).withColumn("id", F.when(F.col("id") != 4, F.xxhash64("id")))
    maybe = bloom.maybe_in(keys, "id")
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("key")).where("id <> 4").withColumn("m", maybe(F.col("key")))
    got = {(r["even"], r["m"]): r["n"] for r in rows.groupBy((F.col("id") % 2 == 0).alias("even"), "m").agg(F.count("*").alias("n")).collect()}
    assert got[True, True] == 9_999 and (True, False) not in got and got.get((False, True), 0) < 20
    assert not spark.range(1).select(maybe(F.lit(None).cast("long"))).first()[0]
    assert spark.range(5).where(bloom.maybe_in(keys.limit(0), "id")(F.col("id"))).count() == 0
