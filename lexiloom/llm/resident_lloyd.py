"""Vector code compression: product codes by member-resident Lloyd iterations.

A vector of integers is cut into equal parts; every part position has a codebook, whose entries start as that part of
the vectors of the smallest ids. The parts are the rows. They live in a bucketed table at the owner of their
(position, entry, salt): an owner adds up its resident members without an exchange, and the sums of an entry's salts
give its new value. Assigning again is a scan in place: parts that keep their entry stay in their owner's bucket, and
only those that change it go to an outbox and through the next shuffle. Codebooks (positions x entries x width numbers)
are all that the driver and every task hold; the salts cut an entry that owns most of the parts.

Every round's table stands in the shared folder, so that a lost executor costs a read of its buckets.

Cases: rows whose vector is null or holds a null or non-finite component are left out. Vectors whose length is not that
of the smallest id with a length that can be cut (empty ones, too) take no part: they stay with a null code and error.
Repeated ids are different rows; ties of ids are ordered by the vectors, a null id comes last. Fewer rows than entries
make a smaller codebook. Null labels count as one label. An empty table gives no row. A component of 2^27 or more after
scaling raises, as its squared distances would leave 64 bits. Other columns do not come along.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import lookup
from ..session import shared_dir, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: parts of a bucket, on average; and the buckets that Spark allows a table
BUCKET_ROWS, MOST_BUCKETS = 500_000, 100_000
LEAST_SALTS = 8
LIMIT = 1 << 27
#: rows compared with a codebook at once: 16 MB of differences at 64 entries of four numbers
STRIDE = 8192
OWNER = ["pos", "entry", "salt"]

_MEMBER = "rid long, pos int, entry int, salt int, part array<long>"
_ARROW = [("rid", pa.int64()), ("pos", pa.int32()), ("entry", pa.int32()), ("salt", pa.int32()), ("part", pa.list_(pa.int64()))]


def integers(x: Column, scale: int = SCALE) -> Column:
    """Components times ``scale``, rounded down."""
    def whole(v: Column) -> Column:
        y = F.floor(v.cast("double") * F.lit(float(scale)))
        return F.when(F.abs(y) < LIMIT, y).otherwise(F.raise_error(F.lit(f"a component is {LIMIT} or more after scaling")).cast("long"))

    return F.transform(x, whole)


def sound(x: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``book`` (the lower on ties) and the squared distance, for every row of ``x``."""
    at, far = np.empty(len(x), np.int32), np.empty(len(x), np.int64)
    for a in range(0, len(x), STRIDE):
        d = ((x[a : a + STRIDE, None] - book[None]) ** 2).sum(2)
        at[a : a + STRIDE] = d.argmin(1)
        far[a : a + STRIDE] = d.min(1)
    return at, far


def _nearest_by_position(pos: np.ndarray, x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, far = np.empty(len(x), np.int32), np.empty(len(x), np.int64)
    for p in np.unique(pos).tolist():
        mine = pos == p
        at[mine], far[mine] = nearest(x[mine], books[p])
    return at, far


def _numbers(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(-1, width)


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(rows.reshape(-1), pa.int64()))


def _cut_task(shared, parts: int, salts: int):
    """Vectors to members: one row per part, at the owner of its nearest entry. The first part carries id and label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        width = books.shape[2]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _numbers(batch.column("x"), parts * width).reshape(n * parts, width)
            pos = np.tile(np.arange(parts, dtype=np.int32), n)
            rid = batch.column("rid").to_numpy()
            entry, _ = _nearest_by_position(pos, x, books)
            salt = (rid % salts).astype(np.int32)
            heads = pa.array(np.repeat(np.arange(n), parts), mask=pos > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(rid, parts)), pa.array(pos), pa.array(entry), pa.array(np.repeat(salt, parts)), _lists(x),
                 batch.column("head").take(heads)], names=[*[c for c, _ in _ARROW], "head"])

    return run


def _assign_task(shared):
    """Members with the entry that is nearest now and the squared distance to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            if batch.num_rows:
                to, error = _nearest_by_position(batch.column("pos").to_numpy(), _numbers(batch.column("part"), books.shape[2]), books)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to), pa.array(error)], names=[*batch.schema.names, "to", "error"])

    return run


class _Members:
    """One round's parts in a bucketed table of the shared folder; the outbox beside it holds the parts that move on."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.path, self.name = shared_dir(spark, "members"), f"members_{uuid.uuid4().hex}"

    def _write(self, rows: DataFrame, mode: str) -> None:
        (rows.write.format("parquet").mode(mode).option("path", self.path).partitionBy("settled")
         .bucketBy(self.buckets, *OWNER).saveAsTable(self.name))

    def settle(self, rows: DataFrame, mode: str = "overwrite") -> None:
        """Send rows to their owners."""
        self._write(rows.withColumn("settled", F.lit(True)).repartition(self.buckets, *OWNER), mode)

    def stay_or_leave(self, rows: DataFrame) -> None:
        """Rows with ``to``: those at their entry are written in place, the others through the outbox to their new owner."""
        self._write(rows.withColumn("settled", F.col("to") == F.col("entry")).drop("error"), "overwrite")
        left = self.spark.read.schema(rows.drop("error").schema).parquet(f"{self.path}/settled=false") if self._has_outbox() else None
        if left is not None:
            self.settle(left.withColumn("entry", F.col("to")), "append")

    def _has_outbox(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/settled=false")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).where("settled").drop("settled", "to")

    def drop(self) -> None:
        """Forget the table; its files stay until the application's folder goes."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def owner_sums(members: DataFrame, width: int) -> DataFrame:
    """(pos, entry, n, s0, s1, ...): every owner adds up its members, then an entry's salts are added up."""
    sums = [F.sum(F.element_at("part", j + 1)).alias(f"s{j}") for j in range(width)]
    owners = members.groupBy(*OWNER).agg(F.count("*").alias("n"), *sums)
    return owners.groupBy("pos", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(width)])


def _updated(books: np.ndarray, members: DataFrame) -> np.ndarray:
    """Codebooks of the members' means, rounded down; entries without members stay. At most positions x entries rows arrive."""
    books = books.copy()
    width = books.shape[2]
    for r in owner_sums(members, width).collect():
        books[r["pos"], r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
    return books


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", *, parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256), one row per vector that is kept.

    ``code`` has two hex digits per part; ``error`` is the squared distance to the coded vector, ``label_error`` its sum
    over the label.
    """
    if not 1 <= entries <= 256 or parts < 1 or rounds < 1:
        raise ValueError("1 to 256 entries, at least one part and one round")
    spark = vectors.sparkSession
    kept = vectors.where(sound(F.col(vector))).select(
        F.struct(F.col(id).alias("id"), F.col(label).alias("label")).alias("head"), F.when(sound(F.col(vector)), integers(F.col(vector), scale)).alias("x"))
    order = [F.col("head.id").asc_nulls_last(), F.col("x")]
    cuttable = kept.where((F.size("x") > 0) & (F.size("x") % parts == 0))
    first = cuttable.orderBy(*order).select(F.size("x").alias("n")).head()
    length = first["n"] if first else parts
    fits = F.size("x") == length
    seeds = [r["x"] for r in kept.where(fits).orderBy(*order).limit(entries).collect()]
    books = np.array(seeds, np.int64).reshape(len(seeds), parts, length // parts).transpose(1, 0, 2)
    n = kept.where(fits).count()
    buckets = min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, math.ceil(n * parts / BUCKET_ROWS)))
    salts = max(LEAST_SALTS, math.ceil(buckets / 4))
    head = f"head struct<id:{kept.schema['head'].dataType['id'].dataType.simpleString()},label:{kept.schema['head'].dataType['label'].dataType.simpleString()}>"

    def share(value):
        return spark.sparkContext.broadcast(value)  # parts x entries x width numbers

    tables = [_Members(spark, buckets)]
    try:
        numbered = kept.where(fits).select(F.monotonically_increasing_id().alias("rid"), "head", "x")
        tables[-1].settle(numbered.mapInArrow(_cut_task(share(books), parts, salts), f"{_MEMBER}, {head}"))
        books = _updated(books, tables[-1].rows())
        for _ in range(rounds - 1):
            found = tables[-1].rows().mapInArrow(_assign_task(share(books)), f"{_MEMBER}, {head}, to int, error long")
            tables.append(_Members(spark, buckets))
            tables[-1].stay_or_leave(found)
            books = _updated(books, tables[-1].rows())
        last = tables[-1].rows().mapInArrow(_assign_task(share(books)), f"{_MEMBER}, {head}, to int, error long")
        codes = last.groupBy("rid").agg(F.max("head").alias("head"), F.sum("error").alias("error"),
                                        F.sort_array(F.collect_list(F.struct("pos", "to"))).alias("__c"))
        code = F.array_join(F.transform("__c", lambda c: F.lpad(F.lower(F.hex(c["to"])), 2, "0")), "")
        whole = codes.select("head.id", "head.label", code.alias("code"), "error")
        odd = kept.where(~fits).select("head.id", "head.label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        result = stored(whole.unionByName(odd), "codes")
    finally:
        for table in tables:
            table.drop()
    keyed = result.withColumns({"__none": F.col("label").isNull(), "__text": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    totals = keyed.groupBy("__none", "__text").agg(F.sum("error").alias("label_error"), F.count("*").alias("__n"))
    joined = lookup(keyed, totals, ["__none", "__text"], "__n", spread=["id", "code"], how="left")
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return joined.select(F.col("id").alias(id), F.col("label").alias(label), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
