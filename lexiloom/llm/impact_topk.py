"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors are integers. Candidates are cut into blocks. A block's index sorts its postings (candidate, dimension, value)
into segments by quantised impact, the number of bits of the value's size, largest first. Processing a segment adds
what its postings are worth to the accumulators of a run of queries. What a candidate can still gain or lose is bounded
by the norm of the query times the norm of the candidate's postings not yet processed, which the index keeps per
segment. A query stops only on proof: when so few candidates can still reach the k-th best lower bound that scoring
them exactly is the rest of the work. Every possible member is scored exactly; ties go to the smaller id.

Queries meet candidates block by block: query blocks are copied once per candidate block and joined on the block's
number, so a task sees one pair of blocks. Each pair returns at most k rows per query, and ranks are taken over those.

Cases: vectors that are null or hold a null or non-finite component take no part; vectors of another length than the
first one's raise; equal vectors are separate candidates (ties by id); fewer candidates than k give all; a null id takes
no part; an empty table gives no row. Rows that share an id are rows of their own: each is a candidate of the others, and
each that asks is a query with ranks of its own, so that its id has several rankings. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored

K = 20
SCALE = 64
CANDIDATES, QUERIES = 8192, 2048
#: queries processed together
RUN = 128


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, as integers; null if any component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class BlockIndex:
    """Postings of one block of candidates in segments of descending impact."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors.astype(np.float64)  # products and sums of such integers stay exact below 2^53
        size = np.abs(vectors)
        impact = np.frexp(size.astype(np.float64))[1]  # bits of the size; 0 for 0
        left = self.vectors**2
        self.segments: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # postings, values, norms left afterwards
        for level in np.unique(impact)[::-1].tolist():
            if level:
                at = np.flatnonzero(impact == level)
                left.ravel()[at] = 0
                self.segments.append((at, self.vectors.ravel()[at], np.sqrt(left.sum(axis=1))))

    def top(self, queries: np.ndarray, k: int, skip: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Positions and scores of each query's k best candidates without ``skip`` (-1: none), ties by position."""
        n = len(self.vectors)
        queries = queries.astype(np.float64)
        norm = np.sqrt((queries**2).sum(axis=1))
        found: list = [None] * len(queries)
        open_ = np.arange(len(queries))
        score = np.zeros((len(queries), n))
        own = np.flatnonzero(skip >= 0)
        for number, (at, values, left) in enumerate(self.segments):
            slab = np.zeros(self.vectors.size)
            slab[at] = values
            score[open_] += queries[open_] @ slab.reshape(self.vectors.shape).T
            if number == len(self.segments) - 1 or n <= k:
                continue
            slack = norm[open_][:, None] * left * (1 + 1e-12)
            low, high = score[open_] - slack, score[open_] + slack
            hidden = np.isin(open_, own)
            low[hidden, skip[open_[hidden]]] = -np.inf
            bound = np.partition(low, n - k, axis=1)[:, n - k]
            possible = high >= bound[:, None]
            few = possible.sum(axis=1) <= 4 * k
            for row in np.flatnonzero(few).tolist():
                q = int(open_[row])
                found[q] = self._exact(queries[q], np.flatnonzero(possible[row]), k, int(skip[q]))
            open_ = open_[~few]
            if not len(open_):
                break
        for q in open_.tolist():  # all segments processed: the accumulators are the scores
            if n > k + 1:
                bound = np.partition(score[q], n - k - 1)[n - k - 1]
                possible = np.flatnonzero(score[q] >= bound)
            else:
                possible = np.arange(n)
            found[q] = self._exact(queries[q], possible, k, int(skip[q]))
        return found

    def _exact(self, query: np.ndarray, possible: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        possible = possible[possible != skip]
        score = (self.vectors[possible] @ query).astype(np.int64)
        best = np.lexsort((possible, -score))[:k]
        return possible[best], score[best]


def _pair(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "row"], kind="stable")
        here, asked = pdf[~pdf["is_query"]], pdf[pdf["is_query"]]
        query, row, vec, score = ([np.zeros(0, np.int64)] for _ in range(4))
        if len(here) and len(asked):
            ids, asks, rows = here["id"].to_numpy(np.int64), asked["id"].to_numpy(np.int64), asked["row"].to_numpy(np.int64)
            place = pd.Series(np.arange(len(here)), here["row"].to_numpy(np.int64))
            index = BlockIndex(np.stack(here["vector"].to_numpy()).astype(np.int64))
            wanted = np.stack(asked["vector"].to_numpy()).astype(np.int64)
            skip = place.reindex(rows, fill_value=-1).to_numpy()
            for a in range(0, len(asks), RUN):
                for q, r, (found, points) in zip(asks[a : a + RUN], rows[a : a + RUN], index.top(wanted[a : a + RUN], k, skip[a : a + RUN]), strict=True):
                    query.append(np.full(len(found), q))
                    row.append(np.full(len(found), r))
                    vec.append(ids[found])
                    score.append(points)
        return pd.DataFrame({"query_id": np.concatenate(query), "row": np.concatenate(row), "vec_id": np.concatenate(vec), "score": np.concatenate(score)})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for every query row its k best other rows. ``vectors``: id, vector (array<long>)."""
    clean = stored(vectors.where(F.col("id").isNotNull() & F.col("vector").isNotNull())
                   .select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), "vector", is_query.alias("asks")), "vectors")
    n, n_queries = clean.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    c_blocks, q_blocks = max(1, -(-n // candidates)), max(1, -(-n_queries // queries))
    def block(n_blocks: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")

    def every(n_blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))

    here = clean.select("row", "id", "vector", F.lit(False).alias("is_query"), block(c_blocks).alias("c"), every(q_blocks).alias("q"))
    asked = clean.where("asks").select("row", "id", "vector", F.lit(True).alias("is_query"), every(c_blocks).alias("c"), block(q_blocks).alias("q"))
    sides = here.unionAll(asked)
    found = sides.groupBy("c", "q").applyInPandas(_pair(k), "query_id long, row long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
