"""Approximate nearest neighbours by permutation index.

A vector is represented by its nearest pivots in order. Blocks of vectors hold
an inverted file, pivot to (vector, rank); a query's pivots accumulate footrule
distances over their postings, the closest part is reranked by exact cosine.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read, sampled, stored

PIVOTS, POSTED = 256, 96
#: Share of a block's vectors reranked for a query; besides, all within NEAR of the largest footrule distance.
RERANKED, NEAR = 0.25, 0.35
BLOCK, CHUNK = 8192, 16384  # vectors of a block, queries of a chunk


def nearest_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The POSTED nearest pivots of each row in order, ties to the lower number."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, : min(POSTED, len(pivots))]


class Index:
    """Inverted file of a block of vectors: for each pivot a row of how near its rank is to each vector, POSTED for the first and 0 where it isn't posted."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray):
        self.pivots, self.n = pivots, len(vectors)
        unit = _unit(vectors)
        order = nearest_pivots(unit, pivots)
        self.near = np.arange(order.shape[1], 0, -1).astype(np.uint8 if order.shape[1] < 256 else np.uint16)
        self.posts = np.zeros((len(pivots), self.n), self.near.dtype)
        self.posts[order.T, np.arange(self.n)] = self.near[:, None]
        self.unit = unit.astype(np.float32)

    def candidates(self, pivots_of_query: np.ndarray) -> np.ndarray:
        """Vectors to rerank: those at the smallest footrule distances.

        With m for the rank of pivots that aren't posted, the footrule distance is
        2 * (most - common), where common sums the lesser nearness of each pivot.
        """
        m = len(self.near)
        most = m * (m + 1) // 2
        common = np.minimum(self.posts[pivots_of_query], self.near[:, None]).sum(0, dtype=np.int32)
        keep = max(64, int(RERANKED * self.n))
        if keep >= self.n:
            return np.arange(self.n)
        limit = np.partition(common, self.n - 1 - keep)[self.n - 1 - keep]
        return np.flatnonzero(common >= min(limit, (1 - NEAR) * most))

    def leaders(self, c: np.ndarray, query: np.ndarray, k: int) -> np.ndarray:
        """Those of c that may be among its k nearest: single precision is surer than the margin left."""
        if len(c) <= k:
            return c
        s = self.unit[c] @ query
        return c[s >= np.partition(s, len(c) - k)[len(c) - k] - (len(query) + 8) * 2.0**-22]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow of squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cosine(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        out = (v @ q) / (np.sqrt((v * v).sum(1)) * np.sqrt((q * q).sum()))
    return out if np.isfinite(out).all() else _unit(v) @ _unit(q[None])[0]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, by cosine.

    vectors and queries: vec_id, embedding (array of numbers). A query's own
    vec_id is no candidate; ties go to the smaller vec_id. Vectors that are
    null, empty, zero or hold null or non-finite components, and rows without an
    id, take no part; vectors meet only those of their own length. Repeated rows
    count once. Equal vectors are indexed once with their k + 1 smallest ids,
    which loses nothing. A query with fewer candidates returns all of them. Other
    columns are ignored.
    """
    v, q = _valid(vectors), _valid(queries)
    first = Window.partitionBy("e").orderBy("vec_id")
    v = v.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k + 1)
    v = stored(v.groupBy("e").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    q = stored(q)
    blocks, chunks = v.count() // BLOCK + 1, q.count() // CHUNK + 1
    pivots: dict[int, np.ndarray] = {}
    for r in v.select(F.size("e").alias("d")).distinct().collect():
        own = v.where(F.size("e") == r["d"]).select("e", F.col("ids")[0].alias("id"))
        pivots[r["d"]] = _unit(np.array([x["e"] for x in sampled(own, "id", PIVOTS, "pivots").collect()]))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    by = ["d", "block", "chunk"]
    v = v.select(F.size("e").alias("d"), F.pmod(F.xxhash64("e"), F.lit(blocks)).cast("int").alias("block"), spread(chunks).alias("chunk"), "e", "ids")
    q = q.select(F.size("e").alias("d"), spread(blocks).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int").alias("chunk"), F.col("vec_id").alias("query_id"), "e")

    def find(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(rows) and len(wanted):
            x = np.stack(rows["e"].to_list())
            low = np.array([i[0] for i in rows["ids"]], np.int64)
            at = np.argsort(low, kind="stable")
            x, low, ids = x[at], low[at], rows["ids"].to_numpy()[at]
            index = Index(x, pivots[x.shape[1]])
            asked = np.stack(wanted["e"].to_list())
            unit = _unit(asked)
            near, unit = nearest_pivots(unit, index.pivots), unit.astype(np.float32)
            for own, e, u, p in zip(wanted["query_id"].tolist(), asked, unit, near, strict=True):
                c = index.leaders(index.candidates(p), u, k + 1)
                s = _cosine(x[c], e)
                for i in np.argsort(-s, kind="stable")[: k + 1]:  # c is in order of the smallest id
                    out += [(own, int(j), float(s[i])) for j in ids[c[i]] if j != own]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = v.groupBy(*by).cogroup(q.groupBy(*by)).applyInPandas(find, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _valid(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).where("vec_id is not null and size(e) > 0")
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(finite & F.exists("e", lambda x: x != 0)).distinct()


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))
