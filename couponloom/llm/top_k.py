"""Exact top-k inner products by columnar branch and bound.

Vectors lie in vertical layout, one row per dimension, dimensions of most query mass first.
Scores are accumulated dimension block by dimension block. After each block a candidate can
gain at most the product of the remaining masses (norms) of query and candidate; those that
cannot reach the query's k-th best score any more are left out, and the survivors are
compacted: first whole candidates, then single pairs. The k-th best score starts from the
queries of the block themselves, which are candidates of each other: a job of its own finds it once
for all tasks, and every task prunes from its first row on.

Queries are worked off in blocks of `QUERY_ROWS`, each sent to all tasks, against all
candidates: nothing is shuffled but the few best of each task.

Contract of `top_k`: vectors that are null or hold null or non-finite components take no
part, nor do rows with a null id; shorter vectors count as filled up with zeros. Rows that
carry the query's id are its own and no candidates of it; otherwise every row is a candidate,
repeated ones too. A query id with several vectors asks with the smallest. Fewer than k
candidates: all. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from couponloom.workspace import private_folder

#: Queries sent to all tasks at once: with 64 dimensions 4 MB.
QUERY_ROWS = 8192
#: Dimensions accumulated between two looks at the bounds.
DIMENSIONS = 16
_QUERIES_AT_ONCE = 128
#: Below this share of live pairs they are followed one by one.
_SPARSE = 0.1
_BEST = "query_id long, vec_id long, score long"


def _arithmetic(*parts: np.ndarray) -> type:
    """The fastest type in which all sums of products are exact."""
    top = max((float(np.abs(p).max()) for p in parts if p.size), default=0.0)
    bound = top * top * max(p.shape[1] for p in parts)
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


def _rest(vectors: np.ndarray) -> np.ndarray:
    """Norm of the dimensions from each block on, rounded up: (blocks, rows)."""
    squares = np.square(vectors.astype(np.float64))
    starts = range(0, vectors.shape[1], DIMENSIONS)
    return np.array([np.sqrt(squares[:, s:].sum(axis=1)) * (1 + 1e-6) for s in starts] + [np.zeros(len(vectors))])


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), np.iinfo(np.int64).min)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)
        self.least = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge pairs; each query's row stays in order of score, then id."""
        touched = np.unique(query)
        if not len(touched):
            return
        q = np.concatenate([query, np.repeat(touched, self.k)])
        s = np.concatenate([score, self.scores[touched].ravel()])
        i = np.concatenate([ids, self.ids[touched].ravel()])
        order = np.lexsort((i, ~s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, touched)
        take = first[:, None] + np.arange(self.k)
        self.scores[touched], self.ids[touched] = s[take], i[take]
        last = self.scores[touched, -1]
        self.least[touched] = np.where(last == np.iinfo(np.int64).min, -np.inf, last)


class Search:
    """Queries of a block against batches of candidates."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, reached: np.ndarray | None = None):
        """reached: scores that each query's k best are known to reach."""
        self.ids, self.k = ids, k
        self.order = np.argsort(-np.square(vectors.astype(np.float64)).sum(axis=0), kind="stable")
        self.vectors = vectors[:, self.order]
        self.rest = _rest(self.vectors)
        self.reached = np.full(len(ids), -np.inf) if reached is None else reached

    def start(self) -> Best:
        """Nothing found yet, but scores that are known to be reached."""
        best = Best(len(self.ids), self.k)
        best.least = self.reached.copy()
        return best

    def scan(self, best: Best, ids: np.ndarray, vectors: np.ndarray) -> None:
        width = self.vectors.shape[1]
        if vectors.shape[1] < width:
            vectors = np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))
        self._scan(best, ids, vectors[:, :width][:, self.order])

    def _scan(self, best: Best, ids: np.ndarray, vectors: np.ndarray) -> None:
        kind = _arithmetic(self.vectors, vectors)
        columns = np.ascontiguousarray(vectors.T.astype(kind))
        rest = _rest(vectors)
        for at in range(0, len(self.ids), _QUERIES_AT_ONCE):
            rows = slice(at, min(at + _QUERIES_AT_ONCE, len(self.ids)))
            q, c, s = self._pairs(self.vectors[rows].astype(kind), self.rest[:, rows], best.least[rows], columns, rest)
            other = self.ids[rows][q] != ids[c]
            q, c, s = q[other] + at, c[other], s[other]
            best.add(q, s.astype(np.int64), ids[c])
            np.maximum(best.least, self.reached, out=best.least)

    def _pairs(self, queries, query_rest, least, columns, rest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score) of all pairs that reach the least score."""
        n = columns.shape[1]
        live = np.arange(n)
        score = np.zeros((len(queries), n), dtype=columns.dtype)
        block, blocks = 0, len(rest) - 1
        alive = np.ones(score.shape, dtype=bool)
        while block < blocks:
            part = slice(block * DIMENSIONS, (block + 1) * DIMENSIONS)
            score += queries[:, part] @ columns[part][:, live]
            block += 1
            gain = query_rest[block][:, None] * rest[block][live][None, :]
            alive = score + gain >= least[:, None]
            share = alive.mean() if alive.size else 0
            if share < _SPARSE:
                break
            keep = alive.any(axis=0)
            if not keep.all():
                live, score, alive = live[keep], score[:, keep], alive[:, keep]
        q, c = np.nonzero(alive)
        s, c = score[q, c], live[c]
        while block < blocks and len(q):
            part = slice(block * DIMENSIONS, (block + 1) * DIMENSIONS)
            s = s + np.einsum("ij,ji->i", queries[q, part], columns[part][:, c])
            block += 1
            keep = s + query_rest[block][q] * rest[block][c] >= least[q]
            q, c, s = q[keep], c[keep], s[keep]
        return q, c, s


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a batch, short vectors filled up with zeros."""
    lists = batch.column("vector")
    lengths = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    ids = batch.column("id").to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return ids, values.reshape(len(ids), width)
    out = np.zeros((len(ids), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return ids, out


def _best_of_task(batches: Iterator[pa.RecordBatch], queries: Broadcast, k: int) -> Iterator[pa.RecordBatch]:
    search = Search(*queries.value)
    best = search.start()
    for batch in batches:
        if batch.num_rows:
            search.scan(best, *_vectors(batch))
    q, rank = np.nonzero(best.scores != np.iinfo(np.int64).min)
    yield pa.RecordBatch.from_arrays(
        [pa.array(search.ids[q]), pa.array(best.ids[q, rank]), pa.array(best.scores[q, rank])],
        names=["query_id", "vec_id", "score"],
    )


def _usable(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, vector) of the rows that take part, components scaled and floored."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(key).cast("long").alias("id"),
        F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).alias("vector"),
    )


def _matrix(rows: list) -> tuple[np.ndarray, np.ndarray]:
    width = max(len(r["vector"]) for r in rows)
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r["vector"])] = r["vector"]
    return np.array([r["id"] for r in rows], dtype=np.int64), out


def _reached(part: DataFrame, found: np.ndarray, queries: Broadcast, k: int) -> np.ndarray:
    """The k-th best score of each query among the other queries; a row for each query at most."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    best = part.mapInArrow(partial(_best_of_task, queries=queries, k=k), _BEST)
    last = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    out = np.full(len(found), -np.inf)
    for row in last.collect():
        out[np.searchsorted(found, row["query_id"])] = row["score"]
    return out


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding",
    scale: int = 64, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query, ties to the smaller id."""
    spark = vectors.sparkSession
    rows = _usable(vectors, key, vector, scale)
    asked = _usable(vectors.where(is_query), key, vector, scale).groupBy("id").agg(F.min("vector").alias("vector"))
    blocks = max(1, math.ceil(asked.count() / query_rows))
    folder = private_folder(spark, "top-k")
    spark.createDataFrame([], _BEST).write.parquet(folder)
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block) if blocks > 1 else asked
        found = sorted(part.collect(), key=lambda r: r["id"])
        if not found:
            continue
        ids, matrix = _matrix(found)
        seeds = _reached(part.select("id", "vector"), ids, spark.sparkContext.broadcast((ids, matrix, k)), k)
        queries = spark.sparkContext.broadcast((ids, matrix, k, seeds))
        rows.mapInArrow(partial(_best_of_task, queries=queries, k=k), _BEST).write.mode("append").parquet(folder)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (
        spark.read.schema(_BEST).parquet(folder).withColumn("rank", rank).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op3_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty best inner products for every twentieth row of `embeddings`."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 20 == 0)
