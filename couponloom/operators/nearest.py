"""Exact nearest neighbours by cosine over blocks around centres.

Vectors are dealt to the nearest of some centres, large groups cut further, so a block holds
vectors of one direction. A block is known by its own centre and radius, the widest angle of a member.
No member of a block can be nearer to a vector than the vector's angle to the centre less the radius, so
a block is only asked for vectors whose n-th best inside their own block it could beat.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from couponloom.workspace import private_stage

# Vectors of a block, and of those that ask one block in one task.
BLOCK_ROWS = 2_048
ASKING_ROWS = 16_384
# Blocks are this much finer than their size asks for, up to so many centres.
FINER = 4
MOST_CENTRES = 4_096
DIGITS = 9
_TILE = 512
_SLACK = 1e-6
_FOUND = pa.schema([("product", pa.int32()), ("similar", pa.int32()), ("similarity", pa.float64())])


def _matrix(lists: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    whole = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    values = whole.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(whole), -1) if len(whole) else np.zeros((0, width or 0))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero row stays zero and has cosine 0 with all."""
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, lengths, out=np.zeros_like(vectors, dtype=np.float64), where=lengths > 0)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _lists(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, max(1, width)), pa.int32()), pa.array(rows.ravel()))


def _deal(batches: Iterator[pa.RecordBatch], centres: Broadcast) -> Iterator[pa.RecordBatch]:
    """Unit vectors with the nearest centre."""
    for batch in batches:
        if batch.num_rows:
            vectors = _unit(_matrix(batch.column(1)))
            near = (vectors @ centres.value.T).argmax(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(vectors), pa.array(near)], names=["product", "vector", "centre"])


def _best(one: np.ndarray, x: np.ndarray, two: np.ndarray, y: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row of x, place in y, cosine) of each row's n best, ties to the smaller id; some rows at a time."""
    for at in range(0, len(x), _TILE):
        near = np.round(x[at : at + _TILE] @ y.T, DIGITS)
        near[one[at : at + _TILE, None] == two[None, :]] = -np.inf
        least = -np.partition(-near, min(n, len(two)) - 1, axis=1)[:, min(n, len(two)) - 1]
        row, place = np.nonzero((near >= least[:, None]) & np.isfinite(near))
        value = near[row, place]
        order = np.lexsort((two[place], -value, row))
        row, place, value = row[order], place[order], value[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < n
        yield row[keep] + at, place[keep], value[keep]


def _inside(table: pa.Table, n: int) -> pa.Table:
    """A block's members with their n-th best cosine inside it; the first one carries centre and radius."""
    table = table.sort_by("product")
    ids, x = table.column("product").to_numpy(), _matrix(table.column("vector"))
    centre = _unit(x.mean(axis=0, keepdims=True))[0]
    centre = centre if centre.any() else x[0]
    radius = float(_angle(x @ centre).max())
    least = np.full(len(ids), -2.0)
    for row, _, value in _best(ids, x, ids, x, n):
        place, counts = np.unique(row, return_counts=True)
        last = np.cumsum(counts) - 1
        full = counts == n
        least[place[full]] = value[last[full]]
    first = np.arange(len(ids)) == 0
    return pa.table({
        "block": table.column("block"), "product": table.column("product"), "vector": table.column("vector"),
        "least": pa.array(least), "centre": pa.array([centre.tolist() if f else None for f in first], pa.list_(pa.float64())),
        "radius": pa.array(np.where(first, radius, 0.0)),
    })


def _asked(batches: Iterator[pa.RecordBatch], blocks: Broadcast, n: int) -> Iterator[pa.RecordBatch]:
    """Vectors with the blocks that may hold one of their n nearest."""
    numbers, centres, radii, sizes = blocks.value
    for batch in batches:
        if batch.num_rows:
            angle = _angle(_matrix(batch.column("vector")) @ centres.T)
            least = batch.column("least").to_numpy().copy()
            alone = np.flatnonzero(least < -1)
            # Members of the blocks that are near as a whole, itself among them, bound those of a small block.
            far = np.clip(angle[alone] + radii + _SLACK, 0.0, math.pi)
            order = np.argsort(far, axis=1)
            enough = np.cumsum(sizes[order], axis=1) > n
            place = np.take_along_axis(order, enough.argmax(axis=1)[:, None], axis=1)
            bound = np.cos(np.take_along_axis(far, place, axis=1)[:, 0]) - _SLACK
            least[alone] = np.where(enough.any(axis=1), bound, least[alone])
            reach = np.cos(np.clip(angle - radii - _SLACK, 0.0, math.pi)) + _SLACK
            row, at = np.nonzero(reach >= least[:, None])
            block = numbers[at]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(block, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("product"), batch.column("vector"), lists], names=["product", "vector", "blocks"])


def _compare(asking: pa.Table, block: pa.Table, n: int) -> pa.Table:
    if not asking.num_rows or not block.num_rows:
        return _FOUND.empty_table()
    one, two = (t.column("product").to_numpy() for t in (asking, block))
    found = list(_best(one, _matrix(asking.column("vector")), two, _matrix(block.column("vector")), n))
    row, place, value = (np.concatenate(parts) for parts in zip(*found, strict=True))
    return pa.Table.from_arrays([pa.array(one[row]), pa.array(two[place]), pa.array(value)], schema=_FOUND)


def blocks_of(vectors: DataFrame, n: int, block_rows: int) -> DataFrame:
    """(block, product, vector, least, centre, radius); see _inside."""
    spark, total = vectors.sparkSession, vectors.count()
    some = min(MOST_CENTRES, FINER * -(-total // block_rows))
    sample = vectors.orderBy(F.xxhash64("product"), "product").limit(max(1, some)).collect()
    centres = spark.sparkContext.broadcast(_unit(np.array([r["embedding"] for r in sample], dtype=np.float64)))
    placed = private_stage(spark, "placed", lambda: vectors.select("product", "embedding").mapInArrow(
        partial(_deal, centres=centres), "product int, vector array<double>, centre int"
    ))
    sizes = sorted((r["centre"], r["count"]) for r in placed.groupBy("centre").count().collect())  # a row for each centre
    parts = [-(-size // block_rows) for _, size in sizes]
    starts = [sum(parts[:i]) for i in range(len(parts))]
    table = spark.createDataFrame(
        [(c, s, p) for (c, _), s, p in zip(sizes, starts, parts, strict=True)], "centre int, start int, parts int"
    )
    block = (F.col("start") + F.pmod(F.xxhash64("product"), F.col("parts"))).cast("int")
    dealt = placed.join(F.broadcast(table), "centre").select(block.alias("block"), "product", "vector")
    return private_stage(spark, "blocks", lambda: dealt.groupBy("block").applyInArrow(
        lambda t: _inside(t, n),
        "block int, product int, vector array<double>, least double, centre array<double>, radius double",
    ))


def asking(inside: DataFrame, n: int) -> DataFrame:
    """(product, vector, blocks): the blocks that may hold one of a product's nearest, its own always."""
    spark = inside.sparkSession
    # One row for each block, a small part of the vectors that the model holds in the driver anyway.
    rows = sorted(
        inside.groupBy("block").agg(F.first("centre", True).alias("centre"), F.max("radius").alias("radius"), F.count("*").alias("n")).collect()
    )
    known = (
        np.array([r["block"] for r in rows]), np.array([r["centre"] for r in rows]),
        np.array([r["radius"] for r in rows]), np.array([r["n"] for r in rows]),
    )
    return private_stage(spark, "asking", lambda: inside.select("product", "vector", "least").mapInArrow(
        partial(_asked, blocks=spark.sparkContext.broadcast(known), n=n), "product int, vector array<double>, blocks array<int>"
    ))


def nearest(vectors: DataFrame, n: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(product, rank, similar, similarity): the n nearest products of every (product, embedding).

    Each vector is sent once to each block that it asks; a block is sent once to each
    `ASKING_ROWS` vectors that ask it. Cosines are compared to nine digits, ties go to the smaller
    product. The centres are a sample, which decides about speed and not about the result.
    """
    spark = vectors.sparkSession
    schema = "product int, rank int, similar int, similarity double"
    if vectors.isEmpty():
        return spark.createDataFrame([], schema)
    inside = blocks_of(vectors, n, block_rows)
    wanted = asking(inside, n)
    single = wanted.select("product", "vector", F.explode("blocks").alias("block"))
    chunks = single.groupBy("block").agg(F.ceil(F.count("*") / ASKING_ROWS).cast("int").alias("chunks"))
    # A row for each block.
    chunks = F.broadcast(private_stage(spark, "chunks", lambda: chunks))
    left = single.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("product"), F.col("chunks")).cast("int"))
    right = inside.select("block", "product", "vector").join(chunks, "block").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    )
    key = ["block", "chunk"]
    found = left.select(*key, "product", "vector").groupBy(*key).cogroup(
        right.select(*key, "product", "vector").groupBy(*key)
    ).applyInArrow(lambda one, two: _compare(one, two, n), "product int, similar int, similarity double")
    rank = F.row_number().over(W.partitionBy("product").orderBy(F.desc("similarity"), "similar"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n).select("product", "rank", "similar", "similarity")
