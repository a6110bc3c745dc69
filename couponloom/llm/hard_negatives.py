"""Hard negatives by exact inner products of Kronecker-packed vectors.

Components are whole numbers. Shifted by their least value they are not negative, and several candidates'
components of one dimension are laid side by side in the fields of one wide integer. Multiplying
that by an anchor's component and adding up over the dimensions gives the shifted product of
each candidate in its own field: a field is as wide as the largest sum that the batch's own
bounds allow, so no field runs over into the next. The shifts are taken out again by the
sums of both vectors. Doubles hold integers to 2^53 and multiply fastest; where two fields
do not fit into them, Python's integers of any width take over, `WIDE_FIELDS` fields each.

Two maps over all vectors: the first finds each anchor's positives, the second, knowing their
scores, the negatives between. Anchors are worked off in blocks of `ANCHOR_ROWS`, each sent
to all tasks; only the few best of each task are shuffled, by anchor.

Contract of `mine`: rows with a null id, label or vector, or with a null or non-finite
component take no part; shorter vectors, empty ones too, count as filled up with zeros. Rows that carry
the anchor's id are its own: neither positives nor negatives of it. Every other row is
a candidate, repeated ones too, and equal scores go by id. An anchor id on several rows asks
with the smallest vector, then label. Scores are exact; one that 64 bits cannot hold counts as the nearest
long, as a component does. An anchor without positives, a positive without negatives
and an empty table give no rows. Further columns are not read.
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

from couponloom.llm.top_k import Best
from couponloom.workspace import private_folder, private_stage

#: Anchors sent to all tasks at once: with 64 dimensions 2 MB.
ANCHOR_ROWS = 4096
#: Fields of one of Python's integers.
WIDE_FIELDS = 64
_ANCHORS_AT_ONCE = 128
_CANDIDATES_AT_ONCE = 2048
_EXACT_BITS = 53
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


class Packed:
    """Candidates' components in fields of wide integers, ready to be multiplied.

    `low` and `high` bound the components of all anchors that will be asked.
    """

    def __init__(self, candidates: np.ndarray, low: int, high: int):
        self.rows, self.width = candidates.shape
        self.anchor_low, own = low, int(candidates.min(initial=0))
        self.low = own
        top = (high - low) * (int(candidates.max(initial=0)) - own) * self.width
        self.bits = max(1, top.bit_length())
        far = max(-low, high) * max(-own, int(candidates.max(initial=0))) * self.width
        self.narrow = 2 * self.bits <= _EXACT_BITS and far < 1 << 60
        self.fields = _EXACT_BITS // self.bits if self.narrow else WIDE_FIELDS
        words = -(-self.rows // self.fields)
        kind = np.int64 if self.narrow else object
        shifted = np.zeros((words * self.fields, self.width), dtype=kind)
        shifted[: self.rows] = candidates.astype(kind) - own
        self.words = np.zeros((words, self.width), dtype=kind)
        # Field f holds candidates f * words on: a block of rows, so unpacking is a concatenation.
        for field in range(self.fields):
            self.words += shifted[field * words : (field + 1) * words] * (1 << field * self.bits)
        if self.narrow:
            self.words = self.words.astype(np.float64)
        self.sums = candidates.astype(kind).sum(axis=1) if self.rows else np.zeros(0, dtype=kind)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """(anchors, candidates) inner products as longs."""
        kind = np.int64 if self.narrow else object
        whole = anchors.astype(kind)
        moved = whole - self.anchor_low
        product = moved.astype(np.float64) @ self.words.T if self.narrow else moved.dot(self.words.T)
        product = product.astype(kind)
        mask = (1 << self.bits) - 1
        parts = [(product >> field * self.bits) & mask for field in range(self.fields)]
        shifted = np.concatenate(parts, axis=1)[:, : self.rows]
        back = self.low * whole.sum(axis=1)[:, None] + self.anchor_low * self.sums[None, :]
        exact = shifted + back - self.low * self.anchor_low * self.width
        return exact if self.narrow else np.clip(exact, _LEAST, _MOST).astype(np.int64)


class Anchors:
    """A block of anchors: ids, labels, vectors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.low, self.high = int(vectors.min(initial=0)), int(vectors.max(initial=0))

    def scanned(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(anchors, scores, candidate ids, candidate labels) of all pairs, some of either at a time."""
        for batch in batches:
            for start in range(0, batch.num_rows, _CANDIDATES_AT_ONCE):
                part = batch.slice(start, _CANDIDATES_AT_ONCE)
                ids, labels = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
                # Beyond the width of all anchors a component meets zeros only.
                packed = Packed(matrix(part.column("vector"), self.vectors.shape[1]), self.low, self.high)
                for at in range(0, len(self.ids), _ANCHORS_AT_ONCE):
                    rows = slice(at, min(at + _ANCHORS_AT_ONCE, len(self.ids)))
                    yield rows, packed.scores(self.vectors[rows]), ids, labels


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Lists as rows of the given width, filled up with zeros or cut."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], lengths)
    inside = place < width
    out[row[inside], place[inside]] = values[inside]
    return out


def _rows(best: Best, owner: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """What was found: the owner's columns, the candidate and its score."""
    row, rank = np.nonzero(best.ids != np.iinfo(np.int64).max)
    columns = [*(o[row] for o in owner), best.ids[row, rank], best.scores[row, rank]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _positives(batches: Iterator[pa.RecordBatch], anchors: Broadcast, n: int) -> Iterator[pa.RecordBatch]:
    block: Anchors = anchors.value
    best = Best(len(block.ids), n)
    for rows, scores, ids, labels in block.scanned(batches):
        wanted = (block.labels[rows][:, None] == labels) & (block.ids[rows][:, None] != ids)
        a, c = np.nonzero(wanted & (scores >= best.least[rows][:, None]))
        best.add(a + rows.start, scores[a, c], ids[c])
    yield _rows(best, [block.ids], ["anchor_id", "positive_id", "positive_score"])


def _negatives(batches: Iterator[pa.RecordBatch], held: Broadcast, n: int) -> Iterator[pa.RecordBatch]:
    """held: anchors, then each positive's anchor (ascending), id, score and its negatives' least and largest score."""
    block, owner, positive, score, least, most = held.value
    best = Best(len(owner), n)
    for rows, scores, ids, labels in block.scanned(batches):
        other = block.labels[rows][:, None] != labels
        other &= block.ids[rows][:, None] != ids
        first, last = np.searchsorted(owner, [rows.start, rows.stop])
        for p in range(first, last):
            own = scores[owner[p] - rows.start]
            fits = other[owner[p] - rows.start] & (own <= most[p]) & (own >= least[p]) & (own >= best.least[p])
            c = np.flatnonzero(fits)
            best.add(np.full(len(c), p), own[c], ids[c])
    yield _rows(
        best, [block.ids[owner], positive, score], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    )


def usable(vectors: DataFrame, key: str, label: Column, vector: str, scale: int) -> DataFrame:
    """(id, label, vector) of the rows that take part, components scaled and floored."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.col(key).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(key).cast("long").alias("id"), label.cast("long").alias("label"),
        F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).alias("vector"),
    )


def _anchors(rows: list) -> Anchors:
    width = max(len(r["vector"]) for r in rows)
    vectors = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        vectors[i, : len(r["vector"])] = r["vector"]
    ids, labels = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("id", "label"))
    return Anchors(ids, labels, vectors)


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5,
    least_percent: int = 80, most_percent: int = 100, key: str = "vec_id", vector: str = "embedding",
    scale: int = 256, anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each of an anchor's best `positives` of its own label, the best `negatives` of other labels
    whose score is between the given percents of the positive's. A repeated positive counts each
    time among the best, but has its rows once.
    """
    spark = vectors.sparkSession
    folder, schema = private_folder(spark, "hard-negatives"), (
        "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    )
    rows = usable(vectors, key, label, vector, scale)
    chosen = usable(vectors.where(is_anchor), key, label, vector, scale).groupBy("id").agg(
        F.min(F.struct("vector", "label")).alias("own")
    ).select("id", "own.label", "own.vector")
    blocks = max(1, math.ceil(chosen.count() / anchor_rows))
    spark.createDataFrame([], schema).write.parquet(folder)
    for block in range(blocks):
        part = chosen.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block) if blocks > 1 else chosen
        found = sorted(part.collect(), key=lambda r: r["id"])
        if not found:
            continue
        anchors = _anchors(found)
        sent = spark.sparkContext.broadcast(anchors)
        nearest = private_stage(spark, "positives", lambda sent=sent: rows.mapInArrow(
            partial(_positives, anchors=sent, n=positives), "anchor_id long, positive_id long, positive_score long"
        ))
        order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
        # `positives` rows for each anchor of the block at most.
        best = nearest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
        pairs = sorted({(r["anchor_id"], r["positive_id"], r["positive_score"]) for r in best.collect()})
        if not pairs:
            continue
        owner = np.searchsorted(anchors.ids, np.array([p[0] for p in pairs]))
        scores = [p[2] for p in pairs]
        least = [-(-least_percent * s // 100) for s in scores]
        most = [most_percent * s // 100 for s in scores]
        held = spark.sparkContext.broadcast((
            anchors, owner, np.array([p[1] for p in pairs]), np.array(scores),
            *(np.array([min(max(s, _LEAST), _MOST) for s in bound]) for bound in (least, most)),
        ))
        rows.mapInArrow(partial(_negatives, held=held, n=negatives), schema).write.mode("append").parquet(folder)
    order = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    return (
        spark.read.schema(schema).parquet(folder).withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def op13_kronecker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth row of `embeddings`, every seventh with its label moved on."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors, F.col("vec_id") % 100 == 0, moved)
