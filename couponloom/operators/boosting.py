"""Gradient-boosted trees over binned features, for training sets of many rows.

The trees are those of Spark's GBTClassifier: thresholds between neighbouring values, at most `BINS`
bins a feature, splits by the drop of variance, ties to the first feature and threshold, leaves at
their mean, first tree on the labels -1 and 1 and the others on the residuals of the log loss. What
differs is how the rows are passed over. They are binned once into small codes, rows of the same codes and
label become one with their number, since no tree can tell them apart, and a pass adds up counts and
residuals per code and node inside the task, so a row costs a few array look-ups and not one update
per feature. Residuals are added in whole units, so the trees do not depend on how
rows are dealt to tasks, and thresholds come from all rows and not from a sample.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import prod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponloom.workspace import enable_checkpoints, remove

BINS = 32
# Values of a feature up to which its thresholds follow from the count of each value.
MOST_VALUES = 10_000
# Rows of a chunk, which a task holds in memory one at a time, and of the chunks of a task.
CHUNK_ROWS, ROWS_PER_TASK = 1 << 16, 2_000_000
# Codes of a bundle: features whose bins have no more combinations share one code.
CODES = 2_048
# Trees between two checkpoints, and the deepest tree: a row's path is kept in 64 bits.
CHECKPOINT_EVERY, MOST_DEPTH = 10, 6
KEPT = StorageLevel.MEMORY_AND_DISK_DESER
# Partial sums up to which tasks send theirs straight to the driver.
DIRECT_SUMS = 128

# Codes by bundle, labels of -1 and 1, margins, and the number of training rows that have these codes and label.
Chunk = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Split:
    """Rows of the node (1 is the root, 2n and 2n + 1 are the children of n) above the bin go right."""

    node: int
    feature: int
    bin: int


@dataclass(frozen=True)
class Tree:
    depth: int
    splits: tuple[Split, ...]
    # By position among the 2 ** depth last nodes; a leaf further up stands at its first one.
    values: np.ndarray

    def masks(self, bins: Bins) -> dict[int, np.ndarray]:
        """For each bundle in use: by code, the last nodes that its splits leave open."""
        kind = np.uint32 if self.depth <= 5 else np.uint64
        found: dict[int, np.ndarray] = {}
        for s in self.splits:
            bundle, digit = bins.digit(s.feature)
            mask = found.setdefault(bundle, np.full(len(digit), ~kind(0)))
            level = s.node.bit_length() - 1
            width = 1 << (self.depth - level)
            left = ((1 << width // 2) - 1) << (s.node - (1 << level)) * width
            mask[digit > s.bin] &= ~kind(left)
        return found


def _positions(masks: dict[int, np.ndarray], codes: np.ndarray) -> np.ndarray:
    """Position of each row's leaf: the first last node that no split has closed."""
    if not masks:
        return np.zeros(codes.shape[1], np.uint8)
    (first, mask), *rest = masks.items()
    open_ = mask.take(codes[first])
    for bundle, mask in rest:
        open_ &= mask.take(codes[bundle])
    return np.bitwise_count(~open_ & (open_ - open_.dtype.type(1)))


@dataclass(frozen=True)
class Bins:
    """Thresholds of each feature, and the bundles of features that share a code."""

    thresholds: tuple[np.ndarray, ...]
    bundles: tuple[tuple[int, ...], ...] = field(init=False)

    def __post_init__(self) -> None:
        bundles: list[list[int]] = []
        for f in sorted(range(len(self.thresholds)), key=lambda f: -self._size(f)):
            if self._size(f) == 1:
                continue  # a constant
            fits = (b for b in bundles if prod(map(self._size, b)) * self._size(f) <= CODES)
            if (bundle := next(fits, None)) is None:
                bundles.append(bundle := [])
            bundle.append(f)
        object.__setattr__(self, "bundles", tuple(map(tuple, bundles)))

    def _size(self, feature: int) -> int:
        return len(self.thresholds[feature]) + 1

    @property
    def sizes(self) -> list[tuple[int, ...]]:
        return [tuple(self._size(f) for f in b) for b in self.bundles]

    @property
    def codes(self) -> list[int]:
        return [prod(sizes) for sizes in self.sizes]

    def digit(self, feature: int) -> tuple[int, np.ndarray]:
        """The feature's bundle, and its bin in each code of that."""
        bundle = next(b for b, members in enumerate(self.bundles) if feature in members)
        place = self.bundles[bundle].index(feature)
        sizes = self.sizes[bundle]
        return bundle, np.arange(prod(sizes)) // prod(sizes[place + 1 :]) % sizes[place]

    def encode(self, values: list[np.ndarray]) -> np.ndarray:
        if any(np.isnan(v).any() for v in values):
            raise ValueError("a feature is not a number")
        coded = np.empty((len(self.bundles), len(values[0])), np.uint16)
        for b, (members, sizes) in enumerate(zip(self.bundles, self.sizes)):
            found = tuple(np.searchsorted(self.thresholds[f], values[f]) for f in members)
            coded[b] = np.ravel_multi_index(found, sizes)
        return coded

    def by_feature(self, sums: list[np.ndarray]) -> list[np.ndarray]:
        """Sums by code of each bundle as sums by bin of each feature, in the order of the bundles."""
        parts = []
        for sizes, s in zip(self.sizes, sums):
            cube = s.reshape(*s.shape[:2], *sizes)
            axes = range(2, cube.ndim)
            parts += [cube.sum(axis=tuple(a for a in axes if a != keep)) for keep in axes]
        return parts


def _between(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Midpoints of neighbouring values: all of them, or those nearest to equal shares of the rows."""
    middle = (values[1:] + values[:-1]) / 2
    if len(values) <= bins:
        return middle
    share = counts.sum() / bins
    running, target, chosen = np.cumsum(counts), share, []
    for i in range(len(middle)):
        if abs(running[i] - target) < abs(running[i + 1] - target):
            chosen.append(middle[i])
            target += share
    return np.array(chosen)


def _tables(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to so many rows at least."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        held += [batch] if batch is not None else []
        if (size := sum(b.num_rows for b in held)) and (batch is None or size >= rows):
            yield pa.Table.from_batches(held).combine_chunks()
            held.clear()


def _whole(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    for table in _tables(batches, rows):
        yield [c.to_numpy().astype(np.float64, copy=False) for c in table.columns]


def _value_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for columns in _whole(batches, CHUNK_ROWS):
        for f, values in enumerate(columns):
            found, n = np.unique(values + 0.0, return_counts=True)  # -0.0 is 0.0
            yield pa.record_batch([np.full(len(n), f, np.int32), found, n.astype(np.int64)], ["feature", "value", "n"])


def thresholds(
    rows: DataFrame, features: list[str], most_values: int = MOST_VALUES
) -> tuple[int, tuple[np.ndarray, ...]]:
    """Number of rows, and the thresholds of each feature from all of them.

    Quantiles where a feature's values are too many to count in the driver.
    """
    counts = rows.select(*features).mapInArrow(_value_counts, "feature int, value double, n long")
    counts = counts.groupBy("feature", "value").agg(F.sum("n").alias("n")).persist()
    sizes = {r.feature: r for r in counts.groupBy("feature").agg(
        F.count("*").alias("values"), F.sum("n").alias("rows")).collect()}
    if not sizes:
        raise ValueError("no training rows")
    n = sizes[0].rows
    many = [f for f, r in sizes.items() if r["values"] > most_values]
    bins = min(BINS, n)
    table = counts.filter(~F.col("feature").isin(many)).toPandas().sort_values(["feature", "value"])
    counts.unpersist()
    found = {f: _between(t.value.to_numpy(), t.n.to_numpy(), bins) for f, t in table.groupby("feature")}
    if many:
        shares = [k / bins for k in range(1, bins)]
        quantiles = rows.agg(*[F.percentile_approx(features[f], shares, 10_000) for f in many]).first()
        found |= {f: np.unique(q) for f, q in zip(many, quantiles)}
    return n, tuple(found[f] for f in range(len(features)))


def _coded(batches: Iterator[pa.RecordBatch], bins: Bins) -> Iterator[pa.RecordBatch]:
    """Batches of features and, last, the label as (codes, rows): the label is one code more."""
    for *values, label in _whole(batches, CHUNK_ROWS):
        if not np.isin(label, (0.0, 1.0)).all():
            raise ValueError("a label is neither 0 nor 1")
        codes = np.vstack([bins.encode(values), label.astype(np.uint16)]).T.copy()
        found, n = np.unique(codes.view(f"V{codes.shape[1] * 2}").ravel(), return_counts=True)
        yield pa.record_batch([
            pa.FixedSizeBinaryArray.from_buffers(pa.binary(found.itemsize), len(found), [None, pa.py_buffer(found)])
            .cast(pa.binary()), n.astype(np.int64),
        ], ["codes", "n"])


def _chunks(batches: Iterator[pa.RecordBatch], bundles: int) -> Iterator[pa.RecordBatch]:
    """Distinct (codes, n) as pickled chunks."""
    for table in _tables(batches, CHUNK_ROWS):
        joined = b"".join(table.column("codes").to_pylist())
        codes = np.frombuffer(joined, np.uint16).reshape(-1, bundles + 1).T
        labels = 2 * codes[-1].astype(np.int8) - 1
        made = codes[:-1].copy(), labels, np.zeros(len(labels)), table.column("n").to_numpy().astype(np.float64)
        yield pa.record_batch([pa.array([pickle.dumps(made, protocol=5)], pa.binary())], ["chunk"])


def _targets(labels: np.ndarray, margins: np.ndarray, first: bool, unit: float) -> np.ndarray:
    """What a tree learns, in whole units: the labels, then minus the gradient of the log loss."""
    if first:
        return labels * unit
    with np.errstate(over="ignore"):
        return np.rint(4 * unit * labels / (1 + np.exp(2 * labels * margins)))


def _sums(
    chunks: Iterator[Chunk], bins: Bins, tree: Tree, nodes: list[int], first: bool, unit: float
) -> Iterator[np.ndarray]:
    """[counts, sums of targets] by node and bin of every feature, and by node alone at the end.

    `nodes` are of one level; rows elsewhere are left aside before their codes are read.
    """
    level, masks = nodes[0].bit_length() - 1, tree.masks(bins)
    slots = np.full(1 << level, -1)
    slots[np.array(nodes) - (1 << level)] = range(len(nodes))
    sizes = (*bins.codes, 1)
    sums = [np.zeros((2, len(nodes), n), np.int64) for n in sizes]
    for codes, labels, margins, rows in chunks:
        if level:
            at = slots[_positions(masks, codes) >> (tree.depth - level)]
            inside = np.flatnonzero(at >= 0)
            at, codes, rows = at[inside], codes[:, inside], rows[inside]
            labels, margins = labels[inside], margins[inside]
        else:
            at = np.zeros(len(labels), np.int64)
        targets = _targets(labels, margins, first, unit) * rows
        for n, total, code in zip(sizes, sums, (*codes, 0)):
            key = at * n + code
            for part, weights in zip(total, (rows, targets)):
                part += np.bincount(key, weights, part.size).reshape(part.shape).astype(np.int64)
    yield np.concatenate([*bins.by_feature(sums[:-1]), sums[-1]], axis=2)


def _moved(chunks: Iterator[Chunk], bins: Bins, tree: Tree, weight: float) -> Iterator[Chunk]:
    """Chunks with the tree added to their margins."""
    masks = tree.masks(bins)
    for codes, labels, margins, rows in chunks:
        yield codes, labels, margins + weight * tree.values[_positions(masks, codes)], rows


def _best(counts: np.ndarray, sums: np.ndarray, bins: Bins) -> tuple[float, Split | None, list[tuple[int, int]]]:
    """The split of one node with the largest drop of variance: drop, split, [count, sum] of both sides."""
    n, s, at = counts[-1], sums[-1], 0
    best: dict[int, tuple[float, int, list[tuple[int, int]]]] = {}
    for f in (f for members in bins.bundles for f in members):
        size = len(bins.thresholds[f]) + 1
        ln, ls = np.cumsum(counts[at : at + size])[:-1], np.cumsum(sums[at : at + size])[:-1]
        at += size
        rn, rs = n - ln, s - ls
        both = (ln > 0) & (rn > 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            gain = ls.astype(float) ** 2 / ln + rs.astype(float) ** 2 / rn - float(s) ** 2 / n
        gain = np.where(both, gain, -np.inf)
        k = int(gain.argmax())
        best[f] = float(gain[k]), k, [(int(ln[k]), int(ls[k])), (int(rn[k]), int(rs[k]))]
    if not best:
        return 0.0, None, []
    f = max(sorted(best), key=lambda f: best[f][0])
    gain, k, sides = best[f]
    return gain, Split(0, f, k), sides


@dataclass(frozen=True)
class BoostedTrees:
    bins: Bins
    trees: tuple[tuple[float, Tree], ...]

    def probability(self) -> Callable:
        """Vectorised function of all features, in their order, to the probability of label 1."""
        model = self

        @F.pandas_udf("double")
        def scored(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            tables = [(weight, tree.values, tree.masks(model.bins)) for weight, tree in model.trees]
            for columns in batches:
                codes = model.bins.encode([c.to_numpy(np.float64) for c in columns])
                margin = np.zeros(codes.shape[1])
                for weight, values, masks in tables:
                    margin += weight * values[_positions(masks, codes)]
                with np.errstate(over="ignore"):
                    yield pd.Series(1 / (1 + np.exp(-2 * margin)))

        return scored


def _grow(
    sums_at: Callable[[Tree, list[int]], np.ndarray], root: np.ndarray, bins: Bins, depth: int, unit: float
) -> Tree:
    """One tree, level by level; `root` are the sums of its first node.

    Of two children the one with fewer rows is summed; the other has the rest of their parent's sums.
    """
    values = np.zeros(1 << depth)
    tree, sums = Tree(depth, (), values), {1: root[:, 0]}
    values[0] = root[1, 0, -1] / root[0, 0, -1] / unit
    for level in range(depth):
        splits, fewer = [], {}
        for node, (counts, totals) in sorted(sums.items()):
            gain, split, sides = _best(counts, totals, bins)
            if gain <= 0:
                continue
            splits.append(Split(node, split.feature, split.bin))
            for child, (n, s) in zip((2 * node, 2 * node + 1), sides):
                values[(child - (2 << level)) << (depth - level - 1)] = s / n / unit
            fewer[node] = 2 * node + (sides[1][0] < sides[0][0])
        if not splits:
            break
        tree = Tree(depth, (*tree.splits, *splits), values)
        if level + 1 < depth:
            asked = list(fewer.values())
            found = dict(zip(asked, np.moveaxis(sums_at(tree, asked), 1, 0)))
            sums = found | {child ^ 1: sums[node] - found[child] for node, child in fewer.items()}
    return tree


def boosted_trees(
    rows: DataFrame, features: list[str], label: str, iterations: int, depth: int, step: float,
    most_values: int = MOST_VALUES,
) -> BoostedTrees:
    """Fit to (features, label) of all rows. The features are doubles without nulls, the label is 0 or 1.

    A pass over the chunks sums one level of a tree; the first level of the next tree is summed by the
    pass that adds the last tree to the margins.
    """
    if not 1 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth must be 1 to {MOST_DEPTH}")
    spark = rows.sparkSession
    enable_checkpoints(spark)
    n, found = thresholds(rows, features, most_values)
    bins = Bins(found)
    # A sum of whole units over all rows stays below 2 ** 53, where doubles are exact.
    unit = 2.0 ** min(30, 50 - n.bit_length())
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK))
    levels = 1 if tasks <= DIRECT_SUMS else 2
    coded = rows.select(*features, F.col(label).cast("double")).mapInArrow(lambda it: _coded(it, bins), "codes binary, n long")
    distinct = coded.groupBy("codes").agg(F.sum("n").alias("n")).repartition(tasks, "codes")
    chunks = distinct.mapInArrow(lambda it: _chunks(it, len(bins.bundles)), "chunk binary")
    state: RDD = chunks.rdd.map(lambda r: pickle.loads(r.chunk)).persist(KEPT)

    def sums(tree: Tree, nodes: list[int], first: bool) -> np.ndarray:
        part = state.mapPartitions(lambda it: _sums(it, bins, tree, nodes, first, unit))
        return part.treeReduce(np.add, levels)

    none = Tree(depth, (), np.zeros(1 << depth))
    root, trees, kept = sums(none, [1], True), [], None
    for i in range(iterations):
        tree = _grow(lambda t, nodes: sums(t, nodes, i == 0), root, bins, depth, unit)
        weight = step if i else 1.0
        trees.append((weight, tree))
        if i + 1 == iterations:
            break
        past = state
        state = past.mapPartitions(lambda it, t=tree, w=weight: _moved(it, bins, t, w)).persist(KEPT)
        if saved := (i + 1) % CHECKPOINT_EVERY == 0:
            state.checkpoint()
        root = sums(none, [1], False)
        past.unpersist()
        if saved:
            if kept:
                remove(spark, kept)
            kept = state.getCheckpointFile()
    state.unpersist()
    if kept:
        remove(spark, kept)
    return BoostedTrees(bins, tuple(trees))
