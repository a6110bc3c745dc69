"""SimHash near-dedup: fingerprints within a few bits, found by the generalised pigeonhole.

The 64 bits are grouped into m parts. If thresholds t_i (from -1 up) sum to d - m + 1, two
fingerprints within d bits are within t_i bits in at least one part i; -1 leaves a part out.
Bits that agree often are put into the same part, so that the other parts tell more. The
thresholds are dealt by dynamic programming on the candidates each would cost, estimated
from all fingerprints, and m is the one whose plan costs least: few wide parts for many
fingerprints, more and narrower ones for few. Every fingerprint is filed under its own
value of each part and probes the values within t_i bits; whoever meets is verified by
counting differing bits.

Equal fingerprints are one row before anything is compared. Where many meet, their group is
cut into blocks, and each pair of blocks is a group of its own, so no task holds more than
two blocks. A group answers with a spanning forest of its verified links: as many rows as
it has members at most, and the same components.

Contract of `near_duplicates`: null and empty texts have fingerprint zero and are linked as
any other; rows that repeat are linked; the component of a document is the smallest key that
can be reached, nulls left out. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from couponloom.llm.components import components
from couponloom.llm.text import give_back, text_bytes
from couponloom.workspace import private_stage

BITS = 64
#: Members of a block of a group where many fingerprints meet.
BLOCK_ROWS = 1024
#: At most so many parts' values are cut into blocks: the bound of what is broadcast for that.
MAX_CUT = 1 << 17
#: Fingerprints of more than 1/HEAVY of the documents are joined by broadcast; fewer than HEAVY rows.
HEAVY = 1024
#: What a probe costs beside a candidate.
PROBE_COST = 4.0
_SLICE = 1 << 16


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Bits set in over half the XXH64 of the shingles of the lower-cased words; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
    ends, n = ends[shingle - 1 :].tolist(), len(words) - shingle + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, _SLICE):
        part = slice(at, at + _SLICE)
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[part], ends[part])], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t, shingle, seed) for t in text_bytes(batch.column("text"))], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found.view(np.int64))], names=["key", "fp"])
    give_back()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp) of every row; a map over the texts."""
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        partial(_fingerprints, shingle=shingle, seed=seed), "key long, fp long"
    )


# Statistics of the bits


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over a task's fingerprints: how often bits i and j are both set."""
    both, n = np.zeros((BITS, BITS)), 0
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        both += bits.T @ bits
        n += len(fps)
    values = np.append(both.ravel(), n)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(values))), pa.array(values.astype(np.int64))], names=["cell", "n"]
    )


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j set: 64 x 64 sums over all of them."""
    cells = fps.select("fp").mapInArrow(_agreement, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    values = np.zeros(BITS * BITS + 1, dtype=np.int64)
    for row in cells.collect():
        values[row["cell"]] = row["n"]
    return int(values[-1]), values[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of nearly one width, correlated ones together, greedily."""
    share = both / max(1, n)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs(share - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        first = max(sorted(left), key=lambda b: tie[b, sorted(left)].sum())
        group = [first]
        left.remove(first)
        while len(group) < width:
            best = max(sorted(left), key=lambda b: tie[b, group].sum())
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


@dataclass(frozen=True)
class Plan:
    """Bits of each part and its threshold."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    cost: float


def within(p: np.ndarray, distance: int) -> np.ndarray:
    """Probability that two fingerprints differ in at most 0..distance of independent bits."""
    found = np.zeros(distance + 1)
    found[0] = 1
    for q in 2 * p * (1 - p):
        found[1:] = found[1:] * (1 - q) + found[:-1] * q
        found[0] *= 1 - q
    return np.cumsum(found)


def allocate(costs: list[list[float]], total: int) -> tuple[float, tuple[int, ...]]:
    """Thresholds that sum to total at the least cost; costs[i][t + 1] is that of t in part i."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for cost in costs:
        ahead: dict[int, tuple[float, tuple[int, ...]]] = {}
        for spent, (sum_, chosen) in best.items():
            for t, c in enumerate(cost, -1):
                now = (sum_ + c, (*chosen, t))
                if spent + t not in ahead or now < ahead[spent + t]:
                    ahead[spent + t] = now
        best = ahead
    return best[total]


def make_plan(fps: DataFrame, distance: int) -> Plan:
    """The cheapest parts and thresholds, from counts of all fingerprints.

    Candidates of threshold 0 are counted: the sum of squares of the sizes of a part's
    values. Beyond that, the independent-bit model of the part is scaled to that count.
    """
    n, both = bit_statistics(fps)
    p = np.diag(both) / max(1, n)
    grouped = {m: group_bits(n, both, m) for m in range(2, distance + 3)}
    pairs = _same_value_pairs(fps, [part for parts in grouped.values() for part in parts])
    plans, at = [], 0
    for m, parts in grouped.items():
        costs = []
        for part in parts:
            model = within(p[part], distance)
            equal = max(pairs[at] / max(1, n), n * model[0], 1e-9)
            at += 1
            scale = equal / max(n * model[0], 1e-9)
            probes = [math.comb(len(part), t) for t in range(distance + 1)]
            costs.append([0.0] + [
                min(float(n), n * model[t] * scale) + PROBE_COST * sum(probes[: t + 1]) for t in range(distance + 1)
            ])
        cost, thresholds = allocate(costs, distance - m + 1)
        plans.append(Plan(tuple(map(tuple, parts)), thresholds, cost))
    return min(plans, key=lambda plan: plan.cost)


def _value(part: tuple[int, ...] | list[int]):
    """The fingerprint with all bits but the part's cleared."""
    mask = sum(1 << b for b in part)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _same_value_pairs(fps: DataFrame, parts: list) -> list[float]:
    """Sum of squared sizes of the values of each part."""
    values = fps.select(F.posexplode(F.array(*[_value(part) for part in parts])).alias("part", "value"))
    sizes = values.groupBy("part", "value").agg(F.count("*").alias("n"))
    sums = sizes.groupBy("part").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs")).collect()
    found = {row["part"]: row["pairs"] for row in sums}
    return [found.get(i, 0.0) for i in range(len(parts))]


# Probing


def _flips(part: tuple[int, ...], threshold: int) -> list[int]:
    """Signed masks of all ways to change at most threshold bits of a part."""
    masks = [0]
    for _ in range(threshold):
        masks += [m ^ (1 << b) for m in masks for b in part]
    return sorted({m - (1 << 64) if m >> 63 else m for m in masks})


def _probes(fps: DataFrame, plan: Plan) -> DataFrame:
    """(part, value, fp, filed): fp under its own values and under those it probes."""
    rows = None
    for i, (part, t) in enumerate(zip(plan.parts, plan.thresholds, strict=True)):
        if t < 0:
            continue
        flips = F.array(*[F.lit(m) for m in _flips(part, t)])
        own = fps.select(F.lit(i).alias("part"), _value(part).alias("own"), "fp", F.explode(flips).alias("flip"))
        found = own.select("part", F.col("own").bitwiseXOR(F.col("flip")).alias("value"), "fp", (F.col("flip") == 0).alias("filed"))
        rows = found if rows is None else rows.union(found)
    return rows


def _cut(rows: DataFrame) -> DataFrame:
    """Add `cell`: a group of many rows is cut into blocks, a cell for each pair of blocks."""
    sizes = rows.groupBy("part", "value").agg(F.count("*").alias("n"))
    total = rows.count()
    block = max(BLOCK_ROWS, math.ceil(total / MAX_CUT))
    large = sizes.where(F.col("n") > 2 * block).select(
        "part", "value", F.ceil(F.col("n") / block).cast("int").alias("k")
    )
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    cells = F.when(F.col("k").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.coalesce(F.col("k"), F.lit(1)) - 1),
            lambda j: F.least(own, j) * F.col("k") + F.greatest(own, j),
        )
    )
    return rows.join(F.broadcast(large), ["part", "value"], "left").select(
        "part", "value", "fp", "filed", F.explode(cells).alias("cell")
    )


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest row of the component of each of n rows, under links a - b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


_LINKS = 1 << 20


def _verify(group: np.ndarray, fp: np.ndarray, filed: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among rows of equal group: a filed one and another within distance bits."""
    root = np.arange(len(fp))
    ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(group)) if len(group) else np.zeros(0, np.int64)
    left = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - np.arange(len(fp)) - 1
    held_a, held_b, held = [root[:0]], [root[:0]], 0
    step, rows = 1, np.flatnonzero(left >= 1)
    while len(rows):
        other = rows + step
        near = np.bitwise_count((fp[rows] ^ fp[other]).view(np.uint64)) <= distance
        near &= (filed[rows] | filed[other]) & (root[rows] != root[other])
        held_a.append(rows[near])
        held_b.append(other[near])
        held += int(near.sum())
        if held > _LINKS:
            root = _join(root, held_a, held_b)
            held_a, held_b, held = [root[:0]], [root[:0]], 0
        step += 1
        rows = rows[left[rows] >= step]
    root = _join(root, held_a, held_b)
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return fp[moved], fp[root[moved]]


def _join(root: np.ndarray, held_a: list[np.ndarray], held_b: list[np.ndarray]) -> np.ndarray:
    """Components of the held links and the ones found before."""
    n = len(root)
    return _forest(np.concatenate([np.arange(n), *held_a]), np.concatenate([root, *held_b]), n)


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Groups come sorted; the last one of a batch is carried into the next."""
    held: list[np.ndarray] = []

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]

    def found(part: list[np.ndarray]) -> pa.RecordBatch:
        group = np.zeros(len(part[0]), dtype=np.int64)
        if len(group):
            new = (np.diff(part[0]) != 0) | (np.diff(part[1]) != 0) | (np.diff(part[2]) != 0)
            group[1:] = np.cumsum(new)
        a, b = _verify(group, part[3], part[4].astype(bool), distance)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        now = columns(batch)
        held = [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)] if held else now
        if not len(held[0]):
            continue
        last = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) & (held[2] == held[2][-1])
        cut = len(last) - int(last.sum())
        if cut:
            yield found([x[:cut] for x in held])
            held = [x[cut:] for x in held]
    if held:
        yield found(held)


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints with the components of all pairs within distance bits."""
    plan = make_plan(fps, distance)
    spark = fps.sparkSession
    rows = private_stage(spark, "probes", lambda: _probes(fps, plan))
    groups = ["part", "value", "cell"]
    return (
        _cut(rows).repartition(*groups).sortWithinPartitions(*groups, "fp")
        .select(*groups, "fp", "filed").mapInArrow(partial(_links, distance=distance), "a long, b long")
    )


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3
) -> DataFrame:
    """(key, fingerprint, component_id) of every row."""
    spark = docs.sparkSession
    marked = private_stage(spark, "fingerprints", lambda: fingerprints(docs, key, text, shingle))
    fps = private_stage(
        spark, "distinct",
        lambda: marked.groupBy("fp").agg(F.min("key").alias("first"), F.count("*").alias("n")),
    )
    roots = components(links(fps.select("fp"), distance))
    rooted = private_stage(
        spark, "rooted",
        lambda: fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")),
    )
    least = private_stage(spark, "least", lambda: rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    found = private_stage(spark, "found", lambda: rooted.join(least, "root").select("fp", "component_id", "n"))
    total = found.agg(F.sum("n")).first()[0] or 0
    heavy = found.where(F.col("n") * HEAVY > total).select("fp", "component_id")
    common = marked.join(F.broadcast(heavy), "fp")
    other = marked.join(F.broadcast(heavy), "fp", "left_anti").join(
        found.where(F.col("n") * HEAVY <= total).select("fp", "component_id"), "fp"
    )
    return common.select("key", "fp", "component_id").union(other.select("key", "fp", "component_id")).select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of `documents`: three-word shingles, at most three bits."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
