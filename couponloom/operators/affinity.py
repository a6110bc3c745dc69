"""Baskets, product co-occurrence and clusters of co-purchased members."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import PowerIterationClustering
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from couponloom.workspace import private_stage

BASKET = ["week", "shopper"]
SHOPPERS_PER_BUCKET = 65_536
# A basket list holds at most so many items.
PRODUCTS_PER_LIST = 4_096
COPIES_PER_LIST = 1
# Members of a group whose pairs are formed at once, and distinct pairs a task holds before it emits.
TILE = 2_048
PAIRS_HELD = 1 << 21
PIVOT_LIMIT = 1_000
# Power iterations, and the edges of a partition in them.
ITERATIONS = 10
EDGES_PER_PARTITION = 200_000
MEMBERS_PER_BUCKET = 65_536


def basket_ids(baskets: DataFrame) -> DataFrame:
    """Dense zero-based basket id in (week, shopper) order.

    Baskets are numbered inside buckets of neighbouring shoppers of one week and shifted
    by the number of baskets in earlier buckets, so no window spans the whole table. The
    windows over buckets see one row per week and per 65,536 shoppers.
    """
    bucket = F.floor(F.col("shopper") / SHOPPERS_PER_BUCKET).alias("bucket")
    keys = baskets.select(*BASKET).distinct().select(*BASKET, bucket)
    sizes = keys.groupBy("week", "bucket").agg(F.count("*").alias("size"))
    before = W.orderBy("week", "bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        "week", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start")
    )
    inside = W.partitionBy("week", "bucket").orderBy("shopper")
    return (
        keys.withColumn("position", F.row_number().over(inside))
        .join(starts, ["week", "bucket"])
        .select(*BASKET, (F.col("start") + F.col("position") - 1).alias("basket"))
    )


def with_basket_id(baskets: DataFrame) -> DataFrame:
    """Rows without a week or shopper belong to no basket and leave."""
    return baskets.join(basket_ids(baskets), BASKET)


def basket_lists(baskets: DataFrame) -> DataFrame:
    """(week, shopper, part, items): products of a basket as strings, in product order.

    A basket is one list, part 0, whatever its products are. One with more items than a
    list may hold goes on in further parts, cut by position, and no item is lost.
    """
    limit = PRODUCTS_PER_LIST * COPIES_PER_LIST
    counted = baskets.groupBy(*BASKET, "product").agg(F.count("*").alias("n"))
    ahead = W.partitionBy(*BASKET).orderBy("product").rowsBetween(W.unboundedPreceding, -1)
    placed = counted.withColumn("start", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    first, last = F.floor(F.col("start") / limit), F.floor((F.col("start") + F.col("n") - 1) / limit)
    cut = placed.withColumn("part", F.explode(F.sequence(first, last)))
    copies = F.least(F.col("start") + F.col("n"), (F.col("part") + 1) * limit) - F.greatest(
        "start", F.col("part") * limit
    )
    parts = cut.groupBy(*BASKET, "part").agg(
        F.sort_array(F.collect_list(F.struct("product", copies.cast("int").alias("n")))).alias("c")
    )
    items = F.flatten(
        F.transform("c", lambda x: F.array_repeat(x["product"].cast("string"), x["n"]))
    )
    return parts.select(*BASKET, "part", items.alias("items"))


def context_lists(baskets: DataFrame) -> DataFrame:
    """Lists in which any two items of a basket meet: the basket, or each pair of its parts."""
    lists = basket_lists(baskets)
    whole = W.partitionBy(*BASKET)
    several = F.max("part").over(whole) > 0
    marked = lists.withColumn("several", several)
    cut = marked.filter("several").drop("several")
    later = cut.select(*BASKET, F.col("part").alias("later"), F.col("items").alias("more"))
    pairs = cut.join(later, BASKET).filter("part < later").select(F.concat("items", "more").alias("items"))
    return marked.filter("NOT several").select("items").unionByName(pairs)


def max_basket_size(baskets: DataFrame) -> DataFrame:
    sizes = baskets.groupBy(*BASKET).agg(F.count("*").alias("size"))
    return sizes.agg(F.max("size").alias("max_basket_size"))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + length), one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


_SHIFT = 1 << 31


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of a task over its groups, one row for each pair of members held."""
    keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def added(left, left_n, right, right_n) -> None:
        nonlocal keys, sums
        found = (left + _SHIFT).astype(np.uint64) << np.uint64(32) | (right + _SHIFT).astype(np.uint64)
        keys, place = np.unique(np.concatenate([keys, found]), return_inverse=True)
        total = np.zeros(len(keys), dtype=np.int64)
        np.add.at(total, place, np.concatenate([sums, left_n * right_n]))
        sums = total

    def emit() -> pa.RecordBatch:
        nonlocal keys, sums
        one = (keys >> np.uint64(32)).astype(np.int64) - _SHIFT
        two = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64) - _SHIFT
        out = pa.RecordBatch.from_arrays(
            [pa.array(one, pa.int32()), pa.array(two, pa.int32()), pa.array(sums, pa.int64())],
            names=["member_1", "member_2", "n"],
        )
        keys, sums = keys[:0], sums[:0]
        return out

    def flat(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = batch.column(k)
        rows = lists.flatten()
        member, n = (rows.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        return member, n, offsets - offsets[0]

    for batch in batches:
        left, left_n, offsets = flat(batch, 0)
        right, right_n, others = flat(batch, 1)
        rows = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        place = np.arange(len(left))
        alone = np.diff(others)[rows] == 0
        # A group meets itself from each member on, or the whole of another slice.
        pool, pool_n = np.concatenate([left, right]), np.concatenate([left_n, right_n])
        start = np.where(alone, place, len(left) + others[:-1][rows])
        count = np.where(alone, offsets[1:][rows] - place, np.diff(others)[rows])
        done = np.cumsum(count)
        at = 0
        while at < len(left):
            end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS_HELD, side="right")))
            one, two = np.repeat(place[at:end], count[at:end]), _ranges(start[at:end], count[at:end])
            added(left[one], left_n[one], pool[two], pool_n[two])
            if len(keys) > PAIRS_HELD:
                yield emit()
            at = end
    yield emit()


def cooccurrence(
    df: DataFrame, member: str, n_members: int | None = None, group: list[str] | None = None
) -> DataFrame:
    """(member_1, member_2, n): sum over groups of n(group, 1) * n(group, 2).

    Both directions and the diagonal are given. Members of a group are counted first,
    then each task adds up the pairs of its groups and sends on only its sums, half of
    the table, so pairs within a group are never emitted as rows. A group of many members
    is cut into slices, and the pairs of slices are dealt out over the tasks. Every
    member is kept, whatever `n_members` says.
    """
    group = group or BASKET
    counts = (
        df.filter(F.col(member).isNotNull())
        .groupBy(*group, F.col(member).cast("int").alias("member"))
        .agg(F.count("*").alias("n"))
    )
    vectors = counts.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("member", "n"))).alias("c"))
    none = F.array().cast(vectors.schema["c"].dataType)
    small = vectors.filter(F.size("c") <= TILE).select(F.col("c").alias("left"), none.alias("right"))
    # A group is cut before its slices are paired, so a pair of slices carries those two alone.
    last = F.floor((F.size("c") - 1) / TILE).cast("int")
    slices = (
        vectors.filter(F.size("c") > TILE)
        .select(*group, "c", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("i"))
        .select(*group, "last", "i", F.slice("c", F.col("i") * TILE + 1, TILE).alias("left"))
    )
    ahead = slices.withColumn("j", F.explode(F.sequence("i", "last")))
    other = slices.select(*[F.col(c).alias(f"{c}_of") for c in group], F.col("i").alias("j_of"), F.col("left").alias("right"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in group], F.col("j") == F.col("j_of"))
    large = ahead.join(other, same).select(
        "left", F.when(F.col("i") == F.col("j"), none).otherwise(F.col("right")).alias("right")
    )
    partial = small.unionByName(large).mapInArrow(_pair_sums, "member_1 int, member_2 int, n bigint")
    half = partial.groupBy("member_1", "member_2").agg(F.sum("n").alias("n"))
    there = F.struct("member_1", "member_2")
    back = F.struct(F.col("member_2").alias("member_1"), F.col("member_1").alias("member_2"))
    both = F.when(F.col("member_1") == F.col("member_2"), F.array(there)).otherwise(F.array(there, back))
    return half.select(F.explode(both).alias("pair"), "n").select("pair.member_1", "pair.member_2", "n")


def cooccurrence_table(edges: DataFrame, n_members: int, value: str = "n") -> DataFrame:
    """Dense table, one column per member; for member sets that fit into columns."""
    if n_members > PIVOT_LIMIT:
        raise ValueError(f"{n_members} members do not fit into columns, use cooccurrence_blocks")
    table = edges.groupBy("member_1").pivot("member_2", list(range(n_members))).agg(F.sum(value))
    return table.fillna(0).select(
        "member_1", *[F.col(str(k)).alias(f"with_{k}") for k in range(n_members)]
    )


def cooccurrence_blocks(edges: DataFrame, n_members: int, value: str = "n", width: int = PIVOT_LIMIT) -> DataFrame:
    """(member_1, first, counts): the dense table in blocks of columns, for any number of members.

    A row is cut into arrays of `width` counts from member `first` on, the last one shorter. Blocks
    without any count are rows of zeros. Members from `n_members` on have no column.
    """
    first = F.expr(f"member_2 - member_2 % {width}")
    inside = edges.filter(F.col("member_2").between(0, n_members - 1))
    held = inside.groupBy("member_1", first.alias("first")).agg(
        F.map_from_entries(F.collect_list(F.struct("member_2", value))).alias("held")
    )
    starts = F.sequence(F.lit(0), F.lit(n_members - 1), F.lit(width))
    places = edges.select("member_1").distinct().select("member_1", F.explode(starts).alias("first"))
    last = F.least(F.col("first") + width, F.lit(n_members)) - 1
    count = F.transform(F.sequence("first", last), lambda k: F.coalesce(F.col("held")[k], F.lit(0)))
    return places.join(held, ["member_1", "first"], "left").select("member_1", "first", count.alias("counts"))


def clip_diagonal(edges: DataFrame) -> DataFrame:
    """Self co-occurrence becomes the mean of the table with a zero diagonal.

    Adds the distance 1 - n. Pairs without an edge have n 0 and distance 1.
    """
    own = F.col("member_1") == F.col("member_2")
    total = F.coalesce(F.sum(F.when(~own, F.col("n"))), F.lit(0)).cast("double")
    members = F.count_if(own).cast("double")
    mean = edges.agg(F.try_divide(total, members * members).alias("mean")).scalar()
    return edges.select(
        "member_1", "member_2", F.when(own, mean).otherwise(F.col("n").cast("double")).alias("n")
    ).withColumn("distance", 1 - F.col("n"))


def member_clusters(edges: DataFrame, k: int = 3, iterations: int = ITERATIONS) -> DataFrame:
    """(member, cluster) by power iteration on the edges, whose counts are the similarities.

    Work and memory follow the edges: no row vector of a member is built, so neither the number of
    members nor one that meets all others matters. Clusters are numbered by their smallest member;
    members that meet no other one are cluster k. Partitions follow from the number of edges, so that the
    size of the cluster does not enter.
    """
    spark = edges.sparkSession
    pairs = edges.filter((F.col("member_1") < F.col("member_2")) & (F.col("n") > 0)).select(
        F.col("member_1").cast("long").alias("src"), F.col("member_2").cast("long").alias("dst"),
        F.col("n").cast("double").alias("weight"),
    )
    written = private_stage(spark, "pairs", lambda: pairs)
    members = edges.select(F.col("member_1").alias("member")).distinct()
    partitions = -(-written.count() // EDGES_PER_PARTITION)
    if not partitions:
        return members.withColumn("cluster", F.lit(k))
    fixed = written.repartition(partitions, "src").sortWithinPartitions("src", "dst")
    found = PowerIterationClustering(k=k, maxIter=iterations, weightCol="weight").assignClusters(fixed)
    named = private_stage(
        spark, "clusters", lambda: found.select(F.col("id").cast("int").alias("member"), F.col("cluster").alias("found"))
    )
    firsts = sorted(tuple(r) for r in named.groupBy("found").agg(F.min("member")).select("min(member)", "found").collect())
    number = F.create_map(*[F.lit(x) for i, (_, old) in enumerate(firsts) for x in (old, i)])  # k entries
    labels = named.select("member", number[F.col("found")].alias("cluster"))
    return members.join(labels, "member", "left").select("member", F.coalesce("cluster", F.lit(k)).alias("cluster"))


def cluster_positions(clusters: DataFrame) -> DataFrame:
    """(member, cluster, position): zero-based position in (cluster, member) order.

    Members are ranked inside ranges of neighbouring ids of one cluster and shifted by the sizes of earlier
    ranges; the one window without a partition sees a row for each range.
    """
    bucket = F.floor(F.col("member") / MEMBERS_PER_BUCKET).alias("bucket")
    placed = clusters.select("member", "cluster", bucket)
    sizes = placed.groupBy("cluster", "bucket").agg(F.count("*").alias("size"))
    before = W.orderBy("cluster", "bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("cluster", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("cluster", "bucket").orderBy("member")
    return (
        placed.withColumn("rank", F.row_number().over(inside))
        .join(starts, ["cluster", "bucket"])
        .select("member", "cluster", (F.col("start") + F.col("rank") - 1).alias("position"))
    )


def order_by_cluster(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edges with the positions of both members in (cluster, member) order, dealt and sorted by them."""
    placed = private_stage(edges.sparkSession, "positions", lambda: cluster_positions(clusters))

    def side(k: int) -> DataFrame:
        return placed.select(
            F.col("member").alias(f"member_{k}"),
            F.col("cluster").alias(f"cluster_{k}"),
            F.col("position").alias(f"position_{k}"),
        )

    order = ["position_1", "position_2"]
    joined = edges.join(side(1), "member_1").join(side(2), "member_2")
    return joined.repartitionByRange(*order).sortWithinPartitions(*order)
