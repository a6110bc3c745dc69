"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponloom.workspace import private_stage


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _smallest(links: DataFrame) -> DataFrame:
    """Smallest neighbour of each node, written so that a join with it can split hot nodes."""
    spark = links.sparkSession
    return private_stage(spark, "smallest", lambda: links.groupBy("a").agg(F.min("b").alias("m")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node that is not the smallest of its component.

    links: (a, b), both long, in either direction. Each round writes its links to the shared
    folder; rounds end when no link changes. A node of many links is only ever aggregated or
    joined, never gathered. No links give no rows.
    """
    spark = links.sparkSession
    held = private_stage(
        spark, "links",
        lambda: links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
    )
    before = _digest(held)
    while before[0]:
        current = held
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _smallest(both).select("a", F.least("a", "m").alias("m"))
        large = private_stage(
            spark, "large", lambda: both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        least = _smallest(large)
        held = private_stage(
            spark, "links",
            lambda: large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct(),
        )
        now = _digest(held)
        if now == before:
            break
        before = now
    return held.select(F.col("a").alias("node"), F.col("b").alias("root"))
