"""Week histories of shopper-product pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from couponloom.functions import history as H
from couponloom.functions.columns import product_block
from couponloom.operators.facts import week_counts, week_sums
from couponloom.params import Params


def pair_histories(data: DataFrame) -> DataFrame:
    """(shopper, product, history); see functions.history for the layout."""
    entry = F.struct("week", "purchased", "received", "redeemed")
    return (
        week_counts(data)
        .groupBy("shopper", "product")
        .agg(F.sort_array(F.collect_list(entry)).alias("history"))
    )


def _weeks(data: DataFrame, count: str, name: str) -> DataFrame:
    return (
        pair_histories(data)
        .select(
            "shopper",
            "product",
            H.weeks_with(F.col("history"), count).alias(name),
            H.total(F.col("history"), count).alias("n"),
        )
        .filter("n > 0")
    )


def purchase_weeks(data: DataFrame) -> DataFrame:
    return _weeks(data.filter("purchased = 1"), "purchased", "week_hist")


def received_weeks(data: DataFrame) -> DataFrame:
    return _weeks(data.filter("discount != 0"), "received", "discount_received_weeks")


def redeemed_weeks(data: DataFrame) -> DataFrame:
    return _weeks(
        data.filter("purchased = 1 AND discount != 0"), "redeemed", "discount_redeemed_weeks"
    )


def _shortened_counts(data: DataFrame, cut: int) -> DataFrame:
    """Counts by week with those of the weeks from 0 to before the cut in one row, as in H.shortened."""
    old = F.coalesce(F.col("week").between(0, cut - 1), F.lit(False))
    bought = F.when(F.col("old") & (F.col("purchased") == 1), F.col("week"))
    marked = data.withColumn("old", old).withColumn("bought", bought)
    latest = F.max("bought").alias("latest")
    place = F.when(~F.col("old"), F.col("week")).alias("place")
    counts = marked.groupBy("shopper", "product", "old", place).agg(latest, *week_sums())
    week = F.when(F.col("old"), F.coalesce("latest", F.lit(0))).otherwise(F.col("place"))
    return counts.withColumn("week", week).withColumn("discount", F.when(F.col("old"), 0.0).otherwise(F.col("discount")))


def cells(
    data: DataFrame, params: Params, observation: Observation | None = None, cut: int | None = None
) -> DataFrame:
    """(shopper, block, histories, offers): facts packed per shopper and block of products.

    `histories` maps a product to its week entries, see functions.history, so a row finds its own by
    one look-up; `offers` are the entries of the block that carry a discount. Both hold one entry per
    product and week at most, so a cell is bounded by category size x weeks whatever the number of
    facts. Written once, cells serve the panel and the redemption rates without another pass over the
    facts. Facts without a product are in no cell. An `observation` gets `most`, the rows of the most
    repeated key, from the counts that are made anyway. With a `cut` histories are shortened as by
    H.shortened, before they are packed, and `offers` are those of other weeks.
    """
    known = data.filter("product IS NOT NULL")
    counts = week_counts(known) if cut is None or cut <= 0 else _shortened_counts(known, cut)
    counts = counts.withColumn("block", product_block(params))
    if observation is not None:
        counts = counts.observe(observation, F.max("n_rows").alias("most"))
    entry = F.struct("week", "n_rows", "purchased", "received", "redeemed", "discount")
    offer = F.when(F.col("discount") != 0, F.struct("week", "discount"))
    # Dealt by cell once: neither aggregation below shuffles again.
    pairs = (
        counts.repartition("shopper", "block")
        .groupBy("shopper", "block", "product")
        .agg(F.sort_array(F.collect_list(entry)).alias("history"), F.sort_array(F.collect_list(offer)).alias("offers"))
    )
    return pairs.groupBy("shopper", "block").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("product", "history")))).alias("histories"),
        F.sort_array(F.flatten(F.collect_list("offers"))).alias("offers"),
    )
