"""Coupon redemption rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponloom.functions.columns import in_domain, ratio
from couponloom.functions.history import before, total
from couponloom.params import Params


def _before_training(data: DataFrame, params: Params) -> DataFrame:
    return data.filter(F.col("week") < params.start_week)


def redemption_rate(data: DataFrame, params: Params) -> DataFrame:
    """Share of offers that were redeemed per product, before the training weeks."""
    offers = _before_training(data, params).filter("discount > 0")
    return offers.groupBy("product").agg(F.avg("purchased").alias("redemption_rate"))


def customer_redemption_rate(data: DataFrame, params: Params) -> DataFrame:
    offers = _before_training(data, params).filter("discount > 0")
    return offers.groupBy("shopper", "product").agg(
        F.avg("purchased").alias("customer_redemption_rate")
    )


def coupon_share(data: DataFrame, params: Params) -> DataFrame:
    """Share of a pair's rows, before the training weeks, that carried an offer."""
    return (
        _before_training(data, params)
        .groupBy("shopper", "product")
        .agg(ratio(F.count_if(F.col("discount") > 0), F.count("*")).alias("discount_buy"))
    )


def _weighted(packed: DataFrame, params: Params) -> DataFrame:
    """Offers and redeemed offers per pair, weighted with the panel rows of the pair.

    A pair has one panel row per week, and more only where a key of the panel weeks is
    repeated, which its history tells.
    """
    weeks = params.panel_weeks

    def weighted(pair):
        product, history = pair["key"], pair["value"]
        more = F.aggregate(
            history, F.lit(0).cast("long"),
            lambda acc, h: acc + F.when(h["week"].between(min(weeks), max(weeks)), h["n_rows"] - 1).otherwise(0),
        )
        counted = before(history, F.lit(params.test_week)) if params.redemption_before_test_week else history
        return F.struct(
            product.alias("product"),
            (total(counted, "received") * (more + len(weeks))).alias("received"),
            (total(counted, "redeemed") * (more + len(weeks))).alias("redeemed"),
        )

    pairs = F.transform(F.map_entries("histories"), weighted)
    return packed.select("shopper", F.inline(pairs)).filter("received > 0")


def panel_redemption(
    packed: DataFrame, params: Params, by: str, products: int | None = None
) -> DataFrame:
    """Redeemed over received offers of all panel rows of a shopper or product.

    `packed` are the cells of the facts. The default rows of the panel add nothing to
    either sum, so the facts suffice.
    """
    values = params.n_shoppers if by == "shopper" else (products or params.n_products)
    rates = (
        _weighted(packed, params)
        .filter(in_domain(params, products))
        .groupBy(by)
        .agg(ratio(F.sum("redeemed"), F.sum("received")).alias(f"{by}_redemption_rate"))
    )
    every = packed.sparkSession.range(values).select(F.col("id").cast("int").alias(by))
    return every.join(rates, by, "left")
