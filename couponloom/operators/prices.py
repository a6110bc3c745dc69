"""Mode price of the previous week and price imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponloom.operators.dims import join_dimension
from couponloom.params import Params


def mode_price(data: DataFrame, params: Params) -> DataFrame:
    """Most frequent shelf price per (product, week), the lowest on ties.

    Prices are counted first with partial aggregation, so a hot product reaches the
    second step as one row per distinct price.
    """
    price = F.round("price", params.price_scale)
    counted = data.groupBy("product", "week", price.alias("price")).agg(F.count("*").alias("n"))
    best = F.max(F.when(F.col("price").isNotNull(), F.struct("n", (-F.col("price")).alias("minus"))))
    return counted.groupBy("product", "week").agg((-best["minus"]).alias("mode_price"))


def last_week_mode_price(data: DataFrame, params: Params) -> DataFrame:
    """Mode price moved to the week after; it is not carried any further."""
    return mode_price(data, params).select(
        "product", (F.col("week") + 1).alias("week"), F.col("mode_price").alias("last_week_mode_price")
    )


def impute_price(panel: DataFrame, data: DataFrame, params: Params, weeks: list[int]) -> DataFrame:
    """Missing panel prices become the mode price of the week before."""
    inside = F.col("week").between(min(weeks) - 1, max(weeks) - 1) & F.col("product").between(
        0, params.n_products - 1
    )
    dim = last_week_mode_price(data.filter(inside), params)
    joined = join_dimension(
        panel, dim, ["product", "week"], params.n_products * len(weeks), spread=["shopper"]
    )
    return joined.withColumn("price", F.coalesce("price", "last_week_mode_price")).drop(
        "last_week_mode_price"
    )
