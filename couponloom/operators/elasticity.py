"""Price elasticities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponloom.functions.columns import elasticity, exact_percent, ratio
from couponloom.operators.dims import join_dimension
from couponloom.operators.facts import baskets_coupons
from couponloom.operators.panel import dense_counts
from couponloom.params import Params, percent
from couponloom.sources.tables import Inputs


def weekly_elasticity(inputs: Inputs, params: Params) -> DataFrame:
    """Elasticity per product and week over all shoppers, dated one week later.

    Every product id is given for every week that has facts.
    """
    weeks = F.col("week").between(params.start_week - 1, params.test_week)
    joined = baskets_coupons(
        inputs.baskets.filter(weeks), inputs.coupons.filter(weeks), inputs.unique_keys
    )
    offered = F.coalesce("discount", F.lit(0.0))
    special = exact_percent(offered) == percent(params.elasticity_discount)
    counts = joined.groupBy("week", "product").agg(
        F.count_if(offered == 0).alias("regular_buys"),
        F.count_if(offered > 0).alias("offers"),
        F.count_if(special & (F.coalesce("price", F.lit(0.0)) != 0)).alias("special_buys"),
        F.count_if(special).alias("special_offers"),
    )
    known = counts.filter(F.col("product").between(0, params.n_products - 1))
    every = (
        counts.select("week")
        .distinct()
        .withColumn("product", F.explode(F.sequence(F.lit(0), F.lit(params.n_products - 1))))
    )
    filled = every.join(known, ["week", "product"], "left").fillna(0)
    regular = ratio("regular_buys", F.lit(params.total_baskets) - F.col("offers"))
    special_rate = ratio("special_buys", "special_offers")
    return filled.select(
        "product",
        (F.col("week") + 1).alias("week"),
        elasticity(special_rate, regular, params).alias("elast"),
    )


def product_elasticity(
    data: DataFrame, params: Params, products: int | None = None
) -> DataFrame:
    """Elasticity per product over the training rows of the panel."""
    counts = dense_counts(data, params, "product", params.train_weeks, products)
    special = F.col("percent") == percent(params.elasticity_discount)
    regular = F.col("percent") == 0

    def rate(rows):
        return ratio(F.sum(F.when(rows, F.col("purchases"))), F.sum(F.when(rows, F.col("n_rows"))))

    return counts.groupBy("product").agg(
        elasticity(rate(special), rate(regular), params).alias("elasticities")
    )


def attach_elasticity(
    panel: DataFrame, data: DataFrame, params: Params, products: int | None = None
) -> DataFrame:
    return join_dimension(
        panel,
        product_elasticity(data, params, products),
        ["product"],
        params.n_products,
        spread=["shopper", "week"],
    )
