"""Features of panel rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponloom.functions import history as H
from couponloom.functions.columns import exact_fraction, exact_units, product_category
from couponloom.operators.dims import join_dimension
from couponloom.operators.elasticity import attach_elasticity
from couponloom.operators.encode import woe
from couponloom.operators.panel import panel
from couponloom.operators.prices import impute_price
from couponloom.operators.rates import panel_redemption
from couponloom.params import Params

# Columns that are no features.
NON_FEATURES = ["shopper", "week", "product", "purchased", "product_cat"]


def with_category(df: DataFrame, params: Params) -> DataFrame:
    return df.withColumn("product_cat", product_category(params))


def with_substitute_discount(rows: DataFrame) -> DataFrame:
    """Discounts the shopper got in the same week for other products of the category.

    Only facts carry discounts, so the sum comes from the `offers` of the cell.
    """
    same_week = F.filter("offers", lambda o: o["week"] == F.col("week"))
    given = F.aggregate(same_week, F.lit(0).cast("long"), lambda acc, o: acc + exact_units(o["discount"]))
    others = exact_fraction(given - exact_units("discount"))
    return rows.withColumn("substitute_discount", F.when(F.col("product_cat").isNotNull(), others))


def cluster_dimension(df: DataFrame, params: Params) -> DataFrame:
    """(product_cat, cat_cluster): the fixed label of each category."""
    labels = list(enumerate(params.category_clusters))
    return df.sparkSession.createDataFrame(labels, "product_cat int, cat_cluster int")


def with_cluster(df: DataFrame, params: Params) -> DataFrame:
    """Inner join: rows without a category or with an unlabelled one leave."""
    return df.join(F.broadcast(cluster_dimension(df, params)), "product_cat")


def cluster_dummies(df: DataFrame) -> DataFrame:
    """Three fixed 0/1 columns, whichever labels occur."""
    dummies = {f"cluster_{k}": (F.col("cat_cluster") == k).cast("int") for k in range(3)}
    return df.withColumns(dummies).drop("cat_cluster")


def recency_default(data: DataFrame, params: Params) -> DataFrame:
    """One row: weeks since last purchase where there is none, from the last week of the panel.

    The panel is dense, so it ends with its last week whether that has facts or not.
    """
    inside = F.max(F.when(F.col("week").isin(params.panel_weeks), F.col("week")))
    latest = F.greatest(inside, F.lit(max(params.panel_weeks))) * F.lit(params.recency_factor)
    return data.agg(F.ceil(latest).cast("int").alias("recency_default"))


def look_back(params: Params) -> int:
    """Weeks before the panel that the features tell apart; of older ones they read sums and the latest purchase."""
    return max((0, *params.trend_windows))


def with_past(rows: DataFrame) -> DataFrame:
    """`past`: the history before the week of the row, which the time features read."""
    return rows.withColumn("past", H.before(F.col("history"), F.col("week")))


def with_recency(rows: DataFrame, params: Params) -> DataFrame:
    default = F.lit(params.recency_default)
    return rows.withColumn(
        "weeks_since_last_purchase",
        H.weeks_since_purchase(F.col("past"), F.col("week"), default),
    )


def with_trends(rows: DataFrame, params: Params) -> DataFrame:
    return rows.withColumns({
        f"trend_{w}": H.trend(F.col("past"), F.col("week"), F.lit(w)) for w in params.trend_windows
    })


def with_product_frequency(rows: DataFrame) -> DataFrame:
    """Purchases before the week per elapsed week, null in week 0."""
    return rows.withColumn("product_freq", H.trend(F.col("past"), F.col("week"), F.col("week")))


def with_running_rates(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "shopper_product_redemption_rate": H.redemption_rate(F.col("past")),
        "discount_buy": H.offers_per_purchase(F.col("past")),
    })


def _value_dimension(
    data: DataFrame, packed: DataFrame, params: Params, by: str, encoded: bool
) -> DataFrame:
    """Per shopper or product: redemption rate, and weight of evidence when encoded."""
    rates = panel_redemption(packed, params, by, params.model_products)
    if not encoded:
        return rates
    return rates.join(woe(data, params, by, params.model_products), by, "left")


def dataset(
    data: DataFrame, params: Params, packed: DataFrame | None = None, weeks: list[int] | None = None
) -> DataFrame:
    """Panel with histories and imputed prices, before any feature."""
    weeks = weeks or params.panel_weeks
    return impute_price(panel(data, params, weeks, packed=packed), data, params, weeks)


def model_data(
    data: DataFrame,
    packed: DataFrame,
    params: Params,
    weeks: list[int] | None = None,
    encoded: bool = False,
    only: DataFrame | None = None,
) -> DataFrame:
    """Panel rows of categorised products with every feature.

    `packed` are the cells of the facts; both are read several times, so both should be
    written tables. `encoded` adds the weight of evidence of shopper and product, and
    `only` restricts the rows to given keys.
    """
    weeks = weeks or params.panel_weeks
    rows = panel(
        data,
        params,
        weeks,
        params.model_products,
        by_shopper=_value_dimension(data, packed, params, "shopper", encoded),
        packed=packed,
        only=only,
        look_back=look_back(params),
    )
    rows = impute_price(rows, data, params, weeks)
    rows = with_substitute_discount(with_category(rows, params))
    rows = cluster_dummies(with_cluster(rows, params))
    rows = with_recency(with_past(rows), params)
    rows = with_running_rates(with_product_frequency(with_trends(rows, params)))
    rows = rows.drop("history", "offers", "past")
    rows = join_dimension(
        rows,
        _value_dimension(data, packed, params, "product", encoded),
        ["product"],
        params.model_products,
        spread=["shopper", "week"],
    )
    return attach_elasticity(rows, data, params, params.model_products)


def feature_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NON_FEATURES]
