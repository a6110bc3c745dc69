"""What-if discounts, revenue deltas and the best coupons per shopper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from couponloom.functions.columns import expected_revenue
from couponloom.params import Params


def _values(params: Params) -> list[float]:
    return [0.0, *params.discounts]


def _overrides(discount: float | Column) -> dict[str, Column]:
    """A what-if row offers this one discount and none for the substitutes."""
    value = discount if isinstance(discount, Column) else F.lit(discount)
    return {"discount": value, "substitute_discount": F.lit(0.0)}


def scenarios(test: DataFrame, params: Params) -> DataFrame:
    """Each test row once per what-if discount, opened inside its task."""
    values = F.array(*[F.lit(v) for v in _values(params)])
    rest = [c for c in test.columns if c not in ("discount", "substitute_discount")]
    return test.select(
        *rest, F.lit(0.0).alias("substitute_discount"), F.explode(values).alias("discount")
    )


def _priced(test: DataFrame, scorer, params: Params) -> tuple[DataFrame, list[Column]]:
    """Rows with one probability per scenario, and the scenario structs over them."""
    values = _values(params)
    names = [f"p_{i}" for i in range(len(values))]
    scored = scorer.score(test, {n: _overrides(v) for n, v in zip(names, values)})
    revenue = [expected_revenue(F.col(n), F.col("price"), F.lit(v)) for n, v in zip(names, values)]
    structs = [
        F.struct(
            F.lit(v).alias("discount"),
            F.col(n).alias("probability"),
            r.alias("exp_revenue"),
            (r - revenue[0] if v else F.lit(None).cast("double")).alias("delta_revenue"),
        )
        for n, v, r in zip(names, values, revenue)
    ]
    return scored, structs


def delta_revenue(test: DataFrame, scorer, params: Params) -> DataFrame:
    """Expected revenue of each scenario and its gain over the zero discount."""
    scored, structs = _priced(test, scorer, params)
    return scored.select(
        "week", "shopper", "product", "price", "product_cat", F.explode(F.array(*structs)).alias("s")
    ).select("week", "shopper", "product", "price", "product_cat", "s.*")


def _ranked(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """First n rows per group by gain; ties go to the lower product, then discount."""
    order = [F.col("delta_revenue").desc_nulls_last(), F.col("product"), F.col("discount")]
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(
        F.col("rank") <= n
    )


def top_coupons(test: DataFrame, scorer, params: Params) -> DataFrame:
    """Best coupons per shopper, at most one per category.

    A product has one category, so taking the best row of each (shopper, category) and
    then the first n of those is the greedy choice. The best discount of a product is
    picked inside the row, and both ranks cut down to their limit before the shuffle.
    """
    scored, structs = _priced(test, scorer, params)
    offers = [
        F.struct(s["delta_revenue"].alias("delta"), (-s["discount"]).alias("minus"))
        for s in structs[1:]
    ]
    best = F.array_max(F.array(*offers))
    candidates = scored.select(
        "week", "shopper", "product", "product_cat", best.alias("best")
    ).select(
        "week",
        "shopper",
        "product",
        "product_cat",
        F.col("best.delta").alias("delta_revenue"),
        (-F.col("best.minus")).alias("discount"),
    )
    per_category = _ranked(candidates, ["shopper", "product_cat"], 1).drop("rank")
    chosen = _ranked(per_category, ["shopper"], params.n_coupons)
    return chosen.select(
        F.col("shopper").cast("long"),
        F.col("week").cast("long"),
        (F.col("rank") - 1).cast("long").alias("coupon"),
        F.col("product").cast("long"),
        F.col("discount").cast("double"),
    )
