"""Purchases joined with offers, cleaned."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from couponloom.functions.columns import exact_fraction, exact_units, shelf_price
from couponloom.params import Params
from couponloom.sources.tables import Inputs

KEY = ["week", "shopper", "product"]


def filter_shoppers(df: DataFrame, params: Params) -> DataFrame:
    return df.filter(F.col("shopper") < params.n_shoppers)


def baskets_coupons(
    baskets: DataFrame, coupons: DataFrame, unique_keys: bool = False
) -> DataFrame:
    """Full outer join on the key; repeated keys fan out.

    Spark cannot split a hot key of a full outer join, so unless the keys of both sides
    are known to be unique it is written as matches plus both unmatched sides: adaptive
    execution splits a hot key on either side of the inner join and on the left of the
    anti joins, whose right sides are distinct keys.
    """
    if unique_keys:
        return baskets.join(coupons, KEY, "full")
    matched = baskets.join(coupons, KEY)
    only_bought = baskets.join(coupons.select(*KEY).distinct(), KEY, "left_anti")
    only_offered = coupons.join(baskets.select(*KEY).distinct(), KEY, "left_anti")
    return matched.unionByName(only_bought, allowMissingColumns=True).unionByName(
        only_offered, allowMissingColumns=True
    )


def clean(joined: DataFrame) -> DataFrame:
    """Discount as fraction, price before the discount, purchase flag."""
    return joined.select(
        *KEY,
        (F.coalesce("discount", F.lit(0.0)) / F.lit(100.0)).alias("discount"),
        F.col("price").alias("paid"),
    ).select(
        *KEY,
        shelf_price("paid", "discount").alias("price"),
        "discount",
        F.col("paid").isNotNull().cast("int").alias("purchased"),
    )


def facts(inputs: Inputs, params: Params) -> DataFrame:
    """Cleaned facts of the first shoppers; the filter reaches both scans."""
    baskets, coupons = (filter_shoppers(df, params) for df in (inputs.baskets, inputs.coupons))
    return clean(baskets_coupons(baskets, coupons, inputs.unique_keys))


def input_weeks(inputs: Inputs) -> list[int | None]:
    """Weeks of both tables, ascending, None first where rows have no week."""
    found = inputs.baskets.select("week").union(inputs.coupons.select("week")).distinct().collect()
    return sorted((r["week"] for r in found), key=lambda w: (w is not None, w))


def in_weeks(inputs: Inputs, weeks: list[int | None]) -> Inputs:
    """The inputs' rows of some weeks; a fact is made of rows of one week."""
    known = F.col("week").isin([w for w in weeks if w is not None])
    wanted = known | F.col("week").isNull() if None in weeks else known
    return replace(inputs, baskets=inputs.baskets.filter(wanted), coupons=inputs.coupons.filter(wanted))


def facts_fingerprint(params: Params, source: str) -> str:
    """Facts depend on the number of shoppers and on no week."""
    return Params(n_shoppers=params.n_shoppers).fingerprint("facts", source)


def duplicate_keys(df: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*(key or KEY)).agg(F.count("*").alias("n")).filter("n > 1")


def week_sums() -> list[Column]:
    """Rows, purchases, offers, redeemed offers and discount sum of facts."""
    offered = F.col("discount") != 0
    bought = F.col("purchased") == 1
    return [
        F.count("*").alias("n_rows"),
        F.sum(F.col("purchased").cast("long")).alias("purchased"),
        F.count_if(offered).alias("received"),
        F.count_if(offered & bought).alias("redeemed"),
        exact_fraction(F.sum(exact_units("discount"))).alias("discount"),
    ]


def week_counts(data: DataFrame) -> DataFrame:
    """Sums per key, see week_sums.

    The partial aggregation runs before the shuffle, so a hot key arrives as one row
    per map task.
    """
    return data.groupBy(*KEY).agg(*week_sums())
