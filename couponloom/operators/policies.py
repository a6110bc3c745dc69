"""Baseline coupon policies and expected total revenue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from couponloom.functions.columns import expected_revenue
from couponloom.operators.facts import KEY
from couponloom.params import Params

POLICIES = ("zero", "random", "optimal")

RowsAt = Callable[[DataFrame], DataFrame]


def _draw(seed: int, slot: Column, below: Column) -> Column:
    """Uniform integer in [0, below), a function of seed, shopper and slot only."""
    text = F.concat_ws("-", F.lit(seed), F.col("shopper"), slot)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % below


def random_slots(slots: DataFrame, params: Params) -> DataFrame:
    """(shopper, week, coupon, product, discount): random coupons on the given slots.

    slots: (shopper, week, coupon), those of the optimal coupons or of the coupon index. A
    shopper gets as many random coupons as there are slots, on distinct products. These
    are drawn by the swap-in method: step j draws from 0..j and takes j itself when the
    draw is already taken. That needs one hash per coupon instead of one per shopper and
    product, and no shuffle.
    """
    n = F.least(F.greatest(F.lit(params.n_coupons), F.col("coupon") + 1), F.lit(params.n_products)).cast("int")
    steps = F.sequence(F.lit(params.n_products) - n, F.lit(params.n_products - 1))

    def add(chosen, j):
        drawn = _draw(params.seed, j, j + 1).cast("int")
        return F.array_append(chosen, F.when(F.array_contains(chosen, drawn), j).otherwise(drawn))

    products = F.aggregate(steps, F.array().cast("array<int>"), add)
    values = F.array(*[F.lit(d) for d in params.discounts])
    drawn = _draw(params.seed + 1, F.col("coupon"), F.lit(len(params.discounts)))
    return slots.filter(F.col("coupon").between(0, params.n_products - 1)).select(
        F.col("shopper").cast("long").alias("shopper"),
        F.col("week").cast("long").alias("week"),
        F.col("coupon").cast("long").alias("coupon"),
        F.element_at(products, (F.col("coupon") + 1).cast("int")).cast("long").alias("product"),
        F.element_at(values, (drawn + 1).cast("int")).alias("discount"),
    )


def zero_slots(slots: DataFrame, params: Params) -> DataFrame:
    """The coupons of the random policy without any discount."""
    return random_slots(slots, params).withColumn("discount", F.lit(0.0))


def on_products_of(policy: DataFrame, optimal: DataFrame) -> DataFrame:
    """Discounts of a policy placed slot by slot on the optimal products."""
    slots = policy.select("shopper", "coupon", "discount")
    return optimal.drop("discount").join(slots, ["shopper", "coupon"])


def policy_revenue(
    test: DataFrame,
    coupons: DataFrame,
    scorer,
    rows_at: RowsAt | None = None,
    keep_substitutes: bool = True,
) -> DataFrame:
    """(policy, total_revenue) of tagged coupons over all test rows.

    Every policy shares the revenue of the uncouponed rows, so the panel is scored once
    without discounts and each coupon adds the change it makes to its own row. Coupons
    carry a `policy` column. Rows keep their observed substitute discount, or have none,
    as in the what-if scenarios, without `keep_substitutes`. `rows_at` gives the test
    rows of the coupon keys; without it they are joined to all test rows.
    """
    fixed = {} if keep_substitutes else {"substitute_discount": F.lit(0.0)}
    none = {"p_none": {"discount": F.lit(0.0), **fixed}}
    base = scorer.score(test, none).agg(
        F.sum(expected_revenue(F.col("p_none"), F.col("price"), F.lit(0.0))).alias("revenue")
    )
    shared = base.select(F.explode(F.array(*[F.lit(p) for p in POLICIES])).alias("policy"), "revenue")
    offered = coupons.filter("discount != 0").select(
        *[F.col(c).cast("int") for c in KEY], "policy", F.col("discount").alias("offered")
    )
    rows = test.join(offered, KEY) if rows_at is None else rows_at(offered)
    scored = scorer.score(rows, {**none, "p_offer": {"discount": F.col("offered"), **fixed}})
    change = expected_revenue(F.col("p_offer"), F.col("price"), F.col("offered")) - expected_revenue(
        F.col("p_none"), F.col("price"), F.lit(0.0)
    )
    changes = scored.groupBy("policy").agg(F.sum(change).alias("revenue"))
    return shared.unionByName(changes).groupBy("policy").agg(F.sum("revenue").alias("total_revenue"))


def expected_total_revenue(
    test: DataFrame, coupons: DataFrame, scorer, rows_at: RowsAt | None = None
) -> DataFrame:
    """One-row total for a single coupon assignment."""
    tagged = coupons.withColumn("policy", F.lit("optimal"))
    totals = policy_revenue(test, tagged, scorer, rows_at)
    return totals.filter("policy = 'optimal'").select("total_revenue")


def compare_policies(
    test: DataFrame,
    optimal: DataFrame,
    scorer,
    params: Params,
    placement: str = "by_key",
    rows_at: RowsAt | None = None,
    slots: DataFrame | None = None,
) -> DataFrame:
    """Totals of zero, random and optimal coupons.

    Zero and random coupons fill the given slots of the test week, else those of the
    optimal ones.

    placement "by_key" gives each policy its own products; "same_products" places all
    discounts on the optimal products and so compares discounts only.
    """
    if placement not in ("by_key", "same_products"):
        raise ValueError(f"unknown placement: {placement}")
    given = optimal if slots is None else slots.filter(
        (F.col("week") == params.test_week) & F.col("shopper").between(0, params.n_shoppers - 1)
    )
    random, zero = random_slots(given, params), zero_slots(given, params)
    if placement == "same_products":
        random, zero = on_products_of(random, optimal), on_products_of(zero, optimal)
    tagged = [
        df.select("week", "shopper", "product", "discount", F.lit(name).alias("policy"))
        for name, df in zip(POLICIES, (zero, random, optimal))
    ]
    coupons = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    return policy_revenue(test, coupons, scorer, rows_at)
