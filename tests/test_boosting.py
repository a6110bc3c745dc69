"""Trees on binned rows against Spark's own and against walks and counts by hand."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from couponloom.operators.allocation import top_coupons
from couponloom.operators.boosting import Bins, Split, Tree, _between, _positions, thresholds
from couponloom.operators.policies import compare_policies
from couponloom.operators.scoring import TreeScorer
from couponloom.params import Params


def training_rows(spark, n: int):
    """Features with few values, many values, nulls and no values; purchases follow three of them."""
    draw = lambda k: F.xxhash64("id", F.lit(k)) % 1000 / 1000.0
    rows = spark.range(n).select(
        F.lit(1).alias("week"), F.col("id").cast("int").alias("shopper"), F.lit(0).alias("product"),
        F.when(draw(1) > -0.9, F.round(draw(1) * 40, 1)).alias("price"),
        (F.abs(F.xxhash64("id", F.lit(2))) % 4 * 0.1).alias("discount"),
        draw(3).alias("shopper_WOE"),
        (F.xxhash64("id", F.lit(4)) % 3).cast("int").alias("trend_1"),
        F.lit(0.0).alias("cluster_0"),
        draw(5).alias("noise"),
    )
    chance = F.col("discount") * 2 + F.coalesce("price", F.lit(60.0)) / 100 + F.col("shopper_WOE") * F.col("trend_1") / 4
    return rows.withColumn("purchased", (chance + F.col("noise") > 0.9).cast("int")).drop("noise")


def probabilities(scorer, rows, overrides=None) -> np.ndarray:
    scored = scorer.score(rows, {"p": overrides or {}}).orderBy("shopper").select("p").toPandas()
    return scored["p"].to_numpy()


def test_binned_trees_equal_those_of_spark(spark):
    train = training_rows(spark, 6_000).repartition(3).cache()
    one = TreeScorer(train, iterations=12, depth=4)
    two = TreeScorer(train, iterations=12, depth=4, spark_rows=0)
    assert one.trees is None and two.model is None
    first, second = probabilities(one, train), probabilities(two, train)
    assert len(np.unique(first.round(9))) > 50
    assert np.allclose(first, second, atol=1e-8)
    offer = {"discount": F.lit(0.2), "price": F.lit(None).cast("double")}
    assert np.allclose(probabilities(one, train, offer), probabilities(two, train, offer), atol=1e-8)
    assert two.score(train, {"a": {}, "b": offer}).columns == [*train.columns, "a", "b"]


def test_many_rows_give_the_same_trees_however_they_are_dealt(spark):
    train = training_rows(spark, 25_000).withColumn("rare", F.col("shopper").isin(7, 4_321, 20_000).cast("double"))
    train = train.withColumn("purchased", F.when(F.col("rare") == 1, 1 - F.col("purchased")).otherwise(F.col("purchased")))
    few, many = (TreeScorer(train.repartition(n, "shopper"), 3, 5, spark_rows=24_999) for n in (1, 7))
    assert few.model is None and many.model is None
    assert np.array_equal(probabilities(few, train), probabilities(many, train))
    # A value of three rows in 25,000 has a threshold of its own: no sample is taken.
    assert [0.5] in [list(t) for t in few.trees.bins.thresholds]


def test_deep_trees_and_few_rows_stay_with_spark(spark):
    train = training_rows(spark, 300)
    assert TreeScorer(train, 1, 7, spark_rows=0).trees is None
    assert TreeScorer(train, 1, 2, spark_rows=300).trees is None


def test_thresholds_of_few_and_many_values(spark):
    rows = spark.range(64_000).select(
        (F.col("id") % 3).cast("double").alias("a"), F.col("id").cast("double").alias("b"), F.lit(2.0).alias("c")
    )
    n, (a, b, c) = thresholds(rows, ["a", "b", "c"])
    assert n == 64_000 and list(a) == [0.5, 1.5] and list(c) == []
    assert np.allclose(b, [2_000 * k for k in range(1, 32)], atol=64_000 / 10_000 + 1)
    _, counted = thresholds(rows, ["b"], most_values=64_000)
    assert np.array_equal(counted[0], [2_000 * k - 0.5 for k in range(1, 32)])
    assert list(_between(np.array([1.0, 2.0, 4.0]), np.array([8, 1, 1]), 2)) == [1.5]
    with pytest.raises(ValueError):
        thresholds(rows.limit(0), ["a"])


def test_positions_equal_a_walk_down_the_tree():
    rng = np.random.default_rng(5)
    bins = Bins(tuple(np.arange(n) + 0.5 for n in (31, 3, 0, 30, 7, 1, 25)))
    assert sorted(f for b in bins.bundles for f in b) == [0, 1, 3, 4, 5, 6] and len(bins.bundles) > 1
    values = [rng.integers(0, 33, 500).astype(float) for _ in bins.thresholds]
    for depth in (1, 3, 5, 6):
        splits, open_ = [], [1]
        for node in open_:
            if node < 1 << depth and (node == 1 or rng.random() < 0.7):
                f = int(rng.choice([0, 1, 3, 4, 5, 6]))
                splits.append(Split(node, f, int(rng.integers(len(bins.thresholds[f])))))
                open_ += [2 * node, 2 * node + 1]
        at = {s.node: s for s in splits}
        got = _positions(Tree(depth, tuple(splits), np.zeros(1 << depth)).masks(bins), bins.encode(values))
        for i in range(500):
            node = 1
            while node in at:
                s = at[node]
                node = 2 * node + int(values[s.feature][i] > bins.thresholds[s.feature][s.bin])
            level = node.bit_length() - 1
            assert got[i] == (node - (1 << level)) << (depth - level)


def test_odd_training_rows(spark):
    train = training_rows(spark, 200)
    constant = train.select("week", "shopper", "product", "purchased", F.lit(1.0).alias("price"))
    mean = constant.agg(F.avg("purchased")).first()[0]
    p = probabilities(TreeScorer(constant, 1, 3, spark_rows=0), constant)
    assert np.allclose(p, 1 / (1 + np.exp(-2 * (2 * mean - 1))))
    for wrong in (train.withColumn("price", F.lit(float("nan"))), train.withColumn("purchased", F.lit(2))):
        with pytest.raises(Exception, match="not a number|neither 0 nor 1"):
            TreeScorer(wrong, 1, 2, spark_rows=0)


def test_repeated_training_rows_count_and_are_all_scored(spark):
    train = training_rows(spark, 2_000)
    twice = train.unionByName(train).cache()
    scored = TreeScorer(twice, 4, 3, spark_rows=0).score(twice, {"probability": {}})
    found = scored.groupBy("shopper").agg(F.count("*").alias("n"), F.count_distinct("probability").alias("p"))
    assert found.filter("n = 2 AND p = 1").count() == found.count() == 2_000
    expected = TreeScorer(twice, 4, 3).score(twice, {"probability": {}})
    one, two = (d.orderBy("shopper").toPandas()["probability"].to_numpy() for d in (scored, expected))
    assert np.allclose(one, two, atol=1e-8)


def test_coupons_of_binned_trees_equal_those_of_spark(spark):
    rows = training_rows(spark, 3_000).withColumns({
        "product": (F.col("shopper") % 10).cast("int"),
        "shopper": F.expr("shopper div 10").cast("int"),
        "substitute_discount": F.lit(0.0),
        "product_cat": (F.col("shopper") % 10 % 3).cast("int"),
    }).cache()
    params = Params(test_week=1, n_shoppers=300, n_products=10, n_coupons=2)
    scorers = [TreeScorer(rows, 4, 4, spark_rows=n) for n in (0, 3_000)]
    one, two = (sorted(map(tuple, top_coupons(rows, s, params).collect())) for s in scorers)
    assert one == two and len(one) == 600
    chosen = top_coupons(rows, scorers[1], params).cache()
    totals = [{r.policy: r.total_revenue for r in compare_policies(rows, chosen, s, params).collect()} for s in scorers]
    assert totals[0] == pytest.approx(totals[1]) and len(totals[0]) == 3
