"""Inputs, cleaning, rates, narrowing and staged tables on hand-made rows."""

import math
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from couponloom.operators import dims
from couponloom.operators.dims import join_dimension
from couponloom.operators.elasticity import weekly_elasticity
from couponloom.operators.facts import baskets_coupons, clean, duplicate_keys, facts, week_counts
from couponloom.operators.narrow import narrow, profile
from couponloom.operators.rates import coupon_share, customer_redemption_rate, redemption_rate
from couponloom.operators.scoring import RateScorer, purchase_rates
from couponloom.params import Params
from couponloom.sources import star
from couponloom.sources.tables import (
    COUPON_INDEX,
    read_coupons,
    read_inputs,
    write_coupons,
)
from couponloom.workspace import shared_folder, stage
from dataclasses import replace
from tests.helpers import SMALL, inputs, random_rows, rows

KEY = ["week", "shopper", "product"]


def test_clean_of_purchase_offer_and_both(spark):
    given = inputs(spark, [(1, 0, 1, 8.0), (1, 0, 2, 5.0)], [(1, 0, 1, 20.0), (1, 0, 3, 30.0), (1, 0, 2, 100.0)])
    got = {r["product"]: r for r in clean(baskets_coupons(given.baskets, given.coupons)).collect()}
    assert got[1].price == 10.0 and got[1].discount == 0.2 and got[1].purchased == 1
    assert got[2].price is None and got[2].purchased == 1  # the whole price as discount
    assert got[3].price is None and got[3].purchased == 0 and got[3].discount == 0.3


def test_repeated_keys_fan_out_and_are_reported(spark):
    given = inputs(spark, [(1, 0, 1, 8.0), (1, 0, 1, 9.0)], [(1, 0, 1, 20.0), (1, 0, 1, 30.0)])
    data = facts(given, SMALL)
    assert data.count() == 4
    assert [r.n for r in duplicate_keys(data).collect()] == [4]


def test_rates_use_weeks_before_training_only(spark):
    given = inputs(
        spark,
        [(1, 0, 1, 8.0), (2, 0, 1, 8.0), (5, 0, 1, 8.0)],
        [(1, 0, 1, 20.0), (3, 0, 1, 20.0), (3, 1, 1, 20.0), (5, 1, 1, 30.0)],
    )
    data = facts(given, SMALL)
    assert [tuple(r) for r in redemption_rate(data, SMALL).collect()] == [(1, 1 / 3)]
    pairs = {r.shopper: r.customer_redemption_rate for r in customer_redemption_rate(data, SMALL).collect()}
    assert pairs == {0: 0.5, 1: 0.0}
    share = {r.shopper: r.discount_buy for r in coupon_share(data, SMALL).collect()}
    assert share == pytest.approx({0: 2 / 3, 1: 1.0})


def test_weekly_elasticity_emits_every_product_and_null_without_evidence(spark):
    given = inputs(
        spark,
        [(4, 0, 1, 8.0), (4, 9, 1, 8.0), (4, 1, 1, 7.0)],
        [(4, 1, 1, 30.0), (4, 2, 1, 30.0), (4, 3, 1, 15.0)],
    )
    got = {(r.week, r["product"]): r.elast for r in weekly_elasticity(given, SMALL).collect()}
    assert len(got) == 25 and {w for w, _ in got} == {5}
    regular = 2 / (100 - 3)  # shoppers beyond the configured ones count too
    assert got[5, 1] == pytest.approx((0.5 - regular) / (0.3 * regular))
    assert got[5, 2] is None


def test_profile_and_narrow_use_exclusive_bounds(spark):
    df = spark.createDataFrame(
        [(0, 127, 40000, 1.5, "a"), (126, -5, 1, 2.5, "b")], "a long, b long, c long, d double, e string"
    )
    types = dict(narrow(df).dtypes)
    assert types == {"a": "tinyint", "b": "smallint", "c": "int", "d": "float", "e": "string"}
    bounds = {r.column_name: (r.min_value, r.max_value) for r in profile(df).collect()}
    assert bounds == {"a": (0, 126), "b": (-5, 127), "c": (1, 40000), "d": (1.5, 2.5)}
    assert narrow(df.limit(0)).dtypes == df.dtypes


def test_nan_is_null_and_slot_column_is_not_read(spark, tmp_path):
    spark.createDataFrame([(1, 0, 1, float("nan")), (1, 0, 2, 3.0)], "week long, shopper long, product long, price double").write.parquet(f"{tmp_path}/baskets.parquet")
    spark.createDataFrame([(1, 0, 0, 1, 20)], "week int, shopper int, coupon int, product int, discount int").write.parquet(f"{tmp_path}/coupons.parquet")
    spark.createDataFrame([(0, 6, 0)], "shopper int, week int, coupon int").write.parquet(f"{tmp_path}/coupon_index.parquet")
    got = read_inputs(spark, str(tmp_path))
    assert {r["product"]: r.price for r in got.baskets.collect()} == {1: None, 2: 3.0}
    assert got.coupons.columns == [*KEY, "discount"]
    assert got.coupon_index.schema == COUPON_INDEX
    assert read_inputs(spark, str(tmp_path), coupon_index=None).coupon_index is None


def test_coupon_sink_has_fixed_types(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 0.15, 3, 0)], "product int, shopper int, discount double, week int, coupon int")
    write_coupons(df, f"{tmp_path}/out")
    back = read_coupons(spark, f"{tmp_path}/out")
    assert [tuple(r) for r in back.collect()] == [(2, 3, 0, 1, 0.15)]
    assert [t for _, t in back.dtypes] == ["bigint"] * 4 + ["double"]


def test_stage_is_read_through_and_keyed_by_fingerprint(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for key in ("a", "a", "b"):
        assert stage(spark, "numbers", key, build, str(tmp_path)).count() == 3
    assert len(calls) == 2
    assert Params().fingerprint("x") != Params(test_week=89).fingerprint("x")
    assert Params().fingerprint("x") != Params().fingerprint("y")


class FakeSession:
    """The two settings that decide about the shared folder."""

    def __init__(self, master, folder=None):
        self.conf = {} if folder is None else {"spark.checkpoint.dir": folder}
        self.sparkContext = SimpleNamespace(master=master, applicationId=f"app-{master}")


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_folder(spark) == named.rstrip("/")
    assert shared_folder(FakeSession("yarn", "hdfs:///shared/")) == "hdfs:///shared"


def test_temporary_folder_only_in_local_mode():
    local = FakeSession("local[4]")
    assert shared_folder(local) == shared_folder(local)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_folder(FakeSession(master))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_dimension_beyond_the_bound_is_salted_and_exact(spark, monkeypatch, how):
    # a third of the rows share key 0
    df = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    dim = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = sorted(map(tuple, join_dimension(df, dim, ["k"], 40, how).select("id", "k", "v").collect()))
    monkeypatch.setattr(dims, "BROADCAST_ROWS", 10)
    salted = join_dimension(df, dim, ["k"], 40, how, spread=["id"])
    assert "salt" in salted._jdf.queryExecution().toString() and "salt" not in salted.columns
    assert sorted(map(tuple, salted.select("id", "k", "v").collect())) == want


def test_parameters():
    p = Params()
    assert (p.start_week, p.panel_weeks[-1], p.recency_default) == (86, 90, 104)
    assert (p.n_categories, p.model_products, p.percents) == (25, 250, [15, 20, 25, 30])
    assert replace(p, n_products=95).model_products == 90
    assert replace(p, n_products=400).model_products == 250
    assert math.isclose(sum(p.discounts), 0.9)


@pytest.mark.parametrize("seed", [1, 2])
def test_split_join_equals_the_full_outer_join(spark, seed):
    given = inputs(spark, *random_rows(seed, repeats=3))
    columns = [*KEY, "price", "discount"]
    split, full = (
        baskets_coupons(given.baskets, given.coupons, unique).toPandas() for unique in (False, True)
    )
    assert rows(split, columns) == rows(full, columns)
    assert split.price.isna().any() and split.discount.isna().any()


def test_no_full_outer_join_of_keys_that_may_be_hot(spark):
    given = inputs(spark, *random_rows(1))
    text = facts(given, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in text and "LeftAnti" in text


def test_fractional_percents_are_not_whole_ones(spark):
    """29.6 is not the 30 percent offer, and 12.5 has a rate of its own."""
    baskets = [(w, s, 0, 10.0) for w in (4, 5) for s in range(3)]
    coupons = [(4, 0, 0, 29.6), (4, 1, 0, 30.0), (5, 0, 0, 12.5), (5, 1, 0, 12.0), (5, 2, 0, 13.0)]
    given = inputs(spark, baskets, coupons)
    data = facts(given, SMALL)
    rates = {r.percent for r in purchase_rates(data, SMALL).filter("product = 0").collect()}
    assert {0.0, 12.0, 12.5, 13.0, 29.6, 30.0} == rates
    scored = RateScorer(data, SMALL).score(
        spark.createDataFrame([(0, 0.125), (0, 0.13)], "product int, discount double"), {"p": {}}
    )
    assert {r.discount: r.p for r in scored.collect()} == {0.125: 2 / 3, 0.13: 2 / 3}
    weekly = {r.week: r for r in weekly_elasticity(given, SMALL).filter("product = 0").collect()}
    one = weekly_elasticity(inputs(spark, baskets, [c for c in coupons if c[3] == 30.0]), SMALL)
    assert weekly[5].elast is not None and one.filter("product = 0 and week = 5").first().elast is not None


def test_sums_of_discounts_do_not_depend_on_their_order(spark):
    rows = [(1, 0, 0, d, 0) for d in (0.1, 0.2, 0.3, 0.15, 0.15)]
    frame = spark.createDataFrame(rows, "week int, shopper int, product int, discount double, purchased int")
    for parts in (1, 3):
        assert week_counts(frame.repartition(parts)).first().discount == 0.9
    assert week_counts(frame.orderBy(F.desc("discount"))).first().discount == 0.9


def test_shuffles_of_lines_get_more_partitions_with_more_lines(spark, monkeypatch):
    data = "/root/testdata/sf0.001"
    want = sorted(map(tuple, star.observations(spark, data, 10).collect()))
    assert star.line_tasks(star.LINES_PER_TASK * 3, 8) is None
    assert star.line_tasks(star.LINES_PER_TASK * 30 + 1, 8) == 31
    monkeypatch.setattr(star, "LINES_PER_TASK", 100)
    dealt = star.observations(spark, data, 10)
    assert sorted(map(tuple, dealt.collect())) == want
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
