"""Sparse formulations against the dense panel built by brute force."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from couponloom.functions import history as H
from couponloom.operators import panel as panel_module
from couponloom.operators.elasticity import product_elasticity
from couponloom.operators.encode import woe
from couponloom.operators.features import (
    cluster_dummies,
    look_back,
    model_data,
    with_category,
    with_cluster,
    with_past,
    with_product_frequency,
    with_recency,
    with_running_rates,
    with_substitute_discount,
    with_trends,
)
from couponloom.operators.histories import cells
from couponloom.operators.panel import dense_counts, grid, panel
from couponloom.operators.prices import impute_price, mode_price
from couponloom.operators.rates import panel_redemption
from dataclasses import replace
from couponloom.operators.facts import facts
from tests.helpers import SMALL, dense, frames, inputs, random_rows, rows

KEY = ["week", "shopper", "product"]
SEEDS = [1, 2, 3]


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("with_history", [True, False])
def test_panel_is_grid_left_join_facts_with_repeated_keys(spark, seed, with_history):
    data, data_pd = frames(spark, seed)
    want = dense(data_pd, SMALL)
    assert data_pd.duplicated(KEY).any()
    got = panel(data, SMALL, with_history=with_history).toPandas()
    columns = [*KEY, "price", "discount", "purchased"]
    assert rows(got, columns) == rows(want, columns)


def test_grid_is_the_whole_product(spark):
    got = grid(spark, SMALL).toPandas()
    assert len(got) == 3 * 3 * 25 and not got.duplicated().any()
    assert set(got.week) == {4, 5, 6} and got["product"].max() == 24 and got.shopper.max() == 2


@pytest.mark.parametrize("by", ["product", "shopper"])
@pytest.mark.parametrize("seed", SEEDS)
def test_dense_counts_need_no_panel(spark, seed, by):
    data, data_pd = frames(spark, seed)
    train = dense(data_pd, SMALL, 20).query("week < 6")
    train["percent"] = (train.discount * 100).round(6)
    want = train.groupby([by, "percent"]).purchased.agg(["size", "sum"]).reset_index()
    want.columns = [by, "percent", "n_rows", "purchases"]
    got = dense_counts(data, SMALL, by, SMALL.train_weeks, 20).toPandas()
    assert rows(got[got.n_rows > 0], list(want.columns)) == rows(want, list(want.columns))


@pytest.mark.parametrize("seed", SEEDS)
def test_weight_of_evidence(spark, seed):
    import math

    data, data_pd = frames(spark, seed)
    train = dense(data_pd, SMALL, 20).query("week < 6")
    p, n = train.purchased.sum(), (1 - train.purchased).sum()
    want = {
        k: math.log(((g.sum() + 1) / (p + 2)) / ((len(g) - g.sum() + 1) / (n + 2)))
        for k, g in train.groupby("product").purchased
    }
    got = {r["product"]: r.product_WOE for r in woe(data, SMALL, "product", 20).collect()}
    assert got == pytest.approx(want)


def test_weight_of_evidence_of_a_value_seen_once_is_zero(spark):
    data, _ = frames(spark, 1)
    one_row = replace(SMALL, train_window=1, n_shoppers=1)
    single = data.filter("shopper = 0").dropDuplicates(KEY)
    assert {r.product_WOE for r in woe(single, one_row, "product").collect()} == {0.0}


def _lists(data_pd):
    def weeks(mask):
        chosen = data_pd[mask].groupby(["shopper", "product"]).week.apply(sorted)
        return chosen.to_dict()

    bought, offered = data_pd.purchased == 1, data_pd.discount != 0
    return weeks(bought), weeks(offered), weeks(bought & offered)


@pytest.mark.parametrize("by", ["product", "shopper"])
@pytest.mark.parametrize("before", [False, True])
def test_redemption_counts_every_panel_row(spark, by, before):
    data, data_pd = frames(spark, 2)
    params = replace(SMALL, redemption_before_test_week=before)
    _, received, redeemed = _lists(data_pd[data_pd.week < 6] if before else data_pd)
    want = {}
    for key, group in dense(data_pd, SMALL, 20).groupby(by):
        pairs = list(zip(group.shopper, group["product"]))
        got, used = (sum(len(d.get(p, [])) for p in pairs) for d in (received, redeemed))
        want[key] = None if got == 0 else used / got
    rates = panel_redemption(cells(data, params), params, by, 20)
    got = {r[by]: r[1] for r in rates.collect()}
    assert got == pytest.approx(want)


def _history_features(rows_):
    return with_running_rates(with_product_frequency(with_trends(with_recency(with_past(rows_), LATE), LATE)))


# Weeks of its own before the window: the features' entries of weeks 0 and 1 are joined to one.
LATE = replace(SMALL, test_week=8, train_window=3, trend_windows=(1, 3))


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("seed", SEEDS)
def test_shortened_histories_give_the_features_of_whole_ones(spark, seed, packed):
    data = frames(spark, seed, LATE)[0].withColumn("week", F.expr("IF(week = 0 AND product % 3 = 0, -1, week)"))
    back = look_back(LATE)
    assert min(LATE.panel_weeks) - back == 2
    short = panel(data, LATE, look_back=back, packed=cells(data, LATE) if packed else None)
    columns = [
        *KEY, "price", "discount", "purchased", "weeks_since_last_purchase", "trend_1", "trend_3",
        "product_freq", "shopper_product_redemption_rate", "discount_buy",
    ]
    whole = _history_features(panel(data, LATE)).toPandas()
    assert rows(_history_features(short).toPandas(), columns) == rows(whole, columns)
    assert short.filter(F.size("history") > 8).count() == 0


def test_tasks_that_open_the_panel_follow_its_rows(spark, monkeypatch):
    """A few bytes of cells are opened to many rows: as many tasks as these need, not as their bytes need."""
    monkeypatch.setattr(panel_module, "ROWS_PER_TASK", 10)
    data, _ = frames(spark, 1)
    tasks = panel_module.panel_tasks(SMALL, len(SMALL.panel_weeks), SMALL.n_products)
    assert tasks == 23
    text = panel(data, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"hashpartitioning\(shopper#\d+, block#\d+, {tasks}\), REPARTITION_BY_NUM", text)


@pytest.mark.parametrize("seed", SEEDS)
def test_history_features(spark, seed):
    data, data_pd = frames(spark, seed)
    bought, received, redeemed = _lists(data_pd)
    want = []
    for w, s, p in dense(data_pd, SMALL)[KEY].itertuples(index=False):
        b, r, d = ([x for x in lists.get((s, p), []) if x < w] for lists in (bought, received, redeemed))
        want.append((
            w, s, p,
            w - b[-1] if b else 7,
            sum(x >= w - 1 for x in b) / 1,
            sum(x >= w - 3 for x in b) / 3,
            len(b) / w,
            len(d) / len(r) if r else 0,
            len(r) / len(b) if b else 0,
        ))
    columns = [
        *KEY, "weeks_since_last_purchase", "trend_1", "trend_3", "product_freq",
        "shopper_product_redemption_rate", "discount_buy",
    ]
    built = with_product_frequency(
        with_trends(with_recency(with_past(panel(data, SMALL)), SMALL), SMALL)
    )
    got = with_running_rates(built).toPandas()
    assert rows(got, columns) == rows(pd.DataFrame(want, columns=columns), columns)


def test_history_lists(spark):
    data, data_pd = frames(spark, 3)
    bought, received, redeemed = _lists(data_pd)
    for r in panel(data, SMALL).select(
        "shopper", "product",
        *[H.weeks_with(F.col("history"), c).alias(c) for c in ("purchased", "received", "redeemed")],
        *[H.total(F.col("history"), c).alias(f"n_{c}") for c in ("purchased", "received", "redeemed")],
    ).collect():
        pair = (r.shopper, r["product"])
        for name, lists in (("purchased", bought), ("received", received), ("redeemed", redeemed)):
            assert r[name] == sorted(set(lists.get(pair, [])))
            assert r[f"n_{name}"] == len(lists.get(pair, []))


@pytest.mark.parametrize("seed", SEEDS)
def test_substitute_discount(spark, seed):
    data, data_pd = frames(spark, seed)
    want = dense(data_pd, SMALL)
    group = [want.week, want.shopper, want["product"] // 10]
    want["substitute_discount"] = want.discount.groupby(group).transform("sum") - want.discount
    want.loc[want["product"] >= 20, "substitute_discount"] = None
    got = with_substitute_discount(with_category(panel(data, SMALL), SMALL)).toPandas()
    columns = [*KEY, "discount", "substitute_discount"]
    assert rows(got, columns, 6) == rows(want, columns, 6)


def test_product_elasticity(spark):
    data, data_pd = frames(spark, 1)
    train = dense(data_pd, SMALL).query("week < 6")
    want = {}
    for product, group in train.groupby("product"):
        regular = group[group.discount == 0].purchased.mean()
        special = group[(group.discount * 100).round() == 30].purchased.mean()
        value = (special - regular) / (0.3 * regular) if regular else None
        want[product] = None if value is None or value != value else value
    got = {r["product"]: r.elasticities for r in product_elasticity(data, SMALL).collect()}
    assert got == pytest.approx(want)


def test_mode_price_takes_the_lowest_on_ties_and_null_without_price(spark):
    data = spark.createDataFrame(
        [(1, 0, 1, 2.0), (1, 1, 1, 1.0), (1, 2, 1, 2.0), (1, 3, 1, 1.0), (2, 0, 1, None), (1, 0, 2, 3.0),
         (1, 1, 2, None), (1, 2, 2, None)],
        "week int, shopper int, product int, price double",
    )
    got = {(r["product"], r.week): r.mode_price for r in mode_price(data, SMALL).collect()}
    assert got == {(1, 1): 1.0, (1, 2): None, (2, 1): 3.0}


def test_missing_price_takes_exactly_the_week_before(spark):
    data = spark.createDataFrame(
        [(4, 0, 1, 9.0, 0.0, 1), (2, 0, 2, 7.0, 0.0, 1)],
        "week int, shopper int, product int, price double, discount double, purchased int",
    )
    rows_ = panel(data, SMALL, with_history=False)
    got = {
        (r.week, r["product"]): r.price
        for r in impute_price(rows_, data, SMALL, SMALL.panel_weeks).filter("shopper = 1").collect()
    }
    assert got[5, 1] == 9.0
    assert got[4, 1] is None and got[6, 1] is None and got[4, 2] is None


def test_model_data_drops_products_without_category(spark):
    data, data_pd = frames(spark, 1)
    got = model_data(data, cells(data, SMALL), SMALL, encoded=True).toPandas()
    want = dense(data_pd, SMALL, 20)
    assert len(got) == len(want)
    assert got["product"].max() == 19
    assert set(got.filter(like="cluster_").sum(axis=1)) == {1}
    assert {"shopper_WOE", "product_WOE", "elasticities"} <= set(got.columns)


def test_category_without_label_leaves(spark):
    params = replace(SMALL, category_clusters=(1,))
    df = spark.createDataFrame([(5,), (15,), (30,)], "product int")
    got = with_cluster(with_category(df, params), params).collect()
    assert [(r["product"], r.cat_cluster) for r in got] == [(5, 1)]
    dummies = cluster_dummies(with_cluster(with_category(df, params), params)).collect()[0]
    assert (dummies.cluster_0, dummies.cluster_1, dummies.cluster_2) == (0, 1, 0)


def test_frequency_is_null_in_week_zero(spark):
    row = spark.range(1).select(
        F.lit(0).alias("week"),
        F.expr("array(named_struct('week', 0, 'purchased', 1L, 'received', 0L, 'redeemed', 0L))").alias("history"),
    )
    assert with_product_frequency(with_past(row)).first().product_freq is None


@pytest.mark.parametrize("with_history", [True, False])
def test_panel_of_given_keys_equals_the_rows_of_the_whole(spark, with_history):
    data, _ = frames(spark, 2)
    keys = panel(data, SMALL, with_history=False).select(*KEY).distinct().sample(0.3, 1)
    outside = spark.createDataFrame([(6, 0, 26), (6, 3, 1), (1, 0, 1)], keys.schema)
    tagged = keys.unionByName(outside).withColumn("tag", F.explode(F.array(F.lit(1), F.lit(2)))).cache()
    got = panel(data, SMALL, with_history=with_history, only=tagged).toPandas()
    want = panel(data, SMALL, with_history=with_history).join(tagged, KEY).toPandas()
    assert len(want) > 20
    columns = [*KEY, "price", "discount", "purchased", "tag"]
    assert rows(got, columns) == rows(want, columns)
    if with_history:
        assert sorted(map(str, got.history)) == sorted(map(str, want.history))


def test_model_data_of_given_keys(spark):
    data, _ = frames(spark, 4)
    packed = cells(data, SMALL)
    whole = model_data(data, packed, SMALL, [6], encoded=True).toPandas()
    keys = spark.createDataFrame([(6, s, p) for s in range(3) for p in (0, 7, 13)], "week int, shopper int, product int")
    got = model_data(data, packed, SMALL, [6], encoded=True, only=keys).toPandas()
    columns = list(whole.columns)
    assert rows(got, columns) == rows(whole[whole["product"].isin([0, 7, 13])], columns)


def test_one_key_with_a_third_of_all_rows(spark):
    """No result is cut and no list grows when one purchase is repeated 300 times."""
    baskets, coupons = random_rows(6)
    baskets += [(5, 1, 3, 10.0)] * 300
    coupons += [(5, 1, 3, 20.0)]
    data = facts(inputs(spark, baskets, coupons), SMALL)
    data_pd = data.toPandas()
    want = dense(data_pd, SMALL)
    built = panel(data, SMALL)
    columns = [*KEY, "price", "discount", "purchased"]
    got = built.withColumn("entries", F.size("history")).toPandas()
    assert rows(got, columns) == rows(want, columns)
    assert got.entries.max() <= data_pd.week.nunique()
    bought, _, _ = _lists(data_pd)
    trend = with_trends(with_past(built), SMALL).filter("week = 6 AND shopper = 1 AND product = 3").first()
    assert trend.trend_1 == sum(w == 5 for w in bought[1, 3]) >= 300
    counts = dense_counts(data, SMALL, "shopper", SMALL.train_weeks).filter("shopper = 1").toPandas()
    assert counts.n_rows.sum() == len(want.query("shopper == 1 and week < 6"))
    _, received, redeemed = _lists(data_pd)
    pairs = [(s, p) for s, p in want.query("shopper == 1")[["shopper", "product"]].itertuples(index=False)]
    rate = panel_redemption(cells(data, SMALL), SMALL, "shopper").filter("shopper = 1").first()[1]
    assert rate == pytest.approx(
        sum(len(redeemed.get(p, [])) for p in pairs) / sum(len(received.get(p, [])) for p in pairs)
    )
