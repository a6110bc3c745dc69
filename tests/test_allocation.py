"""Scenarios, greedy allocation, baseline policies and their revenue."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from couponloom.operators.allocation import delta_revenue, scenarios, top_coupons
from couponloom.operators.encode import test_rows as in_test_week
from couponloom.operators.encode import train_rows
from couponloom.operators.features import feature_names, model_data
from couponloom.operators.histories import cells
from couponloom.operators.policies import (
    compare_policies,
    expected_total_revenue,
    policy_revenue,
    random_slots,
    zero_slots,
)
from couponloom.operators.scoring import RateScorer, TreeScorer, log_loss
from couponloom.params import Params
from couponloom.plans.pipeline import run
from couponloom.sources.tables import OPTIMAL_COUPONS
from tests.helpers import SMALL, frames, inputs, random_rows

TEST = "week int, shopper int, product int, price double, discount double, substitute_discount double, product_cat int"


class TableScorer:
    """Probabilities looked up by (shopper, product, percent) in a Python table."""

    def __init__(self, table):
        self.table = table

    def score(self, rows, scenarios):
        for name, overrides in scenarios.items():
            discount = overrides.get("discount", F.col("discount"))
            key = F.concat_ws("/", "shopper", "product", F.round(discount * 100).cast("int"))
            pairs = [F.lit(x) for k, v in self.table.items() for x in ("/".join(map(str, k)), v)]
            rows = rows.withColumn(name, F.try_element_at(F.create_map(*pairs), key))
        return rows


def greedy(revenues, n):
    """Literal greedy: best gain first, skip a category that already has a coupon."""
    chosen, used = [], set()
    for gain, product, discount in sorted(revenues, key=lambda r: (-r[0], r[1], r[2])):
        if product // 10 not in used and len(chosen) < n:
            used.add(product // 10)
            chosen.append((product, discount))
    return chosen


@pytest.mark.parametrize("seed", range(3))
def test_top_coupons_equal_the_literal_greedy(spark, seed):
    rng = random.Random(seed)
    params = replace(SMALL, n_products=30, n_coupons=2 + seed)  # seed 2: more slots than categories
    products = rng.sample(range(30), 12)
    table, test, want = {}, [], {}
    for shopper in range(3):
        revenues = []
        for product in products:
            price = float(rng.randrange(1, 4))
            test.append((6, shopper, product, price, 0.0, 0.0, product // 10))
            for d in (0.0, *params.discounts):
                # few distinct values, so that gains tie
                table[shopper, product, round(d * 100)] = rng.choice([0.2, 0.5, 0.8])
            zero = table[shopper, product, 0] * price
            revenues += [
                (table[shopper, product, round(d * 100)] * price * (1 - d) - zero, product, d)
                for d in params.discounts
            ]
        want[shopper] = greedy(revenues, params.n_coupons)
    got = top_coupons(spark.createDataFrame(test, TEST), TableScorer(table), params).collect()
    for shopper, chosen in want.items():
        mine = sorted((r.coupon, r["product"], r.discount) for r in got if r.shopper == shopper)
        assert mine == [(i, p, d) for i, (p, d) in enumerate(chosen)]


def test_rows_without_price_come_last_and_negative_gains_stay(spark):
    test = [(6, 0, 1, None, 0.0, 0.0, 0), (6, 0, 11, 10.0, 0.0, 0.0, 1)]
    table = {(0, p, c): 0.5 for p in (1, 11) for c in (0, 15, 20, 25, 30)}
    got = top_coupons(spark.createDataFrame(test, TEST), TableScorer(table), SMALL).collect()
    assert [(r.coupon, r["product"], r.discount) for r in sorted(got)] == [(0, 11, 0.15), (1, 1, 0.15)]


def test_scenarios_override_discount_and_substitutes(spark):
    test = spark.createDataFrame([(6, 0, 1, 5.0, 0.2, 0.3, 0)], TEST)
    got = scenarios(test, SMALL).collect()
    assert sorted(r.discount for r in got) == [0.0, 0.15, 0.2, 0.25, 0.3]
    assert {r.substitute_discount for r in got} == {0.0}


def test_delta_is_against_the_zero_discount_of_the_same_row(spark):
    test = spark.createDataFrame([(6, 0, 1, 10.0, 0.0, 0.0, 0)], TEST)
    table = {(0, 1, c): p for c, p in ((0, 0.4), (15, 0.5), (20, 0.6), (25, 0.7), (30, 0.8))}
    got = {r.discount: r for r in delta_revenue(test, TableScorer(table), SMALL).collect()}
    assert got[0.0].delta_revenue is None
    assert got[0.3].delta_revenue == pytest.approx(0.8 * 7 - 4)


def all_slots(spark, params):
    """Every coupon slot of every shopper in the test week."""
    return spark.range(params.n_shoppers).select(
        F.col("id").alias("shopper"),
        F.lit(params.test_week).alias("week"),
        F.explode(F.sequence(F.lit(0), F.lit(params.n_coupons - 1))).alias("coupon"),
    )


@pytest.mark.parametrize("n_products,n_coupons", [(250, 5), (5, 5), (3, 5)])
def test_random_slots_are_distinct_and_repeatable(spark, n_products, n_coupons):
    params = Params(n_shoppers=400, n_products=n_products, n_coupons=n_coupons)
    slots = all_slots(spark, params)
    got = random_slots(slots, params).toPandas()
    per = min(n_products, n_coupons)
    assert len(got) == 400 * per
    assert (got.groupby("shopper")["product"].nunique() == per).all()
    assert got["product"].between(0, n_products - 1).all()
    assert set(got.discount) == set(params.discounts)
    assert got.equals(random_slots(slots, params).toPandas())
    other = random_slots(slots, replace(params, seed=7)).toPandas()
    assert not got[["product", "discount"]].equals(other[["product", "discount"]])
    if n_products == 250:
        assert got["product"].nunique() > 240
    assert set(zero_slots(slots, params).toPandas().discount) == {0.0}


def test_random_coupons_fill_the_given_slots_only(spark):
    """A shopper with fewer optimal coupons gets as many random ones."""
    params = Params(n_shoppers=3)
    given = [(0, 90, k) for k in range(5)] + [(1, 90, 0), (1, 90, 1)]
    slots = spark.createDataFrame(given, "shopper int, week int, coupon int")
    got = random_slots(slots, params)
    assert sorted((r.shopper, r.week, r.coupon) for r in got.collect()) == given
    whole = {(r.shopper, r.coupon): (r["product"], r.discount) for r in random_slots(all_slots(spark, params), params).collect()}
    assert {(r.shopper, r.coupon): (r["product"], r.discount) for r in got.collect()}.items() <= whole.items()


def test_coupon_index_gives_the_slots(spark, scored):
    _, _, test, scorer = scored
    optimal = top_coupons(test, scorer, SMALL).cache()
    index = spark.createDataFrame([(0, 6, 0), (0, 5, 1), (99, 6, 0)], "shopper int, week int, coupon int")
    got = {r.policy: r.total_revenue for r in compare_policies(test, optimal, scorer, SMALL, slots=index).collect()}
    tagged = random_slots(index.filter("week = 6 and shopper = 0"), SMALL).withColumn("policy", F.lit("random"))
    want = policy_revenue(test, tagged, scorer).filter("policy = 'random'").first().total_revenue
    assert got["random"] == pytest.approx(want)


@pytest.fixture(scope="module")
def scored(spark):
    data, _ = frames(spark, 5)
    rows = model_data(data, cells(data, SMALL), SMALL, encoded=True)
    test = in_test_week(rows, SMALL).cache()
    return data, rows, test, RateScorer(data, SMALL)


@pytest.mark.parametrize("placement", ["by_key", "same_products"])
def test_policy_totals_equal_the_overlay_of_all_rows(spark, scored, placement):
    data, _, test, scorer = scored
    optimal = top_coupons(test, scorer, SMALL).cache()
    got = {r.policy: r.total_revenue for r in compare_policies(test, optimal, scorer, SMALL, placement).collect()}
    slots = optimal.toPandas()
    random_pd = random_slots(optimal, SMALL).toPandas()
    if placement == "same_products":
        random_pd = slots.drop(columns="discount").merge(random_pd[["shopper", "coupon", "discount"]])
    zero_pd = slots.assign(discount=0.0)
    for policy, coupons in (("zero", zero_pd), ("random", random_pd), ("optimal", slots)):
        chosen = {(r.shopper, r.product): r.discount for r in coupons.itertuples()}
        overlay = [[*k, float(v)] for k, v in chosen.items()]
        placed = test.drop("discount").join(
            spark.createDataFrame(overlay, "shopper int, product int, discount double"),
            ["shopper", "product"], "left",
        ).fillna(0.0, ["discount"])
        total = scorer.score(placed, {"p": {}}).agg(F.sum(F.expr("p * price * (1 - discount)"))).first()[0]
        assert got[policy] == pytest.approx(total)
    assert got["optimal"] >= got["zero"] - 1e-9 or placement == "same_products"
    by_keys = compare_policies(
        test, optimal, scorer, SMALL, placement,
        rows_at=lambda keys: model_data(data, cells(data, SMALL), SMALL, [6], encoded=True, only=keys),
    )
    assert {r.policy: r.total_revenue for r in by_keys.collect()} == pytest.approx(got)
    single = expected_total_revenue(test, optimal, scorer).first().total_revenue
    assert single == pytest.approx(got["optimal"])


def test_unknown_placement_is_refused(scored):
    _, _, test, scorer = scored
    with pytest.raises(ValueError):
        compare_policies(test, test, scorer, SMALL, "by_slot")


def test_log_loss_with_weights_equals_rows(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.9), (1, 0.0)], "y int, p double")
    weighted = spark.createDataFrame([(1, 0.9, 2), (0, 0.9, 1), (1, 0.0, 1)], "y int, p double, n int")
    a, b = log_loss(df, "y", "p").first()[0], log_loss(weighted, "y", "p", "n").first()[0]
    assert a == pytest.approx(b) and a < float("inf")


def test_trees_score_probabilities_and_beat_the_base_rate(spark, scored):
    _, rows, test, _ = scored
    train = train_rows(rows, SMALL).cache()
    scorer = TreeScorer(train, iterations=3, depth=3)
    assert not set(scorer.features) & {"week", "shopper", "product", "purchased", "product_cat"}
    assert scorer.features == feature_names(train)
    fitted = scorer.score(train, {"probability": {}})
    assert fitted.columns == [*train.columns, "probability"]
    bounds = fitted.agg(F.min("probability"), F.max("probability"), F.avg("purchased")).first()
    assert 0 <= bounds[0] <= bounds[1] <= 1
    base = fitted.withColumn("base", F.lit(bounds[2]))
    assert log_loss(fitted, "purchased", "probability").first()[0] < log_loss(base, "purchased", "base").first()[0]
    again = TreeScorer(train, iterations=3, depth=3).score(test, {"a": {}})
    first = scorer.score(test, {"a": {}, "b": {"discount": F.lit(0.3)}})
    assert first.columns == [*test.columns, "a", "b"]
    key = ["week", "shopper", "product"]
    one, two = (d.select(*key, "a").toPandas().sort_values(key + ["a"]).a.tolist() for d in (first, again))
    assert one == pytest.approx(two)


@pytest.mark.parametrize("scorer", ["rates", "trees"])
def test_whole_pipeline(spark, tmp_path, scorer):
    given = inputs(spark, *random_rows(4, repeats=1))
    result = run(
        spark, given, SMALL, f"{tmp_path}/out", "v1", scorer=scorer, iterations=2, folder=str(tmp_path)
    )
    assert result.coupons.schema == OPTIMAL_COUPONS
    chosen = result.coupons.toPandas()
    assert (chosen.groupby("shopper").size() <= SMALL.n_coupons).all()
    assert not (chosen["product"] // 10).groupby(chosen.shopper).apply(lambda c: c.duplicated().any()).any()
    assert {r.policy for r in result.policies.collect()} == {"zero", "random", "optimal"}
    assert result.train_log_loss.first()[0] > 0


def test_a_false_claim_of_unique_keys_fails_the_run(spark, tmp_path):
    baskets, coupons = random_rows(4, repeats=1)
    baskets, coupons = ([*{r[:3]: r for r in rows}.values()] for rows in (baskets, coupons))

    def start(rows, folder):
        given = replace(inputs(spark, rows, coupons), unique_keys=True)
        return run(spark, given, SMALL, f"{tmp_path}/out", "v1", scorer="rates", folder=f"{tmp_path}/{folder}")

    assert start(baskets, "a").coupons.count() > 0
    with pytest.raises(ValueError, match="unique_keys"):
        start([*baskets, baskets[0]], "b")
    assert not list((tmp_path / "b" / "stages").glob("cell-maps-*"))
    # Facts are right whatever the claim, and stay; a second run meets the same proof.
    with pytest.raises(ValueError, match="unique_keys"):
        start([*baskets, baskets[0]], "b")


def test_a_new_week_of_facts_is_added(spark, tmp_path):
    baskets, coupons = random_rows(4, repeats=1)

    def start(weeks):
        given = inputs(spark, [r for r in baskets if r[0] in weeks], [r for r in coupons if r[0] in weeks])
        return run(spark, given, SMALL, f"{tmp_path}/out", "v1", scorer="rates", folder=str(tmp_path))

    def facts_of_weeks():
        (folder,) = (tmp_path / "stages").glob("facts-*")
        return {p.name: p.stat().st_mtime_ns for p in folder.iterdir()}

    start(range(8))
    before = facts_of_weeks()
    whole = sorted(map(tuple, start(range(9)).model_data.collect()), key=str)
    after = facts_of_weeks()
    assert set(after) - set(before) == {"week=8"} and {k: after[k] for k in before} == before
    given = inputs(spark, baskets, coupons)
    fresh = run(spark, given, SMALL, f"{tmp_path}/out", "v1", scorer="rates", folder=f"{tmp_path}/fresh")
    assert whole == sorted(map(tuple, fresh.model_data.collect()), key=str)


def test_zero_policy_equals_scenario_zero_without_substitutes(spark, scored):
    """Evaluation keeps observed substitute discounts unless told otherwise."""
    data, rows, test, _ = scored
    scorer = TreeScorer(train_rows(rows, SMALL).cache(), iterations=2, depth=3)
    zero = zero_slots(all_slots(spark, SMALL), SMALL).withColumn("policy", F.lit("zero"))
    totals = policy_revenue(test, zero, scorer, keep_substitutes=False).filter("policy = 'zero'")
    scenario = delta_revenue(test, scorer, SMALL).filter("discount = 0").agg(F.sum("exp_revenue"))
    assert totals.first().total_revenue == pytest.approx(scenario.first()[0])
