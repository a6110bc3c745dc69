"""One registered query per operator, over tables derived from the star schema."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from couponloom.functions import history as H
from couponloom.operators import affinity, embeddings, features, narrow, policies, rates
from couponloom.operators.allocation import delta_revenue, scenarios, top_coupons
from couponloom.operators.dims import join_dimension
from couponloom.operators.elasticity import attach_elasticity, product_elasticity, weekly_elasticity
from couponloom.operators.encode import test_rows, train_rows, woe
from couponloom.operators.facts import KEY, baskets_coupons, duplicate_keys, facts, filter_shoppers
from couponloom.operators.histories import (
    cells,
    pair_histories,
    purchase_weeks,
    received_weeks,
    redeemed_weeks,
)
from couponloom.operators.panel import dense_counts, panel
from couponloom.operators.prices import impute_price, last_week_mode_price, mode_price
from couponloom.operators.scoring import RateScorer, TreeScorer, log_loss, purchase_rates
from couponloom.params import Params
from couponloom.sources.star import star_inputs, star_params, star_table
from couponloom.sources.tables import Inputs, read_coupons, read_inputs, write_coupons
from couponloom.workspace import private_folder, private_stage, shared_folder, weekly_stage

# Products with and without a category occur when the binned range ends at 90.
PARTLY_BINNED = {"n_products": 95}


class Star:
    """Parameters, inputs and facts of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, **changes):
        self.spark = spark
        self.sf_dir = sf_dir
        self.params: Params = star_params(spark, sf_dir, **changes)

    @cached_property
    def inputs(self) -> Inputs:
        return star_inputs(self.spark, self.sf_dir, self.params.n_shoppers)

    @cached_property
    def facts(self) -> DataFrame:
        return facts(self.inputs, self.params)

    @cached_property
    def written_facts(self) -> DataFrame:
        """Facts written once, for plans that read them many times."""
        return private_stage(self.spark, "facts", lambda: self.facts.sortWithinPartitions("week"))

    @cached_property
    def written_cells(self) -> DataFrame:
        return private_stage(self.spark, "cells", lambda: cells(self.written_facts, self.params))

    @property
    def panel(self) -> DataFrame:
        return panel(self.written_facts, self.params)

    @property
    def categorised(self) -> DataFrame:
        return features.with_category(self.panel, self.params)

    @property
    def past(self) -> DataFrame:
        back = features.look_back(self.params)
        return features.with_past(panel(self.written_facts, self.params, look_back=back))

    def model_data(
        self,
        weeks: list[int] | None = None,
        encoded: bool = False,
        only: DataFrame | None = None,
    ) -> DataFrame:
        return features.model_data(
            self.written_facts, self.written_cells, self.params, weeks, encoded, only
        )

    def test_at(self, keys: DataFrame | None) -> DataFrame:
        """Test-week rows with the columns the rate scorer and the allocation need."""
        p, weeks = self.params, [self.params.test_week]
        rows = panel(
            self.written_facts, p, weeks, p.model_products, with_history=False, only=keys
        )
        rows = impute_price(rows, self.written_facts, p, weeks)
        return features.with_category(rows, p)

    @cached_property
    def test(self) -> DataFrame:
        return self.test_at(None)

    @cached_property
    def rate_scorer(self) -> RateScorer:
        return RateScorer(self.written_facts, self.params)

    @property
    def optimal(self) -> DataFrame:
        return top_coupons(self.test, self.rate_scorer, self.params)

    @property
    def products(self) -> DataFrame:
        return affinity.cooccurrence(self.inputs.baskets, "product")

    @property
    def categories(self) -> DataFrame:
        baskets = features.with_category(self.inputs.baskets, self.params)
        return affinity.cooccurrence(baskets, "product_cat")

    @cached_property
    def written_products(self) -> DataFrame:
        return private_stage(self.spark, "products", lambda: self.products)

    @cached_property
    def written_categories(self) -> DataFrame:
        return private_stage(self.spark, "categories", lambda: self.categories)


def _joined(column) -> F.Column:
    """Week list as text, null when there is no list."""
    return F.nullif(F.array_join(column, ","), F.lit(""))


def _scan_baskets(s: Star) -> DataFrame:
    return s.inputs.baskets


def _scan_coupons(s: Star) -> DataFrame:
    return s.inputs.coupons


def _duplicate_keys(s: Star) -> DataFrame:
    """Lines of one product in one order of the raw table, the case the checks look for."""
    lines = star_table(s.spark, s.sf_dir, "lineitem")
    return duplicate_keys(lines, ["l_orderkey", "l_partkey"])


def _cached_dataset(s: Star) -> DataFrame:
    """The weeks before the test week are written first, so the second reading builds one week."""
    folder = f"{shared_folder(s.spark)}/{uuid.uuid4().hex}"
    key = s.params.fingerprint(s.sf_dir)

    def read(weeks: list[int]) -> DataFrame:
        return weekly_stage(
            s.spark, "dataset", key, weeks,
            lambda some: features.dataset(s.written_facts, s.params, s.written_cells, some), folder,
        )

    read(s.params.train_weeks)
    return read(s.params.panel_weeks).select(
        *KEY,
        "price",
        "discount",
        "purchased",
        *[H.total(F.col("history"), c).alias(f"n_{c}") for c in ("purchased", "received", "redeemed")],
    )


def _coupon_sink_roundtrip(s: Star) -> DataFrame:
    path = f"{shared_folder(s.spark)}/coupons-{uuid.uuid4().hex}"
    write_coupons(s.optimal, path)
    return read_coupons(s.spark, path)


def _profile_min_max(s: Star) -> DataFrame:
    return narrow.profile(s.inputs.baskets)


def _narrow_types(s: Star) -> DataFrame:
    return narrow.narrow(s.inputs.baskets)


def _narrow_on_read(s: Star) -> DataFrame:
    """The inputs as files, baskets read back in types that hold the keys of both tables."""
    folder = private_folder(s.spark, "inputs")
    s.inputs.baskets.write.parquet(f"{folder}/baskets.parquet")
    s.inputs.coupons.write.parquet(f"{folder}/coupons.parquet")
    return read_inputs(s.spark, folder, coupon_index=None, narrow=True).baskets


def _filter_shoppers(s: Star) -> DataFrame:
    half = replace(s.params, n_shoppers=s.params.n_shoppers // 2)
    return filter_shoppers(s.inputs.baskets, half)


def _baskets_coupons(s: Star) -> DataFrame:
    return baskets_coupons(s.inputs.baskets, s.inputs.coupons)


def _clean(s: Star) -> DataFrame:
    return s.facts


def _grid_facts(s: Star) -> DataFrame:
    return panel(s.written_facts, s.params, with_history=False)


def _histories(s: Star) -> DataFrame:
    h = F.col("history")
    return s.panel.select(
        *KEY,
        _joined(H.weeks_with(h, "purchased")).alias("week_hist"),
        _joined(H.weeks_with(h, "received")).alias("discount_received_weeks"),
        _joined(H.weeks_with(h, "redeemed")).alias("discount_redeemed_weeks"),
    )


def _week_hist(s: Star) -> DataFrame:
    return purchase_weeks(s.facts).withColumn("week_hist", _joined("week_hist"))


def _received_weeks(s: Star) -> DataFrame:
    name = "discount_received_weeks"
    return received_weeks(s.facts).withColumn(name, _joined(name))


def _redeemed_weeks(s: Star) -> DataFrame:
    name = "discount_redeemed_weeks"
    return redeemed_weeks(s.facts).withColumn(name, _joined(name))


def _pair_totals(s: Star) -> DataFrame:
    """Length of each of the three lists per pair; a missing list counts as empty."""
    h = F.col("history")
    return pair_histories(s.facts).select(
        "shopper",
        "product",
        *[H.total(h, c).alias(f"n_{c}") for c in ("purchased", "received", "redeemed")],
    )


def _mode_price(s: Star) -> DataFrame:
    return mode_price(s.facts, s.params)


def _last_week_mode_price(s: Star) -> DataFrame:
    return last_week_mode_price(s.facts, s.params)


def _impute_price(s: Star) -> DataFrame:
    rows = panel(s.written_facts, s.params, with_history=False)
    return impute_price(rows, s.written_facts, s.params, s.params.panel_weeks)


def _product_category(s: Star) -> DataFrame:
    return features.with_category(s.inputs.baskets, s.params)


def _cat_cluster(s: Star) -> DataFrame:
    return features.with_cluster(_product_category(s), s.params)


def _cluster_dummies(s: Star) -> DataFrame:
    return features.cluster_dummies(_cat_cluster(s))


def _substitute_discount(s: Star) -> DataFrame:
    rows = features.with_substitute_discount(s.categorised)
    return rows.select(*KEY, "discount", "product_cat", "substitute_discount")


def _recency_default(s: Star) -> DataFrame:
    return features.recency_default(s.inputs.baskets, s.params)


def _weeks_since_purchase(s: Star) -> DataFrame:
    return features.with_recency(s.past, s.params).select(*KEY, "weeks_since_last_purchase")


def _trend(window: int) -> Callable[[Star], DataFrame]:
    def query(s: Star) -> DataFrame:
        return features.with_trends(s.past, s.params).select(*KEY, f"trend_{window}")

    return query


def _product_freq(s: Star) -> DataFrame:
    return features.with_product_frequency(s.past).select(*KEY, "product_freq")


def _sp_redemption_rate(s: Star) -> DataFrame:
    return features.with_running_rates(s.past).select(*KEY, "shopper_product_redemption_rate")


def _discount_buy(s: Star) -> DataFrame:
    return features.with_running_rates(s.past).select(*KEY, "discount_buy")


def _redemption_rate(s: Star) -> DataFrame:
    return rates.redemption_rate(s.facts, s.params)


def _customer_redemption_rate(s: Star) -> DataFrame:
    return rates.customer_redemption_rate(s.facts, s.params)


def _coupon_rates_discount_buy(s: Star) -> DataFrame:
    return rates.coupon_share(s.facts, s.params)


def _shopper_redemption(s: Star) -> DataFrame:
    return rates.panel_redemption(cells(s.facts, s.params), s.params, "shopper")


def _product_redemption(s: Star) -> DataFrame:
    return rates.panel_redemption(cells(s.facts, s.params), s.params, "product")


def _redemption_features(s: Star) -> DataFrame:
    by_shopper, by_product = [
        rates.panel_redemption(s.written_cells, s.params, by) for by in ("shopper", "product")
    ]
    rows = panel(s.written_facts, s.params, by_shopper=by_shopper, with_history=False)
    joined = join_dimension(
        rows, by_product, ["product"], s.params.n_products, "inner", ["shopper", "week"]
    )
    return joined.select(*KEY, "shopper_redemption_rate", "product_redemption_rate")


def _weekly_elasticity(s: Star) -> DataFrame:
    return weekly_elasticity(s.inputs, s.params)


def _product_elasticity(s: Star) -> DataFrame:
    return product_elasticity(s.written_facts, s.params)


def _elasticity_feature(s: Star) -> DataFrame:
    rows = panel(s.written_facts, s.params, with_history=False)
    return attach_elasticity(rows, s.written_facts, s.params).select(*KEY, "elasticities")


def _model_data(s: Star) -> DataFrame:
    return s.model_data()


def _train_split(s: Star) -> DataFrame:
    return train_rows(s.model_data(s.params.train_weeks), s.params)


def _test_split(s: Star) -> DataFrame:
    return test_rows(s.model_data([s.params.test_week]), s.params)


def _feature_columns(s: Star) -> DataFrame:
    rows = _with_rounded_codes(s.model_data(encoded=True))
    return rows.select(*features.feature_names(rows))


def _with_rounded_codes(df: DataFrame) -> DataFrame:
    codes = [c for c in df.columns if c.endswith("_WOE")]
    return df.withColumns({c: F.round(c, 9) for c in codes})


def _woe_shopper(s: Star) -> DataFrame:
    codes = woe(s.written_facts, s.params, "shopper")
    rows = panel(s.written_facts, s.params, by_shopper=codes, with_history=False)
    return _with_rounded_codes(rows.select(*KEY, "purchased", "shopper_WOE"))


def _woe_product(s: Star) -> DataFrame:
    codes = woe(s.written_facts, s.params, "product")
    rows = panel(s.written_facts, s.params, with_history=False).select(*KEY, "purchased")
    joined = join_dimension(
        rows, codes, ["product"], s.params.n_products, spread=["shopper", "week"]
    )
    return _with_rounded_codes(joined)


def _purchase_rates(s: Star) -> DataFrame:
    return purchase_rates(s.written_facts, s.params)


def _log_loss(s: Star) -> DataFrame:
    """Training rows scored by the rates, equal rows as one weighted row."""
    counts = dense_counts(s.written_facts, s.params, "product", s.params.train_weeks)
    both = F.array(
        F.struct(F.lit(1).alias("purchased"), F.col("purchases").alias("n")),
        F.struct(F.lit(0).alias("purchased"), (F.col("n_rows") - F.col("purchases")).alias("n")),
    )
    rows = counts.select(
        "product", (F.col("percent") / F.lit(100.0)).alias("discount"), F.inline(both)
    )
    scored = s.rate_scorer.score(rows, {"probability": {}})
    return log_loss(scored, "purchased", "probability", "n").select(
        F.round("log_loss", 9).alias("log_loss")
    )


def _scenarios(s: Star) -> DataFrame:
    return scenarios(s.test, s.params)


def _delta_revenue(s: Star) -> DataFrame:
    return delta_revenue(s.test, s.rate_scorer, s.params)


def _top_coupons(s: Star) -> DataFrame:
    return s.optimal


def _random_coupons(s: Star) -> DataFrame:
    return policies.random_slots(s.optimal, s.params)


def _zero_coupons(s: Star) -> DataFrame:
    return policies.zero_slots(s.optimal, s.params)


def _expected_total_revenue(s: Star) -> DataFrame:
    optimal = private_stage(s.spark, "coupons", lambda: s.optimal)
    total = policies.expected_total_revenue(s.test, optimal, s.rate_scorer, s.test_at)
    return total.select(F.round("total_revenue", 4).alias("total_revenue"))


def _policy_comparison(placement: str) -> Callable[[Star], DataFrame]:
    def query(s: Star) -> DataFrame:
        optimal = private_stage(s.spark, "coupons", lambda: s.optimal)
        totals = policies.compare_policies(
            s.test, optimal, s.rate_scorer, s.params, placement, s.test_at
        )
        return totals.select("policy", F.round("total_revenue", 4).alias("total_revenue"))

    return query


def _basket_id(s: Star) -> DataFrame:
    return affinity.with_basket_id(s.inputs.baskets)


def _basket_lists(s: Star) -> DataFrame:
    return affinity.basket_lists(s.inputs.baskets).withColumn("items", _joined("items"))


def _max_basket_size(s: Star) -> DataFrame:
    return affinity.max_basket_size(s.inputs.baskets)


def _cooccurrence(s: Star) -> DataFrame:
    return s.products


def _cooccurrence_pivot(s: Star) -> DataFrame:
    return affinity.cooccurrence_table(s.products, s.params.n_products)


def _cooccurrence_blocks(s: Star) -> DataFrame:
    table = affinity.cooccurrence_blocks(s.products, s.params.n_products, width=32)
    return table.withColumn("counts", F.array_join(F.transform("counts", lambda n: n.cast("string")), ","))


def _category_cooccurrence(s: Star) -> DataFrame:
    return s.categories


def _cooccurrence_clipped(s: Star) -> DataFrame:
    return affinity.clip_diagonal(s.written_products)


def _category_clusters(s: Star) -> DataFrame:
    return affinity.member_clusters(s.written_categories)


def _cooccurrence_ordered(s: Star) -> DataFrame:
    edges = affinity.clip_diagonal(s.written_categories)
    return affinity.order_by_cluster(edges, _category_clusters(s))


def _written_model_data(s: Star) -> DataFrame:
    return private_stage(s.spark, "model-data", lambda: s.model_data(encoded=True), ("week",))


def _gbt_train_predictions(s: Star) -> DataFrame:
    train = train_rows(_written_model_data(s), s.params)
    scored = TreeScorer(train).score(train, {"probability": {}})
    return scored.select(*KEY, "purchased", "probability")


def _gbt_test_scores(s: Star) -> DataFrame:
    rows = _written_model_data(s)
    scorer = TreeScorer(train_rows(rows, s.params))
    scored = scorer.score(test_rows(rows, s.params), {"probability": {}})
    return scored.select(*KEY, "purchased", "probability")


def _gbt_policy_comparison(s: Star) -> DataFrame:
    rows = _written_model_data(s)
    test = test_rows(rows, s.params)
    scorer = TreeScorer(train_rows(rows, s.params))
    optimal = private_stage(s.spark, "coupons", lambda: top_coupons(test, scorer, s.params))
    week = [s.params.test_week]

    def rows_at(keys: DataFrame) -> DataFrame:
        return s.model_data(week, encoded=True, only=keys)

    return policies.compare_policies(test, optimal, scorer, s.params, rows_at=rows_at)


def _model(s: Star):
    return embeddings.load_or_train(s.inputs.baskets)


def _product_embeddings(s: Star) -> DataFrame:
    return embeddings.embeddings(_model(s))


def _similar_products(s: Star) -> DataFrame:
    return embeddings.all_similar_products(_model(s))


def _embedding_projection(s: Star) -> DataFrame:
    return embeddings.projection(_model(s))


_PLANS: dict[str, Callable[[Star], DataFrame]] = {
    "scan_baskets": _scan_baskets,
    "scan_coupons": _scan_coupons,
    "duplicate_keys": _duplicate_keys,
    "cached_dataset": _cached_dataset,
    "coupon_sink_roundtrip": _coupon_sink_roundtrip,
    "profile_min_max": _profile_min_max,
    "narrow_types": _narrow_types,
    "narrow_on_read": _narrow_on_read,
    "filter_shoppers": _filter_shoppers,
    "baskets_coupons": _baskets_coupons,
    "clean": _clean,
    "grid_facts": _grid_facts,
    "histories": _histories,
    "week_hist": _week_hist,
    "received_weeks": _received_weeks,
    "redeemed_weeks": _redeemed_weeks,
    "pair_totals": _pair_totals,
    "mode_price": _mode_price,
    "last_week_mode_price": _last_week_mode_price,
    "impute_price": _impute_price,
    "product_category": _product_category,
    "cat_cluster": _cat_cluster,
    "cluster_dummies": _cluster_dummies,
    "substitute_discount": _substitute_discount,
    "recency_default": _recency_default,
    "weeks_since_purchase": _weeks_since_purchase,
    "trend_1": _trend(1),
    "trend_3": _trend(3),
    "trend_5": _trend(5),
    "product_freq": _product_freq,
    "sp_redemption_rate": _sp_redemption_rate,
    "discount_buy": _discount_buy,
    "redemption_rate": _redemption_rate,
    "customer_redemption_rate": _customer_redemption_rate,
    "coupon_rates_discount_buy": _coupon_rates_discount_buy,
    "shopper_redemption": _shopper_redemption,
    "product_redemption": _product_redemption,
    "redemption_features": _redemption_features,
    "weekly_elasticity": _weekly_elasticity,
    "product_elasticity": _product_elasticity,
    "elasticity_feature": _elasticity_feature,
    "model_data": _model_data,
    "train_split": _train_split,
    "test_split": _test_split,
    "feature_columns": _feature_columns,
    "woe_shopper": _woe_shopper,
    "woe_product": _woe_product,
    "purchase_rates": _purchase_rates,
    "log_loss": _log_loss,
    "scenarios": _scenarios,
    "delta_revenue": _delta_revenue,
    "top_coupons": _top_coupons,
    "random_coupons": _random_coupons,
    "zero_coupons": _zero_coupons,
    "expected_total_revenue": _expected_total_revenue,
    "policy_comparison": _policy_comparison("by_key"),
    "policy_comparison_same_products": _policy_comparison("same_products"),
    "basket_id": _basket_id,
    "basket_lists": _basket_lists,
    "max_basket_size": _max_basket_size,
    "cooccurrence": _cooccurrence,
    "cooccurrence_pivot": _cooccurrence_pivot,
    "cooccurrence_blocks": _cooccurrence_blocks,
    "category_cooccurrence": _category_cooccurrence,
    "cooccurrence_clipped": _cooccurrence_clipped,
    "category_clusters": _category_clusters,
    "cooccurrence_ordered": _cooccurrence_ordered,
    "gbt_train_predictions": _gbt_train_predictions,
    "gbt_test_scores": _gbt_test_scores,
    "gbt_policy_comparison": _gbt_policy_comparison,
    "product_embeddings": _product_embeddings,
    "similar_products": _similar_products,
    "embedding_projection": _embedding_projection,
}
_CHANGES = {
    "product_category": PARTLY_BINNED,
    "cat_cluster": PARTLY_BINNED,
    "cluster_dummies": PARTLY_BINNED,
}


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(name: str, plan: Callable[[Star], DataFrame]):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(Star(spark, sf_dir, **_CHANGES.get(name, {})))

        query.__name__ = name
        return query

    return {name: bind(name, plan) for name, plan in _PLANS.items()}
