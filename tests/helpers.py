"""Small inputs and brute-force versions of the panel statistics."""

from __future__ import annotations

import itertools
import random

import pandas as pd

from couponloom.operators.facts import facts
from couponloom.params import Params
from couponloom.sources.tables import BASKETS, COUPONS, Inputs

SMALL = Params(
    test_week=6,
    train_window=2,
    n_shoppers=3,
    n_products=25,
    n_coupons=2,
    trend_windows=(1, 3),
    total_baskets=100,
)


def inputs(spark, baskets, coupons) -> Inputs:
    return Inputs(
        spark.createDataFrame(baskets, BASKETS), spark.createDataFrame(coupons, COUPONS)
    )


def random_rows(seed: int, repeats: int = 2):
    """Baskets and coupons with ids outside the domain, repeated keys and null prices."""
    rng = random.Random(seed)
    baskets, coupons = [], []
    for _ in range(160):
        key = (rng.randrange(9), rng.randrange(4), rng.randrange(27))
        baskets += [(*key, rng.choice([8.5, 10.0, 12.0]))] * rng.choice([1] * 6 + [repeats])
        if rng.random() < 0.6:
            coupons += [(*key, float(rng.choice([0, 15, 20, 25, 30])))] * rng.choice([1] * 6 + [repeats])
    for _ in range(60):
        coupons.append((rng.randrange(9), rng.randrange(4), rng.randrange(27), float(rng.choice([15, 30]))))
    return baskets, coupons


def frames(spark, seed: int, params: Params = SMALL):
    given = inputs(spark, *random_rows(seed))
    data = facts(given, params)
    return data, data.toPandas()


def dense(facts_pd: pd.DataFrame, params: Params, products: int | None = None) -> pd.DataFrame:
    """The panel by an outer product and a merge."""
    products = params.n_products if products is None else products
    keys = pd.DataFrame(
        itertools.product(params.panel_weeks, range(params.n_shoppers), range(products)),
        columns=["week", "shopper", "product"],
    )
    merged = keys.merge(facts_pd, how="left", on=["week", "shopper", "product"])
    merged["discount"] = merged["discount"].fillna(0.0)
    merged["purchased"] = merged["purchased"].fillna(0).astype(int)
    return merged


def rows(frame: pd.DataFrame, columns: list[str], digits: int = 9) -> list[tuple]:
    """Sorted rows with rounded floats and None for missing values."""

    def cell(v):
        if v is None or v != v:
            return None
        return round(float(v), digits) + 0.0

    values = [tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False)]
    return sorted(values, key=lambda r: [(v is None, v or 0.0) for v in r])
