"""Train/test split and weight-of-evidence encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponloom.operators.panel import dense_counts
from couponloom.params import Params


def train_rows(df: DataFrame, params: Params) -> DataFrame:
    return df.filter((F.col("week") >= params.start_week) & (F.col("week") < params.test_week))


def test_rows(df: DataFrame, params: Params) -> DataFrame:
    return df.filter(F.col("week") == params.test_week)


def woe(data: DataFrame, params: Params, by: str, products: int | None = None) -> DataFrame:
    """Weight of evidence of each shopper or product over the training rows.

    ln(((pos + 1) / (P + 2)) / ((neg + 1) / (N + 2))), zero for a value seen once.
    Both totals enter as one scalar subquery.
    """
    counts = (
        dense_counts(data, params, by, params.train_weeks, products)
        .groupBy(by)
        .agg(F.sum("n_rows").alias("n"), F.sum("purchases").alias("pos"))
    )
    totals = counts.agg(
        F.struct(F.sum("pos").cast("double").alias("pos"), F.sum("n").cast("double").alias("n"))
    ).scalar()
    positives = totals["pos"]
    negatives = totals["n"] - positives
    evidence = F.log(
        ((F.col("pos") + F.lit(1.0)) / (positives + 2.0))
        / ((F.col("n") - F.col("pos") + F.lit(1.0)) / (negatives + 2.0))
    )
    return counts.select(by, F.when(F.col("n") > 1, evidence).otherwise(0.0).alias(f"{by}_WOE"))
