"""Baskets and coupons derived from a lineitem / orders / part star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from couponloom.params import Params
from couponloom.sources.tables import BASKETS, COUPONS, Inputs, conform

DAYS_PER_WEEK = 26
N_PRODUCTS = 100
CUSTOMERS_PER_SHOPPER = 15
# Lines of a task where their shuffles would get larger ones.
LINES_PER_TASK = 500_000
# Columns read of each table; a given schema saves the inference job.
SCHEMAS = {
    "customer": "c_custkey bigint",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_discount double, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "part": "p_partkey bigint, p_retailprice double",
}


def star_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def star_params(spark: SparkSession, sf_dir: str, **changes) -> Params:
    """Parameters that fit the derived tables; the shopper count follows customer."""
    customers = star_table(spark, sf_dir, "customer").count()
    shoppers = max(1, customers // CUSTOMERS_PER_SHOPPER)
    values = dict(
        n_shoppers=shoppers, n_products=N_PRODUCTS, total_baskets=shoppers, price_scale=1
    )
    return Params(**{**values, **changes})


def _week(day) -> F.Column:
    days = F.datediff(F.to_date(day), F.lit("1995-01-01").cast("date"))
    return F.floor(days / F.lit(DAYS_PER_WEEK)).cast("int")


def line_tasks(lines: int, default: int) -> int | None:
    """Partitions of the shuffles of so many lines, so that a task's memory does not grow with the input.

    None where the session's own number is enough.
    """
    needed = -(-lines // LINES_PER_TASK)
    return needed if needed > default else None


def observations(spark: SparkSession, sf_dir: str, n_shoppers: int) -> DataFrame:
    """One row per (week, shopper, product): list price when bought, percent when offered.

    A line gives its purchase and, for the small discounts, an offer in its ship
    week; both are combined in the one aggregation.
    """
    lineitem = star_table(spark, sf_dir, "lineitem")
    orders = star_table(spark, sf_dir, "orders")
    part = star_table(spark, sf_dir, "part")
    cut = F.round(F.col("l_discount") * 100).cast("int")
    tasks = line_tasks(lineitem.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def dealt(df: DataFrame, *by: str) -> DataFrame:
        return df if tasks is None else df.repartition(tasks, *by)

    sold = lineitem.select("l_orderkey", "l_partkey", cut.alias("cut"), _week("l_shipdate").alias("ship_week"))
    ordered = orders.select("o_orderkey", "o_custkey", _week("o_orderdate").alias("week"))
    lines = (
        dealt(sold, "l_orderkey")
        .join(dealt(ordered, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part.select("p_partkey", F.round(F.col("p_retailprice") * 10).cast("long").alias("tenths")),
              F.col("l_partkey") == F.col("p_partkey"))
    )
    bought = F.struct(
        F.col("week").alias("week"),
        F.col("tenths").alias("tenths"),
        F.when(F.col("cut").between(7, 10), (F.col("cut") - 4) * 5).alias("percent"),
    )
    offered = F.struct(
        F.col("ship_week").alias("week"),
        F.lit(None).cast("long").alias("tenths"),
        ((F.col("cut") + 2) * 5).alias("percent"),
    )
    seen = lines.select(
        (F.col("o_custkey") % n_shoppers).cast("int").alias("shopper"),
        (F.col("l_partkey") % N_PRODUCTS).cast("int").alias("product"),
        F.explode(
            F.when(F.col("cut").between(1, 4), F.array(bought, offered)).otherwise(F.array(bought))
        ).alias("seen"),
    ).select("shopper", "product", "seen.*")
    return (
        dealt(seen, "week", "shopper", "product")
        .groupBy("week", "shopper", "product")
        .agg(F.min("tenths").alias("tenths"), F.max("percent").alias("percent"))
    )


def star_inputs(spark: SparkSession, sf_dir: str, n_shoppers: int) -> Inputs:
    seen = observations(spark, sf_dir, n_shoppers)
    paid = F.col("tenths") * (100 - F.coalesce("percent", F.lit(0))) / F.lit(1000.0)
    baskets = seen.filter(F.col("tenths").isNotNull()).withColumn("price", paid)
    coupons = seen.filter(F.col("percent").isNotNull()).withColumnRenamed("percent", "discount")
    return Inputs(conform(baskets, BASKETS), conform(coupons, COUPONS), unique_keys=True)
