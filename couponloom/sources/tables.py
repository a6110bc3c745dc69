"""Input tables and the coupon sink."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from couponloom.operators.narrow import narrow_to, narrowest
from couponloom.sources.bounds import Bounds, common_bounds, file_bounds

BASKETS = T.StructType([
    T.StructField("week", T.IntegerType()),
    T.StructField("shopper", T.IntegerType()),
    T.StructField("product", T.IntegerType()),
    T.StructField("price", T.DoubleType()),
])
# The slot number of a past coupon is not read: it would become a model feature.
COUPONS = T.StructType([
    T.StructField("week", T.IntegerType()),
    T.StructField("shopper", T.IntegerType()),
    T.StructField("product", T.IntegerType()),
    T.StructField("discount", T.DoubleType()),
])
COUPON_INDEX = T.StructType([
    T.StructField("shopper", T.IntegerType()),
    T.StructField("week", T.IntegerType()),
    T.StructField("coupon", T.IntegerType()),
])
OPTIMAL_COUPONS = T.StructType([
    T.StructField("shopper", T.LongType()),
    T.StructField("week", T.LongType()),
    T.StructField("coupon", T.LongType()),
    T.StructField("product", T.LongType()),
    T.StructField("discount", T.DoubleType()),
])


@dataclass(frozen=True)
class Inputs:
    baskets: DataFrame
    coupons: DataFrame
    coupon_index: DataFrame | None = None
    # True where both tables are known to hold a (week, shopper, product) once.
    unique_keys: bool = False


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema in its order and types, NaN as null."""

    def column(field: T.StructField):
        value = F.col(field.name).cast(field.dataType)
        if isinstance(df.schema[field.name].dataType, (T.FloatType, T.DoubleType)):
            value = F.when(~F.isnan(field.name), value)
        return value.alias(field.name)

    return df.select(*[column(field) for field in schema])


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return conform(spark.read.parquet(path), schema)


def _bounds(spark: SparkSession, path: str, schema: T.StructType) -> Bounds:
    def use(raw: DataFrame, columns: list[str]) -> DataFrame:
        return conform(raw, T.StructType([schema[c] for c in columns]))

    return file_bounds(spark.read.parquet(path), schema.names, use)


def read_inputs(
    spark: SparkSession,
    folder: str,
    baskets: str = "baskets.parquet",
    coupons: str = "coupons.parquet",
    coupon_index: str | None = "coupon_index.parquet",
    narrow: bool = False,
) -> Inputs:
    """The input tables; with `narrow` in the narrowest types that hold their values.

    Values are then bounded by the files' footers, so no job reads data where those
    suffice. A column that several tables have gets one type in all of them, so joins need no casts.
    """
    paths = {f"{folder}/{baskets}": BASKETS, f"{folder}/{coupons}": COUPONS}
    if coupon_index is not None:
        paths[f"{folder}/{coupon_index}"] = COUPON_INDEX
    tables = [read_table(spark, path, schema) for path, schema in paths.items()]
    if narrow:
        bounds = common_bounds([_bounds(spark, path, schema) for path, schema in paths.items()])
        tables = [narrow_to(table, narrowest(table.schema, bounds)) for table in tables]
    return Inputs(*tables)


def write_coupons(coupons: DataFrame, path: str) -> None:
    conform(coupons, OPTIMAL_COUPONS).write.mode("overwrite").parquet(path)


def read_coupons(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OPTIMAL_COUPONS).parquet(path)
