"""Least and largest values of Parquet columns, from the footers where those hold them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Types whose least and largest value Spark takes from footers.
_STATED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
# Files without statistics are told from the others down to this part of all files.
SMALLEST_PART = 64

Bounds = dict[str, tuple[float, float]]


def footer_session(spark: SparkSession) -> SparkSession:
    """A session of the same application in which min, max and count are answered by footers."""
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session


def _extremes(df: DataFrame, columns: list[str]) -> DataFrame:
    ends = [F.min(c).alias(f"{c}_min") for c in columns] + [F.max(c).alias(f"{c}_max") for c in columns]
    return df.agg(F.count("*").alias("n"), *ends)


def scanned(df: DataFrame, columns: list[str]) -> Row:
    """Bounds by reading the rows."""
    return _extremes(df, columns).first()


def _from_footers(session: SparkSession, files: list[str], schema: T.StructType, columns: list[str]) -> tuple[list[Row], list[str]]:
    """Bounds of groups of files by their footers, and the files whose footers do not tell.

    A file that lacks a statistic is skipped by the first job; the row count, which every footer has, then
    differs and the group is halved, down to one file or to a `SMALLEST_PART`th of very many.
    """
    smallest = max(1, len(files) // SMALLEST_PART)
    found, unknown, groups = [], [], [files]
    while groups:
        group = groups.pop()
        lenient = session.read.option("ignoreCorruptFiles", "true").schema(schema).parquet(*group)
        told = _extremes(lenient, columns)
        if "PushedAggregation: [" not in told._jdf.queryExecution().executedPlan().toString():
            return [], files
        row = told.first()
        rows = session.read.schema(schema).parquet(*group).agg(F.count("*")).first()[0]
        if row["n"] == rows:
            found.append(row)
        elif len(group) <= smallest:
            unknown += group
        else:
            half = len(group) // 2
            groups += [group[:half], group[half:]]
    return found, unknown


def _merged(rows: list[Row], columns: list[str]) -> Bounds:
    return common_bounds([
        {c: (row[f"{c}_min"], row[f"{c}_max"]) for c in columns if row[f"{c}_min"] is not None} for row in rows
    ])


def _joined(one: Bounds, two: Bounds) -> Bounds:
    out = dict(one)
    for c, (low, high) in two.items():
        held = out.get(c, (low, high))
        out[c] = min(held[0], low), max(held[1], high)
    return out


def file_bounds(raw: DataFrame, columns: list[str], use: Callable[[DataFrame, list[str]], DataFrame]) -> Bounds:
    """(least, largest) value of each column of a Parquet table; none for a column without values.

    No job reads data where the footers suffice. What they do not tell is scanned as `use(rows, columns)`
    gives it: columns that the files hold in a type without bounds, and all told columns of files
    without statistics. Footers leave out NaN, so `use` has to.
    """
    spark = raw.sparkSession
    files = list(raw.inputFiles())
    if not files:
        return {}
    told = [c for c in columns if isinstance(raw.schema[c].dataType, _STATED)]
    others = [c for c in columns if c not in told]
    schema = T.StructType([raw.schema[c] for c in told])
    found, unknown = _from_footers(footer_session(spark), files, schema, told) if told else ([], [])
    bounds = _merged(found, told)
    if unknown:
        part = raw if len(unknown) == len(files) else spark.read.schema(schema).parquet(*unknown)
        bounds = _joined(bounds, _merged([scanned(use(part, told), told)], told))
    return _joined(bounds, _merged([scanned(use(raw, others), others)], others)) if others else bounds


def common_bounds(tables: list[Bounds]) -> Bounds:
    """Bounds of equally named columns over several tables."""
    return reduce(_joined, tables, {})
