"""Profile of numeric columns and the narrowest type that holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Exclusive bounds of the integer types, narrowest first.
INTEGER_BOUNDS = (
    ("tinyint", -128, 127),
    ("smallint", -32768, 32767),
    ("int", -2147483648, 2147483647),
)
# Fixed value: largest finite 32-bit float.
FLOAT_MAX = 3.4028234663852886e38
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)


def profile(df: DataFrame) -> DataFrame:
    """(column_name, min_value, max_value) of all numeric columns in one pass."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, _INTEGERS + _FLOATS)]
    bounds = df.agg(
        F.array(*[
            F.struct(
                F.lit(c).alias("column_name"),
                F.min(c).cast("double").alias("min_value"),
                F.max(c).cast("double").alias("max_value"),
            )
            for c in numeric
        ]).alias("bounds")
    )
    return bounds.select(F.inline("bounds"))


def narrowest(schema: T.StructType, bounds: dict[str, tuple[float, float]]) -> dict[str, str]:
    """The narrowest type of each column that has bounds and a narrower type. There is no half type."""

    def target(name: str) -> str | None:
        low, high = bounds[name]
        if isinstance(schema[name].dataType, _FLOATS):
            return "float" if -FLOAT_MAX < low and high < FLOAT_MAX else None
        return next((t for t, lo, hi in INTEGER_BOUNDS if lo < low and high < hi), None)

    targets = {c: target(c) for c in schema.names if c in bounds}
    return {c: t for c, t in targets.items() if t}


def narrow_to(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    return df.select(*[
        F.col(c).cast(targets[c]).alias(c) if c in targets else F.col(c) for c in df.columns
    ])


def narrow(df: DataFrame) -> DataFrame:
    """Cast integers to the narrowest type and doubles in float range to float.

    Needs the one-row profile first, so it runs a job; files are narrowed by their footers
    as they are read, see sources.tables.
    """
    numeric = [f.name for f in df.schema if isinstance(f.dataType, _INTEGERS + _FLOATS)]
    row = df.agg(
        *[F.min(c).alias(f"{c}_min") for c in numeric], *[F.max(c).alias(f"{c}_max") for c in numeric]
    ).first()
    bounds = {c: (row[f"{c}_min"], row[f"{c}_max"]) for c in numeric if row[f"{c}_min"] is not None}
    return narrow_to(df, narrowest(df.schema, bounds))
