"""Joins of a large frame with a dimension of known size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bound of what is broadcast: so many rows of ROW_BYTES each.
BROADCAST_ROWS = 500_000
ROW_BYTES = 64
SALTS = 32


def join_dimension(
    df: DataFrame,
    dim: DataFrame,
    on: list[str],
    max_rows: int,
    how: str = "left",
    spread: list[str] | None = None,
    row_bytes: int = ROW_BYTES,
) -> DataFrame:
    """Join a dimension with at most max_rows rows, unique per key.

    Up to the bytes of BROADCAST_ROWS short rows the dimension is broadcast; `row_bytes` is
    the size of a row of this one. Beyond, it is repeated once per
    salt and the large side is spread over the salts by its `spread` columns, so one
    hot key is shared by many tasks.
    """
    if max_rows * row_bytes <= BROADCAST_ROWS * ROW_BYTES:
        return df.join(F.broadcast(dim), on, how)
    salted = dim.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(*(spread or df.columns)), F.lit(SALTS)).cast("int")
    return df.withColumn("salt", salt).join(salted, [*on, "salt"], how).drop("salt")
