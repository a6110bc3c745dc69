"""Narrowing on read: bounds from footers, scans only where footers do not tell."""

import math

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from couponloom.sources import bounds
from couponloom.sources.tables import BASKETS, read_inputs
from tests.helpers import SMALL
from couponloom.operators.facts import facts


def basket_rows(low, high):
    return {"week": [1, 2, high], "shopper": [low, 5, 300], "product": [7, 8, 9], "price": [1.5, None, 2.5]}


def write(folder, name, *files, statistics=lambda i: True, types=None):
    (folder / name).mkdir(parents=True)
    for i, columns in enumerate(files):
        kinds = {"price": pa.float64(), "discount": pa.float64()} | (types or {})
        table = pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in columns.items()})
        pq.write_table(table, folder / name / f"part-{i}.parquet", write_statistics=statistics(i), compression="none")


COUPONS = {"week": [1, 2], "shopper": [3, 4], "product": [40_000, 1], "discount": [15.0, 30.0]}


def types(df):
    return dict(df.dtypes)


def destroy_data(path):
    """Zeros in place of all data pages, so that only the footer can be read."""
    content = bytearray(path.read_bytes())
    footer = int.from_bytes(content[-8:-4], "little") + 8
    content[4:-footer] = bytes(len(content) - footer - 4)
    path.write_bytes(content)


def test_footers_are_enough(spark, tmp_path):
    write(tmp_path, "baskets.parquet", basket_rows(0, 90), basket_rows(-3, 100))
    write(tmp_path, "coupons.parquet", COUPONS)
    for path in tmp_path.glob("*/*.parquet"):
        destroy_data(path)
    got = read_inputs(spark, str(tmp_path), coupon_index=None, narrow=True)
    assert types(got.baskets) == {"week": "tinyint", "shopper": "smallint", "product": "int", "price": "float"}
    # Key columns have one type in all tables.
    assert types(got.coupons) == {"week": "tinyint", "shopper": "smallint", "product": "int", "discount": "float"}
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        got.baskets.collect()


def test_only_files_without_statistics_are_scanned(spark, tmp_path, monkeypatch):
    write(
        tmp_path, "baskets.parquet", basket_rows(0, 90), basket_rows(-200, 91), basket_rows(0, 92), basket_rows(0, 93),
        statistics=lambda i: i != 1,
    )
    write(tmp_path, "coupons.parquet", COUPONS)
    for path in tmp_path.glob("baskets.parquet/part-[023].parquet"):
        destroy_data(path)
    seen = []
    scan = bounds.scanned
    monkeypatch.setattr(bounds, "scanned", lambda df, columns: seen.append(df.inputFiles()) or scan(df, columns))
    got = read_inputs(spark, str(tmp_path), coupon_index=None, narrow=True)
    assert types(got.baskets)["shopper"] == "smallint"
    assert [[f.rsplit("/", 1)[1] for f in files] for files in seen] == [["part-1.parquet"]]


def test_nan_nulls_other_types_and_empty_tables(spark, tmp_path):
    rows = {"week": [1, 2], "shopper": [None, None], "product": ["7", "300"], "price": [math.nan, 2.0]}
    write(tmp_path, "baskets.parquet", rows, types={"product": pa.string(), "shopper": pa.int32()})
    write(tmp_path, "coupons.parquet", {c: [] for c in COUPONS})
    got = read_inputs(spark, str(tmp_path), coupon_index=None, narrow=True)
    # A column without any value keeps its type.
    assert types(got.baskets) == {"week": "tinyint", "shopper": "int", "product": "smallint", "price": "float"}
    assert {tuple(r) for r in got.baskets.collect()} == {(1, None, 7, None), (2, None, 300, 2.0)}
    assert got.coupons.count() == 0 and types(got.coupons)["discount"] == "double"


def test_partition_columns_are_bounded_too(spark, tmp_path):
    frame = spark.createDataFrame([(1, 2, 3, 4.0), (200, 2, 3, 4.0)], BASKETS)
    frame.write.partitionBy("week").parquet(f"{tmp_path}/baskets.parquet")
    write(tmp_path, "coupons.parquet", COUPONS)
    got = read_inputs(spark, str(tmp_path), coupon_index=None, narrow=True)
    assert types(got.baskets)["week"] == "smallint" and got.baskets.count() == 2


def test_narrow_inputs_give_the_same_facts(spark, tmp_path):
    baskets = {"week": [4, 5, 6, 6], "shopper": [0, 1, 2, 2], "product": [1, 2, 24, 24], "price": [8.5, 10.0, 12.0, 0.5]}
    coupons = {"week": [4, 6, 6], "shopper": [0, 2, 1], "product": [1, 24, 3], "discount": [20.0, 50.0, 30.0]}
    write(tmp_path, "baskets.parquet", baskets)
    write(tmp_path, "coupons.parquet", coupons)
    plain, small = (facts(read_inputs(spark, str(tmp_path), coupon_index=None, narrow=n), SMALL) for n in (False, True))
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, small.collect()), key=str)
