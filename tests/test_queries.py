"""Every registered query against its reference SQL."""

import duckdb
import pytest
from pathlib import Path

import __spark_entry__ as entry
from tools.check import difference

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert difference(got, con.execute(ORACLES[name]).df()) is None
    assert len(got) > 0


def test_entry_is_lazy_and_typed(spark):
    coupons = entry.entry(spark)
    assert coupons.columns == ["shopper", "week", "coupon", "product", "discount"]
    assert [t for _, t in coupons.dtypes] == ["bigint"] * 4 + ["double"]
    assert coupons.count() > 0
