"""Physical plans: what is shuffled, limited, broadcast and pushed down."""

import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from couponloom.operators.affinity import cluster_positions, cooccurrence
from couponloom.operators.dims import join_dimension
from couponloom.operators.facts import baskets_coupons, facts
from couponloom.operators.features import model_data
from couponloom.operators.histories import cells
from couponloom.operators.panel import panel
from couponloom.params import Params
from couponloom.plans.queries import Star
from couponloom.sources.tables import read_inputs
from tests.helpers import SMALL, frames

QUERIES = entry.queries()
MODELS = {
    "gbt_train_predictions", "gbt_test_scores", "gbt_policy_comparison", "product_embeddings",
    "similar_products", "embedding_projection",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def ancestors(text: str, node: str) -> list[list[str]]:
    """Lines above each line that holds the node, up to the root of the tree."""
    lines = text.splitlines()
    depth = [len(re.match(r"^[\s:|+-]*", line).group()) for line in lines]
    found = []
    for i, line in enumerate(lines):
        if node in line:
            above, level = [], depth[i]
            for j in range(i - 1, -1, -1):
                if depth[j] < level:
                    above.append(lines[j])
                    level = depth[j]
            found.append(above)
    return found


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_opened_panel_rows_are_never_shuffled(spark, no_broadcast):
    data, _ = frames(spark, 1)
    packed = cells(data, SMALL)
    for df in (panel(data, SMALL), panel(data, SMALL, with_history=False), model_data(data, packed, SMALL)):
        opened = ancestors(plan(df), "explode(array_except")
        assert opened
        assert not any("Exchange" in line for above in opened for line in above)


def test_rows_look_their_history_up(spark, sf):
    """No row filters the entries of its whole cell."""
    text = plan(QUERIES["histories"](spark, sf))
    assert "histories#" in text and "items" not in text
    assert not re.search(r"filter\((histories|map_values)", text)
    rows = [line for line in text.splitlines() if "explode(array_except" in line or "AS history#" in line]
    assert rows and not any("filter(" in line for line in rows)


def test_cells_are_dealt_once(spark, no_broadcast):
    """Repeated keys are counted before the shuffle by cell; the two packings above it share that."""
    data, _ = frames(spark, 1)
    text = plan(cells(data, SMALL))
    above = ancestors(text, "REPARTITION_BY_COL")[0]
    assert not any("Exchange" in line for line in above)
    assert "partial_count" in text


def test_ranks_are_limited_before_each_shuffle(spark, sf):
    text = plan(QUERIES["top_coupons"](spark, sf))
    assert len(re.findall(r"WindowGroupLimit .*Partial", text)) == 2
    assert len(re.findall(r"WindowGroupLimit .*Final", text)) == 2
    first = ancestors(text, "explode(array_except")[0]
    exchange = next(i for i, line in enumerate(first) if "Exchange" in line)
    limit = next(i for i, line in enumerate(first) if "WindowGroupLimit" in line)
    assert limit < exchange


def test_no_query_has_a_cross_join_or_row_wise_python(spark, sf):
    for name in sorted(set(QUERIES) - MODELS):
        text = plan(QUERIES[name](spark, sf))
        assert "CartesianProduct" not in text, name
        assert "BroadcastNestedLoopJoin" not in text, name
        assert "BatchEvalPython" not in text, name
        assert "CollectLimit" not in text, name


def test_small_dimensions_are_broadcast_whatever_the_statistics(spark, no_broadcast):
    data, _ = frames(spark, 1)
    text = plan(model_data(data, cells(data, SMALL), SMALL))
    assert text.count("BroadcastHashJoin") >= 4
    large = join_dimension(data, data.groupBy("product").count(), ["product"], 10**9, spread=["shopper"])
    assert "BroadcastHashJoin" not in plan(large)


def test_shopper_filter_and_columns_reach_both_scans(spark, tmp_path):
    spark.createDataFrame([(1, 0, 1, 2.0, "x")], "week int, shopper int, product int, price double, note string").write.parquet(f"{tmp_path}/baskets.parquet")
    spark.createDataFrame([(1, 0, 1, 20.0, 3)], "week int, shopper int, product int, discount double, coupon int").write.parquet(f"{tmp_path}/coupons.parquet")
    text = plan(facts(read_inputs(spark, str(tmp_path), coupon_index=None), Params(n_shoppers=7)))
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert len(scans) >= 2 and all("LessThan(shopper,7)" in line for line in scans)
    assert "note" not in text and "coupon#" not in text


def test_facts_join_keeps_the_partitioning_of_its_inputs(spark, sf, no_broadcast):
    """The full join adds no exchange: both inputs arrive grouped by its key."""
    above = ancestors(plan(QUERIES["clean"](spark, sf)), "HashAggregate(keys=[")
    assert any("SortMergeJoin" in line for line in above[0])
    assert not any("Exchange" in line for line in above[0])


def test_cooccurrence_sums_inside_tasks_before_the_shuffle(spark, sf):
    text = plan(QUERIES["cooccurrence"](spark, sf))
    above = ancestors(text, "MapInArrow")[0]
    assert "partial_sum" in above[0]
    assert "Join" not in "".join(above)


def test_positions_need_no_window_over_all_members(spark):
    clusters = spark.range(1000).selectExpr("cast(id as int) member", "cast(id % 3 as int) cluster")
    text = plan(cluster_positions(clusters))
    above = [line for line in text.splitlines() if "Exchange SinglePartition" in line]
    # One row a range of members comes together.
    assert len(above) == 1 and "partial_count" in text
    assert not any("member" in line for line in above)
    assert "HashAggregate" in "".join(text.splitlines()[text.splitlines().index(above[0]) + 1 : text.splitlines().index(above[0]) + 3])


def test_slices_of_a_hot_group_travel_alone(spark):
    df = spark.range(10).selectExpr("1 week", "cast(id as int) shopper", "cast(id as int) product")
    text = plan(cooccurrence(df, "product"))
    assert "slice(c" in text
    assert not any("c#" in line and "Exchange" in line and "j#" in line for line in text.splitlines())


def test_written_facts_are_sorted_by_week(spark, sf, no_broadcast):
    """Row group statistics can then skip the weeks outside the panel."""
    star = Star(spark, sf)
    files = [path.removeprefix("file:") for path in star.written_facts.inputFiles()]
    for path in files:
        weeks = pq.read_table(path, columns=["week"]).column("week").to_pylist()
        assert weeks == sorted(weeks)


@pytest.fixture
def eager_skew_handling(spark, no_broadcast):
    """Adaptive execution with thresholds that a small test can reach."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1MB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1MB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_hot_key_of_the_purchase_offer_join_is_split(spark, eager_skew_handling):
    def rows(n, name):
        key = [(F.col("id") % 90).cast("int").alias("week"), (F.col("id") / 90).cast("int").alias("shopper")]
        return spark.range(n).select(*key, F.lit(1).alias("product"), F.rand(1).alias(name))

    hot = spark.range(450_000).select(
        F.lit(5).alias("week"), F.lit(3).alias("shopper"), F.lit(1).alias("product"), F.rand(2).alias("price")
    )
    baskets = rows(900_000, "price").union(hot).repartition(12)
    joined = baskets_coupons(baskets, rows(600_000, "discount").repartition(12))
    execution = joined._jdf.queryExecution()
    assert execution.toRdd().count() == 1_350_000
    assert "skew=true" in execution.executedPlan().toString()
