"""Written stages: whole or not at all."""

import pytest

from couponloom.operators.encode import test_rows as in_test_week
from couponloom.params import Params
from couponloom.workspace import (
    content_fingerprint,
    private_folders,
    private_stage,
    release,
    stage,
    weekly_stage,
)


def test_a_half_written_stage_is_built_again(spark, tmp_path):
    path = tmp_path / "stages" / "x-1"
    spark.range(3).write.parquet(str(path))
    (path / "_SUCCESS").unlink()
    got = stage(spark, "x", "1", lambda: spark.range(10), str(tmp_path))
    assert got.count() == 10
    assert stage(spark, "x", "1", lambda: pytest.fail("built twice"), str(tmp_path)).count() == 10
    assert not list((tmp_path / "stages" / "building").iterdir())


def test_a_failed_build_leaves_no_stage(spark, tmp_path):
    def broken():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        stage(spark, "x", "1", broken, str(tmp_path))
    assert stage(spark, "x", "1", lambda: spark.range(4), str(tmp_path)).count() == 4


def test_the_first_of_two_builders_wins(spark, tmp_path):
    def late():
        stage(spark, "x", "1", lambda: spark.range(2), str(tmp_path))
        return spark.range(9)

    assert stage(spark, "x", "1", late, str(tmp_path)).count() == 2


def test_features_are_pruned_by_week(spark, tmp_path):
    rows = spark.range(300).selectExpr("id as shopper", "cast(85 + id % 6 as int) as week")
    for frame in (
        stage(spark, "rows", "1", lambda: rows, str(tmp_path), partition_by=("week",)),
        private_stage(spark, "rows", lambda: rows, ("week",)),
    ):
        test = in_test_week(frame, Params())
        plan = test._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(week" in plan and test.count() == 50


def weekly(spark, folder, weeks, calls, rows=None):
    rows = rows or [(1, "a"), (1, "b"), (2, "c"), (4, "d"), (None, "e")]
    frame = spark.createDataFrame([(x, w) for w, x in rows], "x string, week int")

    def build(some):
        calls.append(list(some))
        wanted = frame.week.isin([w for w in some if w is not None])
        return frame.filter(wanted | frame.week.isNull() if None in some else wanted)

    return weekly_stage(spark, "rows", "1", weeks, build, str(folder))


def folders(folder):
    return {p.name: p.stat().st_mtime_ns for p in (folder / "stages" / "rows-1").iterdir()}


def test_only_missing_weeks_are_built(spark, tmp_path):
    calls = []
    first = weekly(spark, tmp_path, [1, 2, 3], calls)
    assert sorted(map(tuple, first.collect())) == [("a", 1), ("b", 1), ("c", 2)]
    before = folders(tmp_path)
    assert set(before) == {"week=1", "week=2", "week=3"}
    again = weekly(spark, tmp_path, [1, 2, 3, 4], calls)
    assert sorted(map(tuple, again.collect())) == [("a", 1), ("b", 1), ("c", 2), ("d", 4)]
    after = folders(tmp_path)
    assert {k: v for k, v in after.items() if k in before} == before and set(after) - set(before) == {"week=4"}
    assert calls == [[1, 2, 3], [4]]
    assert again.columns == ["x", "week"] and dict(again.dtypes)["week"] == "int"
    some = weekly(spark, tmp_path, [2, None], calls)
    assert sorted(map(tuple, some.collect()), key=str) == [("c", 2), ("e", None)]
    assert weekly(spark, tmp_path, [], calls).count() == 0
    assert not list((tmp_path / "stages" / "building").iterdir())


def test_a_week_without_a_marker_is_built_again(spark, tmp_path):
    calls = []
    weekly(spark, tmp_path, [1, 2], calls)
    (tmp_path / "stages" / "rows-1" / "week=2" / "_SUCCESS").unlink()
    assert weekly(spark, tmp_path, [1, 2], calls).count() == 3
    assert calls[-1] == [2]


def test_a_failed_check_publishes_nothing(spark, tmp_path):
    def refuse():
        raise ValueError("not so")

    with pytest.raises(ValueError):
        stage(spark, "x", "1", lambda: spark.range(3), str(tmp_path), check=refuse)
    assert stage(spark, "x", "1", lambda: spark.range(4), str(tmp_path)).count() == 4


def test_content_fingerprint_sees_rows_and_not_their_order(spark):
    rows = [(1, "a"), (2, None), (2, None)]
    made = [content_fingerprint(spark.createDataFrame(r, "a int, b string")) for r in (rows, rows[::-1], rows[:2], [*rows, (2, None)])]
    assert made[0] == made[1] and len(set(made)) == 3
    assert content_fingerprint(spark.createDataFrame(rows, "a int, b string"), "more") != made[0]


def test_private_stages_can_be_removed(spark):
    frame = private_stage(spark, "gone", lambda: spark.range(5))
    folder = frame.inputFiles()[0].removeprefix("file:").removeprefix("//").rsplit("/", 1)[0]
    from pathlib import Path

    assert Path(folder).exists()
    release(spark)
    assert not Path(folder).exists()


def test_only_later_folders_are_released(spark):
    early = private_stage(spark, "early", lambda: spark.range(1))
    since = private_folders(spark)
    late, kept = (private_stage(spark, name, lambda: spark.range(2)) for name in ("late", "kept"))
    release(spark, since, kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://"))
    assert early.count() == 1 and kept.count() == 2 and private_folders(spark) == since + 1
    with pytest.raises(Exception):
        late.collect()
    release(spark)
    assert private_folders(spark) == 0
