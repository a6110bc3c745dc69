"""The whole batch: inputs to features, model, coupons and policy totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession

from couponloom.operators.allocation import top_coupons
from couponloom.operators.encode import test_rows, train_rows
from couponloom.operators.facts import facts, facts_fingerprint, in_weeks, input_weeks
from couponloom.operators.features import model_data
from couponloom.operators.histories import cells
from couponloom.operators.policies import compare_policies
from couponloom.operators.scoring import RateScorer, TreeScorer, log_loss
from couponloom.params import Params
from couponloom.sources.tables import Inputs, read_coupons, write_coupons
from couponloom.workspace import stage, weekly_stage


@dataclass(frozen=True)
class Result:
    model_data: DataFrame
    train_log_loss: DataFrame
    coupons: DataFrame
    policies: DataFrame


def run(
    spark: SparkSession,
    inputs: Inputs,
    params: Params,
    output: str,
    source: str,
    scorer: str = "trees",
    iterations: int = 100,
    folder: str | None = None,
) -> Result:
    """Run every step; facts and features are written stages, coupons the output.

    `source` names the version of the inputs: it is part of the stage fingerprint, so
    other inputs never meet stages of these. Facts are staged by week: weeks that the same source
    gains later are added, and the stages built on all facts are then built anew. Inputs that claim
    unique keys and have repeated ones fail the run.
    """
    weeks = input_weeks(inputs)
    data = weekly_stage(
        spark, "facts", facts_fingerprint(params, source), weeks,
        lambda some: facts(in_weeks(inputs, some), params), folder,
    )
    key = params.fingerprint(source, repr(weeks))
    keys = Observation("keys")

    def check() -> None:
        if inputs.unique_keys and (keys.get["most"] or 0) > 1:
            raise ValueError(f"unique_keys is claimed, but a key has {keys.get['most']} rows")

    packed = stage(spark, "cell-maps", key, lambda: cells(data, params, keys), folder, check=check)
    rows = stage(
        spark, "model-data", key, lambda: model_data(data, packed, params, encoded=True), folder,
        partition_by=("week",),
    )
    train, test = train_rows(rows, params), test_rows(rows, params)
    model = (
        TreeScorer(train, iterations, seed=params.seed)
        if scorer == "trees"
        else RateScorer(data, params)
    )

    def rows_at(keys: DataFrame) -> DataFrame:
        return model_data(data, packed, params, [params.test_week], encoded=True, only=keys)

    fitted = model.score(train, {"probability": {}})
    write_coupons(top_coupons(test, model, params), output)
    optimal = read_coupons(spark, output)
    return Result(
        rows,
        log_loss(fitted, "purchased", "probability"),
        optimal,
        compare_policies(test, optimal, model, params, rows_at=rows_at, slots=inputs.coupon_index),
    )
