"""Purchase probability scorers.

A scorer adds one probability column per scenario to a frame of panel rows. A scenario
is a set of column overrides, so what-if discounts are scored side by side on the same
row and no row is copied or joined to itself.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from couponloom.functions.columns import percent_of
from couponloom.operators.boosting import MOST_DEPTH, BoostedTrees, boosted_trees
from couponloom.operators.dims import join_dimension
from couponloom.operators.features import feature_names
from couponloom.operators.panel import dense_counts
from couponloom.params import Params
from couponloom.workspace import enable_checkpoints

# A product's rates: a hundred percents of 24 bytes and some room.
MAP_BYTES = 4_096
# Training rows up to which trees are fitted by Spark's GBTClassifier.
SPARK_ROWS = 1_000_000
# Weight of every tree but the first.
STEP = 0.1

Scenarios = Mapping[str, Mapping[str, Column]]

# Features that are null where the data has no evidence.
NULLABLE = (
    "price", "product_freq", "shopper_redemption_rate", "product_redemption_rate", "elasticities",
)
# Output columns of the trees, dropped once the probability is read.
_OUTPUTS = {
    "rawPredictionCol": "tree_raw",
    "probabilityCol": "tree_probability",
    "predictionCol": "tree_prediction",
}


def purchase_rates(data: DataFrame, params: Params, products: int | None = None) -> DataFrame:
    """(product, percent, probability) over the training rows, smoothed by one and two."""
    counts = dense_counts(data, params, "product", params.train_weeks, products)
    probability = (F.col("purchases") + F.lit(1.0)) / (F.col("n_rows") + F.lit(2.0))
    return counts.filter("n_rows > 0").select("product", "percent", probability.alias("probability"))


class RateScorer:
    """Purchase rate of the product at the discount; 0.5 for an unseen combination."""

    def __init__(self, data: DataFrame, params: Params):
        self.params = params
        # One map per product with the percents it was offered at.
        self.rates = (
            purchase_rates(data, params, params.model_products)
            .groupBy("product")
            .agg(F.map_from_entries(F.collect_list(F.struct("percent", "probability"))).alias("rates"))
        )

    def score(self, rows: DataFrame, scenarios: Scenarios) -> DataFrame:
        joined = join_dimension(
            rows, self.rates, ["product"], self.params.model_products, spread=["shopper", "week"],
            row_bytes=MAP_BYTES,
        )
        columns = {
            name: F.coalesce(
                F.try_element_at("rates", percent_of(overrides.get("discount", F.col("discount")))),
                F.lit(0.5),
            )
            for name, overrides in scenarios.items()
        }
        return joined.withColumns(columns).drop("rates")


class TreeScorer:
    """Gradient-boosted trees on the panel features.

    Spark's trainer passes over every row and feature 500 times, so beyond `spark_rows` training rows the
    same trees are fitted on binned rows, see operators.boosting. Those draw nothing, so `seed` is for Spark's.
    """

    def __init__(
        self,
        train: DataFrame,
        iterations: int = 100,
        depth: int = 5,
        seed: int = 42,
        spark_rows: int = SPARK_ROWS,
    ):
        enable_checkpoints(train.sparkSession)
        self.features = feature_names(train)
        self.model: GBTClassificationModel | None = None
        self.trees: BoostedTrees | None = None
        label = F.col("purchased").cast("double")
        if depth <= MOST_DEPTH and train.count() > spark_rows:
            columns = self._columns({})
            prepared = train.select(*[c.alias(n) for n, c in columns.items()], label.alias("purchased"))
            self.trees = boosted_trees(prepared, list(columns), "purchased", iterations, depth, STEP)
            return
        prepared = self._assemble(train, {}).select("features", label)
        trees = GBTClassifier(
            labelCol="purchased",
            featuresCol="features",
            maxIter=iterations,
            maxDepth=depth,
            stepSize=STEP,
            seed=seed,
            checkpointInterval=10,
        )
        trees.setRawPredictionCol(_OUTPUTS["rawPredictionCol"])
        trees.setProbabilityCol(_OUTPUTS["probabilityCol"])
        trees.setPredictionCol(_OUTPUTS["predictionCol"])
        self.model = trees.fit(prepared)

    def _columns(self, overrides: Mapping[str, Column]) -> dict[str, Column]:
        """Filled features and a 0/1 flag for each feature that may be null."""
        value = {c: overrides.get(c, F.col(c)).cast("double") for c in self.features}
        inputs = {f"f_{c}": F.coalesce(v, F.lit(0.0)) for c, v in value.items()}
        flags = {f"f_{c}_missing": value[c].isNull().cast("double") for c in NULLABLE if c in value}
        return {**inputs, **flags}

    def _assemble(self, rows: DataFrame, overrides: Mapping[str, Column]) -> DataFrame:
        columns = self._columns(overrides)
        assembler = VectorAssembler(inputCols=list(columns), outputCol="features")
        return assembler.transform(rows.withColumns(columns)).drop(*columns)

    def score(self, rows: DataFrame, scenarios: Scenarios) -> DataFrame:
        if self.trees is not None:
            probability = self.trees.probability()
            return rows.withColumns({
                name: probability(*self._columns(overrides).values()) for name, overrides in scenarios.items()
            })
        for name, overrides in scenarios.items():
            scored = self.model.transform(self._assemble(rows, overrides))
            probability = vector_to_array(_OUTPUTS["probabilityCol"])[1]
            rows = scored.withColumn(name, probability).drop("features", *_OUTPUTS.values())
        return rows


def log_loss(df: DataFrame, label: str, probability: str, weight: str | None = None) -> DataFrame:
    """Mean negative log likelihood, probabilities clipped away from 0 and 1."""
    eps = 1e-15
    p = F.greatest(F.least(F.col(probability), F.lit(1 - eps)), F.lit(eps))
    y = F.col(label).cast("double")
    loss = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    if weight is None:
        return df.agg(F.avg(loss).alias("log_loss"))
    w = F.col(weight).cast("double")
    return df.agg((F.sum(w * loss) / F.sum(w)).alias("log_loss"))
