"""Skip-gram product embeddings."""

from __future__ import annotations

from pyspark.ml.feature import PCA, Word2Vec, Word2VecModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponloom.operators.affinity import context_lists
from couponloom.operators.nearest import BLOCK_ROWS, nearest
from couponloom.workspace import content_fingerprint, private_stage, stage_folder

MIN_COUNT = 2
DIMENSIONS = 100
SEED = 42
# Partitions of the training at least, and rows of baskets of each where that gives more.
PARTITIONS = 8
ROWS_PER_PARTITION = 1_000_000
DEFAULT_MAX_SENTENCE = 1_000


def train_embeddings(
    baskets: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED, partitions: int = PARTITIONS
) -> Word2VecModel:
    """Skip-gram over basket lists; the window is the longest list.

    Partitions are fixed in number and content, so the size of the cluster does not enter;
    what is left open is the trainer's order of words that are equally frequent.
    """
    dealt = context_lists(baskets).repartition(partitions, F.xxhash64("items"))
    lists = dealt.sortWithinPartitions("items").persist()
    try:
        longest = lists.agg(F.max(F.size("items"))).first()[0] or 1
        return Word2Vec(
            inputCol="items",
            outputCol="vector",
            vectorSize=dimensions,
            minCount=MIN_COUNT,
            windowSize=longest,
            maxSentenceLength=max(longest, DEFAULT_MAX_SENTENCE),
            numPartitions=partitions,
            seed=seed,
        ).fit(lists)
    finally:
        lists.unpersist()


def load_or_train(baskets: DataFrame, folder: str | None = None, **kwargs) -> Word2VecModel:
    """The model of these baskets and parameters, trained where the folder has none.

    The path carries a fingerprint of both, and a model is published whole: other baskets never meet
    it, and one that a lost job left half written is trained again. The baskets are written once for the
    passes over them. Partitions follow from their rows, so the training has tasks for more cores.
    """
    spark = baskets.sparkSession
    read = private_stage(spark, "baskets", lambda: baskets.select("week", "shopper", "product"))
    partitions = max(PARTITIONS, -(-read.count() // ROWS_PER_PARTITION))
    options = {"dimensions": DIMENSIONS, "seed": SEED, "partitions": partitions} | kwargs
    key = content_fingerprint(read, repr(sorted(options.items())), f"{MIN_COUNT} {DEFAULT_MAX_SENTENCE}")

    def write(path: str) -> None:
        train_embeddings(read, **options).save(path)

    return Word2VecModel.load(stage_folder(spark, "embeddings", key, write, folder))


def embeddings(model: Word2VecModel) -> DataFrame:
    return model.getVectors().select(
        F.col("word").cast("int").alias("product"), vector_to_array("vector").alias("embedding")
    )


def similar_products(model: Word2VecModel, product: int, n: int = 10) -> DataFrame:
    return model.findSynonyms(str(product), n).select(
        F.col("word").cast("int").alias("product"), F.col("similarity")
    )


def all_similar_products(model: Word2VecModel, n: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(product, rank, similar, similarity): the n nearest products of every product by cosine."""
    return nearest(embeddings(model), n, block_rows)


def projection(model: Word2VecModel) -> DataFrame:
    """(product, x, y): first two principal components of the vectors."""
    vectors = model.getVectors()
    flat = PCA(k=2, inputCol="vector", outputCol="xy").fit(vectors).transform(vectors)
    xy = vector_to_array("xy")
    return flat.select(
        F.col("word").cast("int").alias("product"), xy[0].alias("x"), xy[1].alias("y")
    )
