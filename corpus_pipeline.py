"""From raw documents to subword ids, in five stages over whole tables.

Each stage is written as Parquet and read again before the next, so a lost executor costs one
stage at most and no plan spans the run. A stage works on all rows that its predecessor
kept and returns the columns of documents; the last returns the encoded documents.

Null and empty texts pass every stage but near-dedup, where they are duplicates of each
other as any equal texts. Null doc_ids are told apart by their texts, and so are different texts
under one doc_id. Extra columns travel along up to the last stage, which returns the ids of each document,
their number and whether they decode to its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from couponloom.llm.merge_dropout import encode, piece_model
from couponloom.llm.simhash import near_duplicates
from couponloom.llm.super_kmers import repeated_windows
from couponloom.llm.toxicity import THRESHOLD, score, train, usable_label
from couponloom.llm.wu_manber import occurrences
from couponloom.workspace import private_folder, private_folders, private_stage, release


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, usable_label())
    return score(docs, model).where(F.col("score") < THRESHOLD).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest doc_id.

    Which ids are on several rows is decided on ids and hashes alone; whole rows are shuffled once, to
    meet the keys that stay.
    """
    # Equal texts of an id have one key. Documents without an id, and all texts of an id but the
    # one of smallest hash, come after all others.
    text = F.xxhash64(F.coalesce(F.col("row.text"), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = rows.select(F.col("row.doc_id").alias("shared"), text.alias("hash")).where("shared is not null")
    shared = private_stage(
        spark, "shared-ids",
        lambda: own.groupBy("shared").agg(F.min("hash").alias("first"), F.count("*").alias("n")).where("n > 1"),
    )
    unnamed = F.col("row.doc_id").isNull()
    later = F.lit(1 << 62) + F.pmod(F.xxhash64("row.doc_id", F.coalesce(F.col("row.text"), F.lit(""))), F.lit(1 << 61))
    key = F.when(unnamed | (F.col("first") != text), later).otherwise(F.col("row.doc_id"))
    keyed = rows.join(shared, F.col("row.doc_id") == F.col("shared"), "left").select(
        key.alias("key"), "row", (unnamed | F.col("shared").isNotNull()).alias("several")
    )
    found = near_duplicates(keyed.select("key", F.col("row.text").alias("text")), key="key")
    kept = found.where(F.col("key") == F.col("component_id")).select("key").distinct()
    held = keyed.join(kept, "key", "left_semi")
    single, several = held.where(~F.col("several")), held.where("several").dropDuplicates(["key"])
    return single.select("row.*").union(several.select("row.*"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated windows; untouched texts stay as they are."""
    found = repeated_windows(docs)
    changed = F.size("spans") > 0

    def column(name: str):
        if name == "text":
            return F.col("cleaned").alias(name)
        own = F.col(f"row.`{name}`")
        if name == "n_chars":
            own = F.when(changed, F.length("cleaned").cast(docs.schema[name].dataType)).otherwise(own)
        return own.alias(name)

    return found.select(*[column(name) for name in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return occurrences(docs, items).where(F.size("spans") == 0).select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document under merge-dropout, and whether they decode to its text."""
    coded = encode(docs.select("doc_id", "text"), piece_model(), with_text=True)
    return coded.select(
        F.col("row.doc_id").alias("doc_id"), "ids", (F.octet_length("ids") / 2).cast("long").alias("n_ids"),
        (F.col("decoded") == F.coalesce(F.col("row.text"), F.lit(""))).alias("lossless"),
    )


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL cannot express the trained stages; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to all documents; what a stage leaves in the shared folder goes with the next commit."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = private_folders(spark)
    for name, stage in STAGES:
        path = private_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark, since, path)
    return docs
