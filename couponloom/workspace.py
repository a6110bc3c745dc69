"""Shared folder for written stages and checkpoints."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the name that Spark gives to the folder of a null.
NO_WEEK = "__HIVE_DEFAULT_PARTITION__"


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="run-")


def shared_folder(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_folder(spark.sparkContext.applicationId)


def enable_checkpoints(spark: SparkSession) -> None:
    """Let iterative ML jobs cut their lineage in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_folder(spark)}/checkpoints")


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _committed(spark: SparkSession, path: str) -> bool:
    """A written table counts only with the marker that its whole job was committed."""
    files, _ = _hadoop_path(spark, path)
    return files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))


def remove(spark: SparkSession, path: str) -> None:
    files, folder = _hadoop_path(spark, path)
    files.delete(folder, True)


def _publish(spark: SparkSession, built: str, path: str) -> None:
    """Rename a committed folder into place; the first of several builders wins."""
    files, source = _hadoop_path(spark, built)
    _, target = _hadoop_path(spark, path)
    if not _committed(spark, path):
        files.delete(target, True)
        files.mkdirs(target.getParent())
        if files.rename(source, target):
            return
        if not _committed(spark, path):
            raise RuntimeError(f"cannot publish {path}")
    files.delete(source, True)


def _mark(spark: SparkSession, folder: str) -> None:
    """Leave a commit marker in a folder that no Spark job marks."""
    files, path = _hadoop_path(spark, f"{folder}/_SUCCESS")
    files.create(path, True).close()


def _building(root: str, name: str) -> str:
    return f"{root}/building/{name}-{uuid.uuid4().hex}"


def stage(
    spark: SparkSession,
    name: str,
    fingerprint: str,
    build: Callable[[], DataFrame],
    folder: str | None = None,
    partition_by: tuple[str, ...] = (),
    check: Callable[[], None] | None = None,
) -> DataFrame:
    """Read-through stage: read the written table, or build it, write it and read it.

    The fingerprint of parameters and inputs is part of the path, so a change of
    either never meets a stale table. The table is written into a folder of its own
    and renamed into place after its commit, so no reader meets half of it; what a
    lost job left behind has no commit marker and is built again. A `check` that raises
    after the table is written keeps it from being published.
    """
    root = f"{folder or shared_folder(spark)}/stages"
    path = f"{root}/{name}-{fingerprint}"
    if not _committed(spark, path):
        built = _building(root, f"{name}-{fingerprint}")
        writer = build().write.option("compression", "gzip")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(built)
        if check:
            check()
        _publish(spark, built, path)
    return spark.read.parquet(path)


def weekly_stage(
    spark: SparkSession,
    name: str,
    fingerprint: str,
    weeks: list[int | None],
    build: Callable[[list[int | None]], DataFrame],
    folder: str | None = None,
) -> DataFrame:
    """Stage with a folder for each week, of which only the missing ones are built.

    `build` gives the rows of the weeks it is asked for, None for rows without a week; all missing
    weeks are built by one job. The committed folders are the manifest: each is renamed
    into place on its own, so a lost job is taken up where it stopped. What a committed
    week holds is final, another version of the inputs needs another fingerprint.
    """
    root = f"{folder or shared_folder(spark)}/stages"
    path = f"{root}/{name}-{fingerprint}"
    at = {week: f"{path}/week={NO_WEEK if week is None else week}" for week in dict.fromkeys(weeks)}
    missing = [week for week, place in at.items() if not _committed(spark, place)]
    frame = build(missing or weeks)
    if missing:
        built = _building(root, f"{name}-{fingerprint}")
        frame.write.option("compression", "gzip").partitionBy("week").parquet(built)
        for week in missing:
            made = f"{built}/{at[week].rsplit('/', 1)[1]}"
            _mark(spark, made)  # makes the folder of a week without rows
            _publish(spark, made, at[week])
        remove(spark, built)
    if not at:
        return frame.limit(0)
    read = spark.read.schema(frame.schema).option("basePath", path).parquet(*at.values())
    return read.select(frame.columns)


def stage_folder(
    spark: SparkSession, name: str, fingerprint: str, write: Callable[[str], None], folder: str | None = None
) -> str:
    """Path of a stage that is no table, such as a model: written to a folder of its own, marked and renamed."""
    root = f"{folder or shared_folder(spark)}/stages"
    path = f"{root}/{name}-{fingerprint}"
    if not _committed(spark, path):
        built = _building(root, f"{name}-{fingerprint}")
        write(built)
        _mark(spark, built)
        _publish(spark, built, path)
    return path


def content_fingerprint(df: DataFrame, *more: str) -> str:
    """Of all rows in any order, repeats included, and of further texts; one pass over the rows."""
    whole = F.xxhash64(*[F.col(c) for c in sorted(df.columns)], F.lit(0)).cast("decimal(38,0)")
    found = df.agg(F.count("*"), F.sum(whole), F.bit_xor(F.xxhash64(*[F.col(c) for c in sorted(df.columns)], F.lit(1)))).first()
    types = sorted(df.dtypes)
    return hashlib.sha256(json.dumps([str(x) for x in [*found, types, *more]]).encode()).hexdigest()[:16]


_private: dict[str, list[str]] = {}


def private_folder(spark: SparkSession, name: str) -> str:
    """A new shared folder for this session's own files; release() removes it."""
    path = f"{shared_folder(spark)}/private/{name}-{uuid.uuid4().hex}"
    _private.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def private_stage(
    spark: SparkSession, name: str, build: Callable[[], DataFrame], partition_by: tuple[str, ...] = ()
) -> DataFrame:
    """Stage no other run reads: plans that use a frame many times compute it once."""
    path = private_folder(spark, name)
    frame = build()
    (frame.write.partitionBy(*partition_by) if partition_by else frame.write).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def private_folders(spark: SparkSession) -> int:
    """Number of the session's private folders, for release()."""
    return len(_private.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Remove the session's private folders; frames that read them are then spent.

    The first `since` folders and the one to `keep` stay.
    """
    held = _private.get(spark.sparkContext.applicationId, [])
    gone = [path for path in held[since:] if path != keep]
    held[since:] = [path for path in held[since:] if path == keep]
    for path in gone:
        remove(spark, path)
