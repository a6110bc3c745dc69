"""Texts as bytes: words, Arrow columns and files shared by the operators of this package."""

from __future__ import annotations

import ctypes
import math
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text a block of documents or a file should hold; a single longer text is a block of its own.
BLOCK_BYTES = 16 << 20


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text, empty for null. Words are `bytes.split()`: [^\\x20\\x09-\\x0D]+."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(sizes: list[int], limit: int) -> Iterator[slice]:
    """Slices of consecutive rows with at most `limit` bytes, or one row."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def block_count(docs: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks needed for all texts: grows with the input, from one sum."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, math.ceil(total / block_bytes))


def id_text(key: str) -> Column:
    """The key as text; empty for a null key."""
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def id_remainder(key: str, divisor: int) -> Column:
    """crc32 of the key as text, modulo divisor."""
    return F.crc32(id_text(key).cast("binary")) % divisor


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all ranges [start, start + length) one after the other."""
    total = int(lengths.sum())
    out = np.ones(total, dtype=np.int64)
    if not total:
        return out
    keep = lengths > 0
    starts, lengths = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    firsts = np.zeros(len(lengths), dtype=np.int64)
    np.cumsum(lengths[:-1], out=firsts[1:])
    out[0] = starts[0]
    out[firsts[1:]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out, out=out)


def write_file(folder: str, name: str, content: bytes) -> str:
    """Write a file of the shared folder under a name of its own and rename it into place.

    A task that runs again writes the same content under the same name.
    """
    files, root = pa.fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    part = f"{root}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(part, compression=None) as out:
        out.write(content)
    files.move(part, f"{root}/{name}")
    return f"{folder}/{name}"


def open_file(uri: str) -> pa.NativeFile:
    files, path = pa.fs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


def folder_uri(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme of the file system that Spark takes it from, as Arrow reads it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = files.makeQualified(path).toString()
    return f"file://{whole.removeprefix('file:')}" if whole.startswith("file:/") and not whole.startswith("file://") else whole


@cache
def _trim() -> Callable[[int], int]:
    """glibc's malloc_trim, or nothing where the C library has none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def give_back() -> None:
    """Freed memory goes back to the system; a reused worker else keeps the most that a task ever held."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


@cache
def keep_freed() -> None:
    """Up to 16 MB of freed memory stays with this worker until `give_back`.

    Else the C library returns the arrays of a numpy loop to the system and gets them anew, page by page, in every step.
    """
    option = getattr(ctypes.CDLL(None), "mallopt", lambda name, value: 0)
    trim, mapped = -1, -3  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD
    option(trim, 16 << 20)
    option(mapped, 4 << 20)


def appended(
    docs: DataFrame, text: str, make: Callable[[], Callable[[list[bytes]], list[pa.Array]]],
    schema: str, part_bytes: int = BLOCK_BYTES // 4,
) -> DataFrame:
    """Columns computed from the texts beside each row, which travels whole in the struct `row`.

    `make` runs in the Python worker and gives the function from texts to new columns; it
    gets at most `part_bytes` of text at a time, or one text. Names of the rows' own
    columns cannot clash with the new ones.
    """
    added = T.StructType.fromDDL(schema)
    names = ["row", *added.fieldNames()]
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            rows = batch.column(0)
            texts = text_bytes(rows.field(place))
            for part in chunks([len(t) for t in texts], part_bytes):
                columns = compute(texts[part])
                yield pa.RecordBatch.from_arrays(
                    [rows.slice(part.start, part.stop - part.start), *columns], names=names
                )
        del compute
        give_back()

    out = T.StructType([T.StructField("row", docs.schema, False), *added.fields])
    whole = docs.withColumn(text, F.col(text).cast("string")) if dict(docs.dtypes)[text] != "string" else docs
    return whole.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).mapInArrow(run, out)
