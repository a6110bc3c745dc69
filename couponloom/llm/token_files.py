"""Token ids in directly addressable code files.

Every id is split into chunks of eight bits. Level k holds the k-th chunk of the ids that
reach it, a bitmap that says which of them go on, and a rank directory with the number of
ones before each superblock of the bitmap. Token i is found by following at most four
levels: its place in the next level is the rank of its bit. No block is decoded.

File: header, documents (ids and first tokens), levels, all little-endian:
    magic "DAC1", levels u32, documents u64, tokens u64
    documents x i64 keys, documents x u8 null flags, (documents + 1) x u64 first token
    per level: entries u64, chunks u8[], bitmap u8[], rank directory u32[]

Contract of `write_tokens` / `read_tokens`: null texts are empty; an empty text has the end
id alone. Documents are in ascending key order, null keys first; rows with one key are
ordered by text and each keeps its own place. An empty table gives one file without
documents. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from couponloom.llm.text import (
    block_count,
    chunks,
    folder_uri,
    give_back,
    open_file,
    text_bytes,
    write_file,
)
from couponloom.llm.word_ids import word_encoder
from couponloom.workspace import private_folder

MAGIC = b"DAC1"
#: Text of one file: its ids and levels are held by one task.
FILE_BYTES = 8 << 20
_HEAD = struct.Struct("<4sIQQ")
#: Bits of a bitmap that share one entry of the rank directory.
SUPERBLOCK = 512
_ONES = np.array([bin(x).count("1") for x in range(256)], dtype=np.uint8)


def _level(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bytes of one level, and what its ids still hold."""
    rest = values >> 8
    more = rest > 0
    bitmap = np.packbits(more, bitorder="little")
    pad = -len(bitmap) % (SUPERBLOCK // 8)
    ones = _ONES[np.concatenate([bitmap, np.zeros(pad, np.uint8)])].reshape(-1, SUPERBLOCK // 8)
    ranks = np.concatenate([[0], np.cumsum(ones.sum(axis=1, dtype=np.int64))]).astype("<u4")
    parts = [struct.pack("<Q", len(values)), (values & 255).astype(np.uint8).tobytes(),
             bitmap.tobytes(), ranks.tobytes()]
    return b"".join(parts), rest[more]


def pack(keys: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A file of documents with `lengths` ids each."""
    levels, values = [], ids.astype(np.uint32)
    while len(values) or not levels:
        level, values = _level(values)
        levels.append(level)
    firsts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    return b"".join([
        _HEAD.pack(MAGIC, len(levels), len(keys), len(ids)),
        np.array([k or 0 for k in keys], dtype="<i8").tobytes(),
        np.array([k is None for k in keys], dtype=np.uint8).tobytes(),
        firsts.tobytes(), *levels,
    ])


class TokenFile:
    """Random access to the tokens and documents of a file's bytes."""

    def __init__(self, content: bytes):
        magic, levels, documents, self.n_tokens = _HEAD.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self._content, at = content, _HEAD.size
        keys, at = self._array("<i8", documents, at)
        nulls, at = self._array("u1", documents, at)
        self.keys = [None if n else int(k) for k, n in zip(keys, nulls, strict=True)]
        self.firsts, at = self._array("<u8", documents + 1, at)
        self._levels = []
        for _ in range(levels):
            (entries,) = struct.unpack_from("<Q", content, at)
            chunk, at = self._array("u1", entries, at + 8)
            bitmap, at = self._array("u1", -(-entries // 8), at)
            ranks, at = self._array("<u4", -(-entries // SUPERBLOCK) + 1, at)
            self._levels.append((chunk, bitmap, ranks))

    def _array(self, kind: str, count: int, at: int) -> tuple[np.ndarray, int]:
        found = np.frombuffer(self._content, dtype=kind, count=count, offset=at)
        return found, at + found.nbytes

    def __getitem__(self, i: int) -> int:
        """Token i, from its own chunks alone."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for k, (chunk, bitmap, ranks) in enumerate(self._levels):
            value |= int(chunk[i]) << (8 * k)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            whole = i // SUPERBLOCK * SUPERBLOCK // 8
            before = int(_ONES[bitmap[whole : i >> 3]].sum())
            i = int(ranks[i // SUPERBLOCK]) + before + bin(int(bitmap[i >> 3]) & (1 << (i & 7)) - 1).count("1")
        return value

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Tokens [start, stop): the same walk for a range, which stays a range in every level."""
        out, places = np.zeros(stop - start, dtype=np.uint32), np.arange(stop - start)
        for k, (chunk, bitmap, ranks) in enumerate(self._levels):
            if start >= stop:
                break
            out[places] |= chunk[start:stop].astype(np.uint32) << np.uint32(8 * k)
            more = np.unpackbits(bitmap[start >> 3 : (stop + 7) >> 3], bitorder="little")
            more = more[start & 7 : (start & 7) + stop - start].astype(bool)
            whole = start // SUPERBLOCK * SUPERBLOCK
            before = np.unpackbits(bitmap[whole >> 3 : (start + 7) >> 3], bitorder="little")[: start - whole]
            start = int(ranks[whole // SUPERBLOCK]) + int(before.sum())
            places = places[more]
            stop = start + len(places)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.firsts[k]), int(self.firsts[k + 1]))


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder, keys, lengths, ids = word_encoder(path), [], [], []
    for batch in batches:
        texts = text_bytes(batch.column("text"))
        for part in chunks([len(t) for t in texts], FILE_BYTES):
            found, counts = encoder.encode(texts[part])
            ends = np.cumsum(counts)
            lengths.append(counts + 1)
            ids.append(np.insert(found, ends, end_id).astype(np.uint32))
            del found, counts
        keys += batch.column("key").to_pylist()
        del texts
        give_back()
    shard = TaskContext.get().partitionId()
    counts = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    content = pack(keys, counts, np.concatenate(ids) if ids else np.zeros(0, np.uint32))
    file = write_file(folder, f"tokens-{shard:06d}.dac", content)
    yield pa.RecordBatch.from_pylist([{
        "shard": shard, "file": file, "n_docs": len(keys), "n_tokens": int(counts.sum()),
        "file_bytes": len(content),
    }])


def write_tokens(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2,
    folder: str | None = None, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Encode all texts, write them in key order, return the written index of the files.

    One range shuffle of the texts; each file holds about `file_bytes` of text. Ties of a
    key are dealt by text, so a repeated key does not make one long file.
    """
    spark = docs.sparkSession
    folder = folder_uri(spark, folder or private_folder(spark, "tokens"))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    files = (
        rows.repartitionByRange(block_count(rows, "text", file_bytes), *order)
        .sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
        .mapInArrow(
            partial(_write, folder=folder, path=tokenizer, end_id=end_id),
            "shard long, file string, n_docs long, n_tokens long, file_bytes long",
        )
    )
    files.write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def _read(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            with open_file(row["file"]) as source:
                file = TokenFile(source.read())
            for first in range(0, len(file.keys), 2000):
                documents = range(first, min(first + 2000, len(file.keys)))
                yield pa.RecordBatch.from_arrays([
                    pa.array([file.keys[k] for k in documents], pa.int64()),
                    pa.array([row["start"] + int(file.firsts[k]) for k in documents], pa.int64()),
                    pa.array([file.document(k).astype("<u4").tobytes() for k in documents], pa.binary()),
                ], names=[key, "start", "ids"])


def read_tokens(index: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of the files: key, ids of all documents before it, its ids as u32 bytes.

    The running total is over one row for each file.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = index.select(
        "shard", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start")
    )
    parts = max(1, index.count())
    return files.repartition(parts, "shard").mapInArrow(
        partial(_read, key=key), f"`{key}` long, start long, ids binary"
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids").to_pylist()
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("start"),
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([zlib.crc32(x) for x in ids], pa.int64()),
        ], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op9_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Write the ids of `documents` and digest what the files give back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(write_tokens(docs, tokenizer)).mapInArrow(
        _digest, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
