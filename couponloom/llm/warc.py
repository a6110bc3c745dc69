"""Web pages as WARC records in seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames of whole records, then a skippable frame
with the seek table (compressed and plain size of every frame). The index maps a record's
identifier to bundle, frame, offset within the plain frame and length, so one record is read
by decoding one frame. Any Zstandard tool decodes a whole bundle to a plain WARC file.

Contract of `write_bundles` / `read_records`: a null html is an empty payload, a null url has
no target header. Records with equal payloads of at least `least` bytes refer to the one
with the smallest page id; rows that repeat that page id are responses too. Null page ids
never are the smallest and never revisit. An empty table gives no bundles.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from contextlib import ExitStack
from functools import partial

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from couponloom.llm.text import folder_uri, open_file, write_file
from couponloom.workspace import private_folder

#: Formats fixed by WARC 1.1 and the seekable Zstandard format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
#: Parts of a payload that many pages share, in the search for its first page.
SALTS = 32
_DATE = "1970-01-01T00:00:00Z"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", None if url is None else " ".join(url.split())),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("WARC-Refers-To", f"<urn:page:{refers_to}>" if revisit else None),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


class Bundle:
    """A bundle in the making: records are gathered to frames, frames to a file."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self._limit, self._compress = frame_bytes, zstandard.ZstdCompressor(level=3).compress
        self._frames: list[bytes] = []
        self._table: list[tuple[int, int]] = []
        self._open, self._held = [], 0
        self.plain_bytes = 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Frame, offset and length of the record."""
        if self._held and self._held + len(record) > self._limit:
            self._close_frame()
        place = len(self._frames), self._held, len(record)
        self._open.append(record)
        self._held += len(record)
        self.plain_bytes += len(record)
        return place

    def _close_frame(self) -> None:
        packed = self._compress(b"".join(self._open))
        self._frames.append(packed)
        self._table.append((len(packed), self._held))
        self._open, self._held = [], 0

    def content(self) -> bytes:
        if self._held:
            self._close_frame()
        entries = b"".join(struct.pack("<II", *sizes) for sizes in self._table)
        footer = struct.pack("<IBI", len(self._table), 0, SEEKABLE_MAGIC)
        head = struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer))
        return b"".join([*self._frames, head, entries, footer])


class BundleReader:
    """Reads single frames by the footer's seek table; keeps the last frame."""

    def __init__(self, source: pa.NativeFile):
        self._source, size = source, source.size()
        source.seek(size - 9)
        frames, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        source.seek(size - 9 - 8 * frames)
        table = struct.iter_unpack("<II", source.read(8 * frames))
        self._places, at = [], 0
        for packed, plain in table:
            self._places.append((at, packed, plain))
            at += packed
        self._last: tuple[int, bytes] = (-1, b"")

    def record(self, frame: int, offset: int, length: int) -> bytes:
        if self._last[0] != frame:
            at, packed, plain = self._places[frame]
            self._source.seek(at)
            decoded = zstandard.ZstdDecompressor().decompress(self._source.read(packed), max_output_size=plain)
            self._last = frame, decoded
        return self._last[1][offset : offset + length]


def parse(record: bytes) -> dict:
    """Type, page, reference, payload (None for a revisit), its size and digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    page = fields["WARC-Record-ID"][10:-1]
    size = int(http.rsplit(b": ", 1)[1])
    digest = fields["WARC-Payload-Digest"][7:]
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record of page {page}")
    return {
        "page_id": int(page) if page else None,
        "url": fields.get("WARC-Target-URI"),
        "payload": None if revisit else payload,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": int(fields["WARC-Refers-To"][10:-1]) if revisit else None,
    }


_INDEX = "page_id long, bundle string, frame long, offset long, length long"


def _write(batches: Iterator[pa.RecordBatch], folder: str, frame_bytes: int, bundle_bytes: int) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId(), 0
    bundle, places = Bundle(frame_bytes), []

    def close() -> pa.RecordBatch:
        name = f"pages-{task:06d}-{number:05d}.warc.zst"
        uri = write_file(folder, name, bundle.content())
        return pa.RecordBatch.from_pylist([
            {"page_id": p, "bundle": uri, "frame": f, "offset": o, "length": n} for p, (f, o, n) in places
        ], schema=pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int64()),
                             ("offset", pa.int64()), ("length", pa.int64())]))

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(5)]
        for page_id, url, payload, digest, refers_to in zip(*columns, strict=True):
            record = _record(page_id, url, payload, digest, refers_to)
            if places and bundle.plain_bytes + len(record) > bundle_bytes:
                yield close()
                number += 1
                bundle, places = Bundle(frame_bytes), []
            places.append((page_id, bundle.add(record)))
    if places:
        yield close()


def revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload an earlier page has.

    Sizes and digests alone are grouped; a payload that a third of the pages share is
    counted in every task first and looked up in `SALTS` parts.
    """
    large = pages.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    firsts = (
        large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("other"))
        .where(F.col("refers_to") < F.col("other"))
        .select("digest", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = large.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return (
        salted.join(firsts, ["digest", "salt"]).where(F.col("page_id") > F.col("refers_to"))
        .groupBy("page_id", "digest").agg(F.first("refers_to").alias("refers_to"))
    )


def write_bundles(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 100,
    folder: str | None = None, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
) -> DataFrame:
    """Write all pages, return the written index of the records."""
    spark = pages.sparkSession
    folder = folder_uri(spark, folder or private_folder(spark, "warc"))
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    records = (
        rows.join(revisits(rows, least), ["page_id", "digest"], "left")
        .select("page_id", "url", "payload", "digest", "refers_to")
        .sortWithinPartitions("page_id", "digest", "url")
    )
    index = records.mapInArrow(
        partial(_write, folder=folder, frame_bytes=frame_bytes, bundle_bytes=bundle_bytes), _INDEX
    )
    index.write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.schema(_INDEX).parquet(f"{folder}/index")


_FIELDS = [
    ("page_id", "long", pa.int64()), ("url", "string", pa.string()), ("payload", "binary", pa.binary()),
    ("payload_bytes", "long", pa.int64()), ("payload_digest", "string", pa.string()),
    ("record_type", "string", pa.string()), ("refers_to", "long", pa.int64()),
]


def _read(batches: Iterator[pa.RecordBatch], wanted: list[str]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(name, kind) for name, _, kind in _FIELDS if name in wanted])
    uri, reader, held = None, None, []
    with ExitStack() as opened:
        for batch in batches:
            for row in batch.to_pylist():
                if row["bundle"] != uri:
                    opened.close()
                    uri = row["bundle"]
                    reader = BundleReader(opened.enter_context(open_file(uri)))
                found = parse(reader.record(row["frame"], row["offset"], row["length"]))
                held.append({name: found[name] for name in wanted})
                if len(held) == 500:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held = []
    yield pa.RecordBatch.from_pylist(held, schema=schema)


def read_records(index: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Records of the index, each through its bundle's seek table; a checked digest for each payload."""
    wanted = [name for name, _, _ in _FIELDS if columns is None or name in columns]
    ddl = ", ".join(f"{name} {kind}" for name, kind, _ in _FIELDS if name in wanted)
    return (
        index.repartition("bundle").sortWithinPartitions("bundle", "frame", "offset")
        .mapInArrow(partial(_read, wanted=wanted), ddl)
    )


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write `pages` as bundles and digest what they give back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return read_records(write_bundles(pages), columns)
