"""Benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are word windows of the benchmark items, as bytes with a space on either side, so
that an occurrence in a normalised text is a run of whole words. All patterns share a
window of m bytes, the length of the shortest. A table gives for every hashed block how far
the window may move on before a pattern can end there; where that is zero the block is the
suffix of some pattern's window, its bucket names the patterns to test, of which those that also
begin like the window are confirmed by comparing bytes. Tables grow with the patterns, so shifts stay
long whatever the number of items. The tables are probed for thousands of places of a text at once, each place
jumping by its own shift.

Contract of `occurrences`: null and empty texts have no words and no hits; null and empty
items have no windows; equal items, also under several ids, are all reported; an item id
that is null is reported as the empty string. A row may repeat: each is judged alone. No
documents or no items give no hits. Texts of any length are searched whole. Rows keep all their columns in the struct `row`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from couponloom.llm.text import appended, ragged

#: Bytes outside words become spaces, capital letters small ones.
_OUTSIDE = [b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)]
FOLD = bytes.maketrans(
    bytes(_OUTSIDE) + bytes(range(0x41, 0x5B)), b" " * len(_OUTSIDE) + bytes(range(0x61, 0x7B))
)
#: Benchmark texts of one pattern table, in bytes; more items are searched in further blocks.
ITEM_BYTES = 4 << 20
_BLOCK = 8
#: Slots of the shift table: four for each block of a pattern, between these powers of two, a byte each.
_TABLE_BITS = 18, 25
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fold_words(text: bytes) -> list[bytes]:
    """Lower-case words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+."""
    return text.translate(FOLD).split()


def windows(words: list[bytes], size: int) -> set[bytes]:
    """Distinct windows of consecutive words; a shorter text is one window."""
    if not words:
        return set()
    last = max(0, len(words) - size)
    return {b" %b " % b" ".join(words[i : i + size]) for i in range(last + 1)}


class WuManber:
    """Finds all occurrences of any pattern in a byte buffer."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.window = min(map(len, patterns))
        self.block = min(_BLOCK, self.window)
        self._mask = np.uint64((1 << 8 * self.block) - 1)
        places = self.window - self.block + 1
        least, most = _TABLE_BITS
        self._down = np.uint64(64 - min(most, max(least, (4 * places * len(patterns)).bit_length())))
        self._shift = np.full(1 << 64 - int(self._down), min(places, 255), dtype=np.uint8)
        joined = np.frombuffer(b"".join(p[: self.window] for p in patterns) + bytes(8), np.uint8)
        starts = np.arange(len(patterns)) * self.window
        for at in range(places):
            hashed = self._hash(joined, starts + at)
            np.minimum.at(self._shift, hashed, min(places - 1 - at, 255))
        # Suffix buckets: patterns in order of their slot, with the first bytes of each.
        self._order = np.argsort(hashed, kind="stable")
        self._slots, self._begins = hashed[self._order], self._begin(joined, starts)[self._order]

    def _loads(self, buffer: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.ndarray(len(buffer) - 7, dtype="<u8", buffer=buffer, strides=(1,))[at] & self._mask

    def _hash(self, buffer: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (self._loads(buffer, at) * _MIX >> self._down).astype(np.int64)

    def _begin(self, buffer: np.ndarray, at: np.ndarray) -> np.ndarray:
        """First and last bytes of windows, mixed."""
        return self._loads(buffer, at) * _MIX ^ self._loads(buffer, at + (self.window - self.block))

    def _confirmed(self, content: bytes, buffer: np.ndarray, start: np.ndarray, slot: np.ndarray) -> list[tuple[int, int]]:
        """Places whose bucket has a pattern that stands there."""
        low, high = (np.searchsorted(self._slots, slot, side=s) for s in ("left", "right"))
        count = high - low
        which, place = ragged(low, count), np.repeat(start, count)
        same = self._begins[which] == np.repeat(self._begin(buffer, start), count)
        patterns = self._order[which[same]].tolist()
        return [(a, i) for a, i in zip(place[same].tolist(), patterns, strict=True) if content.startswith(self.patterns[i], a)]

    def search(self, content: bytes) -> list[tuple[int, int]]:
        """(first byte, pattern) of every occurrence, in no particular order."""
        first, last = self.window - self.block, len(content) - self.block + 1
        if last <= first:
            return []
        buffer = np.frombuffer(content + bytes(8), np.uint8)
        lanes = max(1, min(8192, (last - first) // 512))
        edges = np.linspace(first, last, lanes + 1).astype(np.int64)
        at, end = edges[:-1].copy(), edges[1:]
        found: list[tuple[int, int]] = []
        while len(at):
            hashed = self._hash(buffer, at)
            shift = self._shift[hashed].astype(np.int64)
            hit = np.flatnonzero(shift == 0)
            if len(hit):
                found += self._confirmed(content, buffer, at[hit] - first, hashed[hit])
                shift[hit] = 1
            at = at + shift
            live = at < end
            if not live.all():
                at, end = at[live], end[live]
        return found


class Search:
    """Windows of items, tested against texts; short items have tables of their own."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        names: dict[bytes, set[str]] = {}
        lengths: dict[bytes, int] = {}
        for item, text in items:
            words = fold_words((text or "").encode())
            for window in windows(words, size):
                names.setdefault(window, set()).add(item)
                lengths[window] = min(size, len(words))
        full = [p for p, n in lengths.items() if n == size]
        short = [p for p, n in lengths.items() if n < size]
        self._tables = [WuManber(group) for group in (full, short) if group]
        self._names, self._lengths = names, lengths

    def spans(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """Words, (first word, end) of every occurrence and found items of each text."""
        words = [fold_words(t) for t in texts]
        rows = [b" %b " % b" ".join(w) for w in words]
        content = b"\n".join(rows)
        starts = np.cumsum([0, *(len(r) + 1 for r in rows)])
        spans: list[set] = [set() for _ in texts]
        items: list[set] = [set() for _ in texts]
        places: dict[int, np.ndarray] = {}
        for table in self._tables:
            for at, i in table.search(content):
                row = int(np.searchsorted(starts, at, side="right")) - 1
                if row not in places:
                    places[row] = np.flatnonzero(np.frombuffer(rows[row], np.uint8) == 0x20)
                pattern = table.patterns[i]
                word = int(np.searchsorted(places[row], at - starts[row]))
                spans[row].add((word, word + self._lengths[pattern]))
                items[row] |= self._names[pattern]
        return [(len(w), sorted(s), sorted(n)) for w, s, n in zip(words, spans, items, strict=True)]


def _search(block: Broadcast, size: int) -> Search:
    """The tables of a block, built once for each Python worker."""
    value = block.value
    held = _built.get(id(value))
    if held is None or held[0] is not value:
        held = _built[id(value)] = value, Search(value, size)
    return held[1]


_built: dict[int, tuple[list, Search]] = {}


def covered(spans: list[tuple[int, int]]) -> int:
    """Words inside any of the sorted spans."""
    total, reached = 0, 0
    for start, end in spans:
        total += max(0, end - max(start, reached))
        reached = max(reached, end)
    return total


def _item_blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[str, str]]]:
    """Distinct items in blocks of bounded size, one after the other through the driver."""
    rows = items.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("text")
    ).where(F.col("text").isNotNull()).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / ITEM_BYTES))
    for block in range(n):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == block) if n > 1 else rows
        yield sorted((r[0], r[1]) for r in part.collect())


def occurrences(
    docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id",
    item_text: str = "text", size: int = 10,
) -> DataFrame:
    """Each row of docs with n_words, word spans of all occurrences, and the found items.

    A map over the documents: no shuffle. Items beyond one block are searched by further
    maps that add to the spans of the ones before.
    """
    spark, found = docs.sparkSession, None
    schema = "n_words long, spans array<struct<start: long, end: long>>, items array<string>"
    for values in _item_blocks(items, item_key, item_text):
        block = spark.sparkContext.broadcast(values)

        def make(block: Broadcast = block):
            search = _search(block, size)

            def compute(texts: list[bytes]) -> list[pa.Array]:
                rows = search.spans(texts)
                return [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in r[1]] for r in rows],
                             pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([r[2] for r in rows], pa.list_(pa.string())),
                ]

            return compute

        found = appended(docs, text, make, schema) if found is None else _merge(found, text, make, schema)
    return found


def _merge(found: DataFrame, text: str, make, schema: str) -> DataFrame:
    """Spans and items of one more block beside those found so far."""
    packed = found.select(
        F.struct("row", F.col("spans").alias("old_spans"), F.col("items").alias("old_items")).alias("held"),
        F.col("row").getField(text).alias("text"),
    )
    more = appended(packed, "text", make, schema)
    return more.select(
        F.col("row.held.row").alias("row"), "n_words",
        F.array_sort(F.array_union("row.held.old_spans", "spans")).alias("spans"),
        F.array_sort(F.array_union("row.held.old_items", "items")).alias("items"),
    )


def with_counts(found: DataFrame) -> DataFrame:
    """n_hit: words inside any occurrence, from the sorted spans."""
    step = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("reached")),
        lambda a, s: F.struct(
            (a["total"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["reached"]))).alias("total"),
            F.greatest(a["reached"], s["end"]).alias("reached"),
        ),
        lambda a: a["total"],
    )
    return found.withColumn("n_hit", step)


def op8_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of `documents` inside ten-word windows of `benchmark`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return with_counts(occurrences(docs, items)).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
