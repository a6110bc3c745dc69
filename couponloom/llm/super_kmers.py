"""Substring dedup: word windows that start more than once, by super-k-mer partitioning.

A window is `size` consecutive words of one text. Its minimiser is the smallest hash of the
`MER`-word runs inside it. Consecutive windows with one minimiser form a super-k-mer: one
packed string of words that goes to the bucket of its minimiser, so equal windows always
meet. There the strings of a minimiser are cut into windows, the windows sorted, and equal
neighbours counted, comparing the words themselves.

Texts are dealt into blocks by a hash of key and text. A block sends each distinct string
once, with a mark when it holds it several times; a bucket answers the block with a bit per
window of the string; the block then marks the words of its texts. What travels from a
passage that many texts share is thus one string a block, never one a text. A minimiser
of more than `HOT_STRINGS` strings (near copies differ, so their strings do not fall together) is
dealt out further, each window by its own hash, so no minimiser's windows fill a task. The strings
of every minimiser are counted over all texts first, each task's distinct ones once. The list is
sent to all tasks and holds `HOT_LIST` minimisers, the largest ones, at most; it decides only where
windows meet, not which are found.

Contract of `repeated_windows`: words are [^\\x20\\x09-\\x0D]+, unchanged; null and empty
texts have none; texts of fewer than `size` words have no window and lose nothing. Windows
are judged on the input. A row that is repeated whole has all its windows repeated. Texts of any
length are read whole, one that passes a block is a block of its own. An empty table gives no rows. Rows keep
all their columns in the struct `row`.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from couponloom.llm.text import block_count, chunks, give_back, ragged, text_bytes

#: Words of the runs that minimisers are taken from.
MER = 4
#: Windows of one string at most: their answers are the bits of one word.
RUN = 64
#: Bytes of text of a block; what its task holds is some ten times that.
BLOCK_BYTES = 6 << 20
#: Packed bytes are about three times the text.
BUCKETS_PER_BLOCK = 3
#: Strings of one minimiser that are sorted together, and minimisers sent to all tasks: 2 MB.
HOT_STRINGS = 2048
HOT_LIST = 1 << 18
_COUNTED_AT_ONCE = 1 << 20

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
#: Times _A this is one.
_A_BACK = np.uint64(pow(int(_A), -1, 1 << 64))
_PART_BYTES = 4 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


class Words:
    """Words of several texts in one buffer, with a hash for each word."""

    def __init__(self, texts: list[bytes]):
        self.rows = [t.split() for t in texts]
        self.counts = np.array([len(r) for r in self.rows], dtype=np.int64)
        self.content = b" ".join([b" ".join(r) for r in self.rows if r] + [b""])
        buffer = np.frombuffer(self.content + bytes(8), np.uint8)
        self.ends = np.flatnonzero(buffer[: len(self.content)] == 0x20)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if len(self.ends) else self.ends
        self.firsts = np.concatenate([[0], np.cumsum(self.counts)])
        self.hashes = self._hash(buffer)

    def _hash(self, buffer: np.ndarray) -> np.ndarray:
        loads = np.ndarray(len(buffer) - 7, dtype="<u8", buffer=buffer, strides=(1,))
        lengths = self.ends - self.starts
        drop = (np.maximum(8 - lengths, 0) * 8).astype(np.uint64)
        head = loads[self.starts] << drop
        tail = loads[self.starts + np.maximum(lengths - 8, 0)] << drop
        return _mix(_mix(head * _A + lengths.astype(np.uint64)) + tail * _A)

    def super_kmers(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word, windows, minimiser of each run, and whether its minimiser comes again in it."""
        none = np.zeros(0, np.int64)
        usable = np.maximum(self.counts - size + 1, 0)
        if not usable.sum():
            return none, none, none.astype(np.uint64), none.astype(bool)
        n, mer = len(self.hashes), min(MER, size)
        mers = np.zeros(n - mer + 1, dtype=np.uint64)
        for k in range(mer):
            mers = mers * _A + self.hashes[k : n - mer + 1 + k]
        mers = _mix(mers)
        least, width, reach = mers, 1, size - mer + 1
        while width < reach:
            step = min(width, reach - width)
            least = np.minimum(least[: len(least) - step], least[step:])
            width += step
        at = ragged(self.firsts[:-1], usable)
        value = least[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)
        run = np.flatnonzero(new)
        place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        run = np.flatnonzero(new | (place % RUN == 0))
        first, length, value = at[run], np.diff(np.append(run, len(at))), value[run]
        span = length + reach - 1
        same = mers[ragged(first, span)] == np.repeat(value, span)
        again = np.add.reduceat(same, np.concatenate([[0], np.cumsum(span)[:-1]]).astype(np.int64)) > 1
        return first, length, value, again

    def run_hashes(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """A hash of the words [first, first + count): a polynomial, moved to the run's start."""
        n = len(self.hashes)
        forth, back = (np.cumprod(np.full(n + 1, base, dtype=np.uint64)) for base in (_A, _A_BACK))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * forth[:n], dtype=np.uint64)])
        return _mix((sums[first + count] - sums[first]) * back[first])

    def strings(self, first: np.ndarray, count: np.ndarray) -> list[bytes]:
        """The words [first, first + count) as they stand in the buffer."""
        a, b, content = self.starts[first], self.ends[first + count - 1], self.content
        return [content[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def _items(texts: list[bytes], size: int, hot: np.ndarray) -> tuple[Words, tuple]:
    """Words, and (first word, windows, string, routing value, again) of what is sent."""
    words = Words(texts)
    first, length, value, again = words.super_kmers(size)
    if len(hot):
        apart = np.isin(value, hot)
        if apart.any():
            single = ragged(first[apart], length[apart])
            keep = ~apart
            strings = words.strings(first[keep], length[keep] + size - 1)
            own = words.strings(single, np.full(len(single), size))
            routes = np.fromiter((xxhash.xxh3_64_intdigest(s) for s in own), np.uint64, len(own))
            return words, (
                np.concatenate([first[keep], single]),
                np.concatenate([length[keep], np.ones(len(single), np.int64)]),
                strings + own, np.concatenate([value[keep], routes]),
                np.concatenate([again[keep], np.zeros(len(single), bool)]),
            )
    return words, (first, length, words.strings(first, length + size - 1), value, again)


_NONE = np.zeros(0, np.uint64)
_SENT = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("packed", pa.binary())])


def _send(key: tuple, table: pa.Table, size: int, buckets: int, hot: Broadcast) -> pa.Table:
    """The distinct strings of a block, packed by bucket."""
    texts = text_bytes(table.column("text"))
    marks: dict[bytes, int] = {}
    routes: list[int] = []
    for part in chunks([len(t) for t in texts], _PART_BYTES):
        _, (_, _, strings, value, again) = _items(texts[part], size, hot.value)
        for string, route, repeats in zip(strings, value.tolist(), again.tolist(), strict=True):
            if string in marks:
                marks[string] |= 1
            else:
                marks[string] = 2 if repeats else 0
                routes.append(route)
    route = np.array(routes, dtype=np.uint64)
    bucket = (_mix(route * _B) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    strings, flags = list(marks), np.fromiter(marks.values(), np.uint8, len(marks))
    compress = zstandard.ZstdCompressor(level=3).compress
    out = []
    for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
        held = [strings[i] for i in own.tolist()]
        lengths = np.fromiter(map(len, held), np.uint32, len(held))
        packed = b"".join([struct.pack("<I", len(held)), lengths.tobytes(), flags[own].tobytes(),
                           (route[own] >> np.uint64(32)).astype("<u4").tobytes(), *held])
        out.append({"bucket": int(bucket[own[0]]), "block": key[0].as_py(), "packed": compress(packed)})
    return pa.Table.from_pylist(out, schema=_SENT)


def _unpack(packed: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Strings, marks, and the upper half of the routing values, enough to tell groups apart."""
    plain = zstandard.ZstdDecompressor().decompress(packed)
    (n,) = struct.unpack_from("<I", plain)
    lengths = np.frombuffer(plain, "<u4", n, 4)
    flags = np.frombuffer(plain, "u1", n, 4 + 4 * n)
    routes = np.frombuffer(plain, "<u4", n, 4 + 5 * n)
    ends = (4 + 9 * n + np.cumsum(lengths, dtype=np.int64)).tolist()
    starts = [4 + 9 * n, *ends[:-1]]
    return [plain[a:b] for a, b in zip(starts, ends, strict=True)], flags, routes


def _cut(string: bytes, size: int) -> list[bytes]:
    """The windows of a string."""
    spaces = [-1]
    at = string.find(b" ")
    while at >= 0:
        spaces.append(at)
        at = string.find(b" ", at + 1)
    spaces.append(len(string))
    return [string[spaces[i] + 1 : spaces[i + size]] for i in range(len(spaces) - size)]


def _repeated(held: dict[bytes, int], size: int) -> dict[bytes, int]:
    """A bit for each window of each string that starts twice or more in all of them.

    held: how often each string came, counting to two is enough.
    """
    if len(held) == 1:
        ((string, times),) = held.items()
        if times > 1:
            return {string: (1 << len(_cut(string, size))) - 1}
    found = sorted(
        (window, string, place, times)
        for string, times in held.items()
        for place, window in enumerate(_cut(string, size))
    )
    masks: dict[bytes, int] = {}
    start = 0
    for i in range(1, len(found) + 1):
        if i == len(found) or found[i][0] != found[start][0]:
            if i - start > 1 or found[start][3] > 1:
                for _, string, place, _ in found[start:i]:
                    masks[string] = masks.get(string, 0) | 1 << place
            start = i
    return masks


_ANSWER = pa.schema([("block", pa.int64()), ("answer", pa.binary())])


def _count(table: pa.Table, size: int) -> pa.Table:
    """Count the windows of a bucket; the answer to a block: digest and bits of its strings."""
    strings, blocks, flags, routes = [], [], [], []
    for block, packed in zip(table.column("block").to_pylist(), table.column("packed").to_pylist(), strict=True):
        own, flag, route = _unpack(packed)
        strings += own
        blocks += [block] * len(own)
        flags.append(flag)
        routes.append(route)
    flag, route = np.concatenate(flags), np.concatenate(routes)
    order = np.argsort(route, kind="stable")
    edges = np.flatnonzero(np.diff(route[order])) + 1
    edges = np.concatenate([[0], edges, [len(order)]])
    alone = (np.diff(edges) == 1) & (flag[order[edges[:-1]]] == 0)
    answers: dict[int, list[bytes]] = {}
    for g in np.flatnonzero(~alone).tolist():
        own = order[edges[g] : edges[g + 1]].tolist()
        held: dict[bytes, int] = {}
        for i in own:
            held[strings[i]] = held.get(strings[i], 0) + 1 + (int(flag[i]) & 1)
        masks = _repeated(held, size)
        for i in own:
            if mask := masks.get(strings[i]):
                answers.setdefault(blocks[i], []).append(
                    xxhash.xxh3_128_digest(strings[i]) + struct.pack("<Q", mask)
                )
    rows = [{"block": b, "answer": b"".join(a)} for b, a in answers.items()]
    return pa.Table.from_pylist(rows, schema=_ANSWER)


def _spans(covered: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]


_FOUND = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _mark(docs: pa.Table, answers: pa.Table, size: int, hot: Broadcast) -> pa.Table:
    """Covered words of a block's texts."""
    bits = {
        answer[i : i + 16]: answer[i + 16 : i + 24]
        for answer in answers.column("answer").to_pylist() for i in range(0, len(answer), 24)
    }
    texts = text_bytes(docs.column("text"))
    n_words, spans, kept, cleaned = [], [], [], []
    for part in chunks([len(t) for t in texts], _PART_BYTES):
        words, (first, length, strings, _, _) = _items(texts[part], size, hot.value if bits else _NONE)
        cover = np.zeros(len(words.hashes) + 1, dtype=np.int64)
        if bits:
            digests = map(xxhash.xxh3_128_digest, strings)
            hit = [(i, m) for i, m in enumerate(map(bits.get, digests)) if m]
            if hit:
                rows = np.array([i for i, _ in hit])
                masks = np.frombuffer(b"".join(m for _, m in hit), np.uint8).reshape(-1, 8)
                run, place = np.nonzero(np.unpackbits(masks, axis=1, bitorder="little"))
                start = first[rows[run]] + place
                np.add.at(cover, start, 1)
                np.add.at(cover, start + size, -1)
        covered = np.cumsum(cover[:-1]) > 0
        for k, own in enumerate(words.rows):
            marked = covered[words.firsts[k] : words.firsts[k + 1]]
            n_words.append(len(own))
            if marked.any():
                spans.append(_spans(marked))
                kept.append(b" ".join([own[i] for i in np.flatnonzero(~marked).tolist()]))
                cleaned.append(kept[-1])
            else:
                spans.append([])
                kept.append(b" ".join(own))
                cleaned.append(None)
    given = docs.column("text")
    changed = pa.chunked_array([pa.array(cleaned, pa.binary()).cast(given.type)])
    return pa.Table.from_arrays([
        docs.column("row"), pa.chunked_array([pa.array(n_words, pa.int64())]),
        pa.chunked_array([pa.array(spans, pa.list_(_FOUND))]),
        pc.coalesce(changed, given),
        pa.chunked_array([pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]),
    ], names=["row", "n_words", "spans", "cleaned", "kept_sha256"])


def _minimisers(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """How many distinct strings each minimiser has in a task's texts."""
    held: list[np.ndarray] = []

    def counted() -> pa.RecordBatch:
        value, run = np.concatenate([np.zeros((0, 2), np.uint64), *held]).T
        held.clear()
        order = np.lexsort((run, value))
        value, run = value[order], run[order]
        distinct = np.ones(len(value), dtype=bool)
        distinct[1:] = (value[1:] != value[:-1]) | (run[1:] != run[:-1])
        values, n = np.unique(value[distinct], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n, pa.int64())], names=["minimiser", "n"])

    for batch in batches:
        texts = text_bytes(batch.column("text"))
        for part in chunks([len(t) for t in texts], _PART_BYTES):
            words = Words(texts[part])
            first, length, value, _ = words.super_kmers(size)
            if len(first):
                held.append(np.stack([value, words.run_hashes(first, length + size - 1)], axis=1))
            if sum(map(len, held)) > _COUNTED_AT_ONCE:
                yield counted()
    yield counted()
    give_back()


def _trimmed(out: pa.Table) -> pa.Table:
    """What a group gives, when all that it took is freed."""
    give_back()
    return out


def hot_minimisers(rows: DataFrame, size: int) -> np.ndarray:
    """Minimisers of more than HOT_STRINGS strings, the HOT_LIST largest at most, in ascending order."""
    counts = rows.select("text").mapInArrow(partial(_minimisers, size=size), "minimiser long, n long")
    counts = counts.groupBy("minimiser").agg(F.sum("n").alias("n")).where(F.col("n") > HOT_STRINGS)
    found = counts.orderBy(F.desc("n"), "minimiser").limit(HOT_LIST).select("minimiser").toArrow()
    return np.sort(found.column(0).to_numpy().view(np.uint64))


def repeated_windows(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 35, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Each row of docs with n_words and spans of words in repeated windows.

    cleaned: the words outside, joined by one space, or the text as it is where none is
    inside; kept_sha256: SHA-256 of the joined words in both cases. `row` is without the text.
    """
    blocks = block_count(docs, text, block_bytes)
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text).cast("string")), F.lit(blocks)).alias("block"),
        F.col(text).cast("string").alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"),
    )
    hot = docs.sparkSession.sparkContext.broadcast(hot_minimisers(rows, size))
    buckets = blocks * BUCKETS_PER_BLOCK
    # As many partitions as groups: a task has a few groups, whatever the number of all.
    dealt = rows.repartition(blocks, "block")
    sent = dealt.groupBy("block").applyInArrow(
        lambda key, table: _trimmed(_send(key, table, size, buckets, hot)),
        "bucket long, block long, packed binary",
    )
    answers = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(
        lambda table: _trimmed(_count(table, size)), "block long, answer binary"
    )
    added = T.StructType.fromDDL(
        "n_words long, spans array<struct<start: long, end: long>>, cleaned string, kept_sha256 string"
    )
    found = T.StructType([T.StructField("row", rows.schema["row"].dataType, False), *added.fields])
    return dealt.groupBy("block").cogroup(answers.repartition(blocks, "block").groupBy("block")).applyInArrow(
        lambda texts, given: _trimmed(_mark(texts, given, size, hot)), found
    )


def op2_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of `documents` inside repeated windows of 35 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_windows(docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        "kept_sha256",
    )
