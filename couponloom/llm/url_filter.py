"""URL filters by Bloom filter cascades, exact over the corpus and without a join.

A rule is a host and the start of a path; it fits its host and all hosts below. A url can
only be met by few keys: its host's last labels with the start of its path, in the shapes
(labels, bytes of path) that rules have. The keys of all urls are the corpus's key universe. The first
level of a cascade is a Bloom filter of the listed keys, the second one of the universe's unlisted
keys that the first lets through, the third one of the listed keys that the second lets
through, and so on until a level lets nothing wrong through. The first level that a key of the universe
does not pass then tells whether it is listed, with no error left. The first level's rate of false
positives is chosen by the size of the universe, so that as many unlisted keys as
listed ones go on, and the whole cascade takes some log2(universe / listed) + 4 bits a rule.

One cascade tells rules from all other keys, a second one, over the rules, the blocking ones. The
longest key that is a rule gives the verdict and is the rule: nothing is looked up or
shuffled to judge a url. Urls are read three times: to estimate the universe, to gather
what passes the first level (few more keys than rules) and to judge.

Rules whose filters pass `CASCADE_BITS` are dealt by hash to several cascades, which are built and
asked one after the other.

Contract of `judge`: the host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z
lower-cased; the path goes on up to `?`, `#` or the end. A null url and one without `://`
has both empty, no rule fits it, and no rule fits an empty host. A path that is shorter than the rule's
is not met. The longest rule (host and path together, then host) wins; a rule listed as
both blocks. Where no rule fits the verdict is `default`, allow: what is not listed passes.
Rules' hosts are lower-cased like urls; null and repeated rules do nothing. Repeated rows and urls are judged each;
an empty table gives no rows, no rules allow everything. Urls may have any length: keys are no longer than the longest rule.
Rows keep all their columns in the struct `row`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from couponloom.workspace import private_stage

#: Bits of the filters of one cascade, 32 MB; more rules are dealt to several cascades.
CASCADE_BITS = 1 << 28
#: Keys of a level that pass the next one wrongly, a half: short filters, few levels.
_RATE = 0.5
_LEAST_BITS = 64
_MORE_LEVELS = 64
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_KEYS = "key binary, listed boolean"

BLOCK, ALLOW = "block", "allow"


@dataclass
class Level:
    """A Bloom filter; `number` makes its hash another than those of other levels."""

    number: int
    bits: int
    hashes: int
    words: np.ndarray = field(repr=False)

    @classmethod
    def sized(cls, number: int, keys: int, rate: float) -> Level:
        """Empty, for so many keys at the given rate of false positives."""
        rate = min(max(rate, 1e-12), _RATE)
        bits = max(_LEAST_BITS, math.ceil(keys * math.log2(1 / rate) / math.log(2)))
        bits = -(-bits // 64) * 64
        return cls(number, bits, max(1, round(-math.log2(rate))), np.zeros(bits // 64, dtype=np.uint64))

    def places(self, keys: list[bytes]) -> np.ndarray:
        """(keys, hashes) bit numbers: two halves of one hash give them all."""
        seed = 42 + self.number
        h = np.array([xxhash.xxh64_intdigest(k, seed) for k in keys], dtype=np.uint64)
        low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
        turns = np.arange(self.hashes, dtype=np.uint64)
        return (low[:, None] + turns[None, :] * high[:, None]) % np.uint64(self.bits)

    def held(self, keys: list[bytes]) -> np.ndarray:
        """Whether each key passes."""
        at = self.places(keys)
        set_ = self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)
        return set_.all(axis=1)


@dataclass
class Cascade:
    """Levels of listed and unlisted keys in turn, the first of listed ones."""

    levels: list[Level] = field(default_factory=list)

    def passing(self, keys: list[bytes]) -> np.ndarray:
        """Number of levels each key passes before one refuses it."""
        passed = np.zeros(len(keys), dtype=np.int64)
        left = np.arange(len(keys))
        for level in self.levels:
            if not len(left):
                break
            left = left[level.held([keys[i] for i in left.tolist()])]
            passed[left] += 1
        return passed

    def listed(self, keys: list[bytes]) -> np.ndarray:
        """Exact for keys of the universe: refused by an even level, or by none of an odd number."""
        return self.passing(keys) % 2 == 1


def _keys_of(host: bytes, path: bytes, shapes: list[tuple[int, int]], most: int) -> Iterator[bytes]:
    """The url's keys; no shape has more than `most` labels."""
    labels = host.rsplit(b".", most)
    for n, size in shapes:
        if n <= len(labels) and size <= len(path):
            yield b".".join(labels[-n:]) + path[:size]


def _batch_keys(batch: pa.RecordBatch, shapes: list[tuple[int, int]]) -> tuple[list[list[int]], list[bytes]]:
    """Numbers of each url's keys, and the batch's distinct keys."""
    most = max((n for n, _ in shapes), default=1)
    number: dict[bytes, int] = {}
    rows = []
    hosts, paths = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("host", "path"))
    for host, path in zip(hosts, paths, strict=True):
        rows.append([number.setdefault(k, len(number)) for k in _keys_of(host, path, shapes, most)] if host else [])
    return rows, list(number)


def _universe(
    batches: Iterator[pa.RecordBatch], shapes: list[tuple[int, int]], cascade: Broadcast | None, shard: int, shards: int
) -> Iterator[pa.RecordBatch]:
    """Distinct keys of each batch that belong to the shard and pass the levels there are."""
    for batch in batches:
        keys = [k for k in _batch_keys(batch, shapes)[1] if _shard(k, shards) == shard]
        if cascade is not None and keys:
            passed = cascade.value.passing(keys) == len(cascade.value.levels)
            keys = [k for k, p in zip(keys, passed, strict=True) if p]
        unlisted = pa.array([False] * len(keys), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), unlisted], names=["key", "listed"])


def _shard(key: bytes, shards: int) -> int:
    return xxhash.xxh64_intdigest(key, 41) % shards if shards > 1 else 0


def _of_shard(batches: Iterator[pa.RecordBatch], shard: int, shards: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [_shard(k, shards) == shard for k in batch.column("key").to_pylist()]
        yield batch.filter(pa.array(keep, pa.bool_()))


def _survivors(batches: Iterator[pa.RecordBatch], cascade: Broadcast) -> Iterator[pa.RecordBatch]:
    """Rows whose key passes all levels."""
    levels: Cascade = cascade.value
    for batch in batches:
        passed = levels.passing(batch.column("key").to_pylist()) == len(levels.levels)
        yield batch.filter(pa.array(passed))


def _bits(batches: Iterator[pa.RecordBatch], level: Level) -> Iterator[pa.RecordBatch]:
    """(word, bits) that the keys of a batch set."""
    for batch in batches:
        at = level.places(batch.column("key").to_pylist()).ravel()
        words, place = np.unique(at >> np.uint64(6), return_inverse=True)
        bits = np.zeros(len(words), dtype=np.uint64)
        np.bitwise_or.at(bits, place, np.uint64(1) << (at & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])


def _filled(level: Level, keys: DataFrame) -> Level:
    """The filter with the keys in it; its words, a bounded number, are gathered on the driver."""
    # A level without words of its own travels to the tasks.
    empty = Level(level.number, level.bits, level.hashes, np.zeros(0, dtype=np.uint64))
    found = keys.mapInArrow(partial(_bits, level=empty), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    for row in found.toLocalIterator():
        level.words[row["word"]] = np.uint64(row["bits"] & 0xFFFFFFFFFFFFFFFF)
    return level


def build(
    rules: DataFrame, universe: Callable[[Broadcast | None], DataFrame], rules_count: int, universe_count: int,
) -> Cascade:
    """The cascade of the rules' keys, exact over the universe.

    `rules` holds distinct rows of (key, listed true); `universe` gives (key, listed false) of all keys
    that pass given levels, rules among them and repeats allowed.
    """
    spark = rules.sparkSession
    cascade = Cascade()
    if not rules_count:
        return cascade
    rate = rules_count * math.sqrt(_RATE) / max(1, universe_count)
    cascade.levels.append(_filled(Level.sized(0, rules_count, rate), rules))
    sent = spark.sparkContext.broadcast(cascade)
    # A listed key of the universe is there twice and counts as listed.
    left = private_stage(spark, "filter-keys", lambda: (
        universe(sent).unionByName(rules).groupBy("key").agg(F.max("listed").alias("listed"))
    ))
    for number in range(1, _MORE_LEVELS):
        wrong = left.where(F.col("listed") == (number % 2 == 0))
        if number > 1:
            wrong = wrong.mapInArrow(partial(_survivors, cascade=spark.sparkContext.broadcast(cascade)), _KEYS)
        count = wrong.count()
        if not count:
            return cascade
        level = _filled(Level.sized(number, count, _RATE), wrong)
        cascade = Cascade([*cascade.levels, level])
    raise RuntimeError("the filter cascade does not end")


def folded_host(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), _UPPER, _UPPER.lower())


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def _judged(
    batches: Iterator[pa.RecordBatch], cascades: Broadcast, shapes: list[tuple[int, int]], shard: int, shards: int
) -> Iterator[pa.RecordBatch]:
    """Each row with its longest rule of the shard, unless the row has a longer one."""
    member, blocking = cascades.value
    for batch in batches:
        rows, keys = _batch_keys(batch, shapes)
        own = np.array([_shard(k, shards) == shard for k in keys], dtype=bool)
        rule = np.zeros(len(keys), dtype=bool)
        if own.any():
            rule[own] = member.listed([k for k, o in zip(keys, own, strict=True) if o])
        names, blocks = batch.column("rule").to_pylist(), batch.column("blocks").to_pylist()
        found = [max((k for k in row if rule[k]), key=lambda k: _rank(keys[k]), default=None) for row in rows]
        better = [
            i for i, k in enumerate(found)
            if k is not None and (names[i] is None or _rank(keys[k]) > _rank(names[i].encode()))
        ]
        verdicts = dict(zip(
            wanted := sorted({found[i] for i in better}), blocking.listed([keys[k] for k in wanted]).tolist(), strict=True
        ))
        for i in better:
            names[i], blocks[i] = keys[found[i]].decode(errors="replace"), verdicts[found[i]]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("host"), batch.column("path"), pa.array(names, pa.string()), pa.array(blocks, pa.bool_())],
            names=["row", "host", "path", "rule", "blocks"],
        )


def _rank(key: bytes) -> tuple[int, int]:
    """Longer rules first, then those with the longer host."""
    at = key.find(b"/")
    return len(key), len(key) if at < 0 else at


def judge(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW, cascade_bits: int = CASCADE_BITS,
) -> DataFrame:
    """(row, host, path, rule, verdict) of every row; rules are (host, path, verdict block or allow).

    A rule's path is empty or starts with `/`; rules that can fit no url do nothing. A verdict other than block allows.
    """
    spark = pages.sparkSession
    column = F.col(f"`{url}`").cast("string")
    rows = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"),
        folded_host(column).alias("host"), url_path(column).alias("path"),
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("boolean").alias("blocks"),
    )
    host = F.translate(F.col("host").cast("string"), _UPPER, _UPPER.lower())
    path = F.col("path").cast("string")
    able = (host != "") & ~host.rlike("[/?#]") & path.rlike("^(/[^?#]*)?$")
    given = private_stage(spark, "filter-rules", lambda: rules.where(able).groupBy(
        F.concat(host, path).cast("binary").alias("key")
    ).agg(
        F.max(F.coalesce(F.col("verdict") == BLOCK, F.lit(False))).alias("blocks"),
        F.max(F.size(F.split(host, r"\."))).alias("labels"), F.max(F.octet_length(path)).alias("bytes"),
    ))
    # A row for each shape of a rule: labels and bytes of a rule are as many as its url is long.
    shapes = sorted((r[0], r[1]) for r in given.select("labels", "bytes").distinct().collect())
    count = given.count()
    narrow = rows.select("host", "path")
    size = narrow.mapInArrow(partial(_universe, shapes=shapes, cascade=None, shard=0, shards=1), _KEYS).agg(
        F.approx_count_distinct("key")
    ).first()[0] if count else 0
    needed = count * (math.log2(max(2, size / max(1, count))) + 4) / math.log(2)
    shards = max(1, math.ceil(needed / cascade_bits))
    for shard in range(shards if count else 0):
        own = given.select("key", F.lit(True).alias("listed"))
        blocked = given.where("blocks").select("key", F.lit(True).alias("listed"))
        if shards > 1:
            deal = partial(_of_shard, shard=shard, shards=shards)
            own, blocked = own.mapInArrow(deal, _KEYS), blocked.mapInArrow(deal, _KEYS)
        rules_here, blocked_here = own.count(), blocked.count()

        def passing(sent: Broadcast | None, shard: int = shard) -> DataFrame:
            return narrow.mapInArrow(partial(_universe, shapes=shapes, cascade=sent, shard=shard, shards=shards), _KEYS)

        def known(sent: Broadcast | None, own: DataFrame = own) -> DataFrame:
            keys = own.select("key", F.lit(False).alias("listed"))
            return keys if sent is None else keys.mapInArrow(partial(_survivors, cascade=sent), _KEYS)

        member = build(own, passing, rules_here, max(1, size // shards))
        blocking = build(blocked, known, blocked_here, rules_here)
        sent = spark.sparkContext.broadcast((member, blocking))
        rows = rows.mapInArrow(
            partial(_judged, cascades=sent, shapes=shapes, shard=shard, shards=shards),
            T.StructType([*rows.schema.fields]),
        )
    verdict = F.when(F.col("blocks"), BLOCK).when(~F.col("blocks"), ALLOW).otherwise(default)
    return rows.select("row", "host", "path", "rule", verdict.alias("verdict"))


#: Fixed values of the task: host, path, verdict.
RULES = [
    ("net", "/", BLOCK), ("example.net", "/en/", ALLOW), ("example.com", "/de/", BLOCK), ("org", "/fr/", ALLOW),
]


def op12_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every url of `pages`."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(pages, rules).select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")
