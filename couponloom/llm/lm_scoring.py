"""Scoring of whole texts by a subword attention model and by word counts.

The texts are dealt into blocks by a hash of key and text. One pass over the blocks encodes
each distinct word of a block once and gathers
1. each distinct word and each distinct pair of neighbouring subword ids, once a block, with
   their counts in the block's training texts. They go to buckets by their hash; a bucket adds
   up and answers each block in the order of its words and pairs. So a word or pair travels
   once a block, never once an occurrence, and no word's rows can pile up. Every word and
   every pair keeps its count.
2. all texts as their ids and their words' numbers, with the rows they are of, packed into parts
   of about PART_IDS ids, training texts apart from the others. A block is a random share of the
   texts, so no window is shuffled, and copies of a text are in many parts.

Learning runs over all texts that are not held out:
1. Ids with like neighbours become one class (at most CLASSES of them; the tables that
   reach the driver are bounded by the tokenizer's vocabulary).
2. In each of `ROUNDS` rounds every part trains from the same weights on all windows of its
   texts, in an order of its own, and the parts' weights are averaged by Spark, weight by weight.

Then each block scores its parts with the answers of the buckets; no text is read again.

Contract of `score`: null texts are empty; an empty text is the end token alone; very long texts
are scored whole. Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z. Rows that repeat are
counted and scored each. Without training texts all counts are zero and the model is uniform
over classes and ids; without rows there is no result. Rows keep all their columns in the
struct `row`.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from couponloom.llm import attention
from couponloom.llm.attention import CLASSES, PAIR_BITS, SCORED
from couponloom.llm.text import BLOCK_BYTES, block_count, chunks, give_back, id_remainder, keep_freed, ragged, text_bytes
from couponloom.llm.word_ids import word_encoder
from couponloom.workspace import private_stage

ROUNDS = 3
#: Ids of training texts that are trained on one after the other; a longer text is a part of its own.
PART_IDS = 16_384 * SCORED
#: Ids by whose neighbourhood all ids are put into classes.
NEIGHBOURS = 256
#: Ids rarer than this share a class.
LEAST_COUNT = 20
_PAIRS_AT_ONCE = 1 << 22
_PART_BYTES = 8 << 20


class Subwords:
    """Texts as start id, ids of the lower-cased text, end id."""

    def __init__(self, path: str):
        self._encoder = word_encoder(path)
        vocabulary = self._encoder.vocabulary
        self.start, self.end = vocabulary, vocabulary + 1
        self.size = vocabulary + 2

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and their number for each word: a text's ids are those of its words."""
        return self._encoder.encode(words)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.enclosed(*self._encoder.encode(texts))

    def enclosed(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end id put around each text's ids."""
        out = np.empty(len(ids) + 2 * len(lengths), dtype=np.int64)
        after = np.cumsum(lengths + 2)
        first = after - lengths - 2
        inner = np.ones(len(out), dtype=bool)
        inner[first] = inner[after - 1] = False
        out[first], out[after - 1], out[inner] = self.start, self.end, ids
        return out, lengths + 2


def _columns(frame: DataFrame) -> list[np.ndarray]:
    """Columns of a bounded table."""
    found = frame.toArrow()
    return [found.column(i).to_numpy() for i in range(found.num_columns)]


def find_classes(pairs: DataFrame, vocabulary: int, start: int, end: int, seed: int) -> np.ndarray:
    """Class of each id: 0 for rare ids, 1 and 2 for start and end, the others by their neighbours."""
    before = pairs.groupBy(F.shiftright("pair", PAIR_BITS).alias("id")).agg(F.sum("n").alias("n"))
    ids, n = _columns(before)
    classes = np.zeros(vocabulary, dtype=np.int64)
    count = np.zeros(vocabulary)
    count[ids] = n
    common = np.flatnonzero(count >= LEAST_COUNT)
    common = common[(common != start) & (common != end)]
    top = common[np.argsort(-count[common], kind="stable")][:NEIGHBOURS]
    spark = pairs.sparkSession
    if len(common):
        numbers = spark.createDataFrame([(int(i), k) for k, i in enumerate(top)], "id long, place int")
        left, right = F.shiftright("pair", PAIR_BITS), F.col("pair").bitwiseAND((1 << PAIR_BITS) - 1)
        near = pairs.select(left.alias("a"), right.alias("b"), "n")
        after = near.join(F.broadcast(numbers.withColumnRenamed("id", "b")), "b").select("a", "place", "n")
        ahead = near.join(F.broadcast(numbers.withColumnRenamed("id", "a")), "a").select(
            F.col("b").alias("a"), (F.col("place") + NEIGHBOURS).alias("place"), "n"
        )
        a, place, n = _columns(after.union(ahead))
        row = np.full(vocabulary, -1)
        row[common] = np.arange(len(common))
        keep = row[a] >= 0
        profiles = np.zeros((len(common), 2 * NEIGHBOURS))
        np.add.at(profiles, (row[a[keep]], place[keep]), n[keep])
        profiles = np.sqrt(profiles / np.maximum(profiles.sum(axis=1, keepdims=True), 1))
        classes[common] = 3 + attention.cluster(profiles, np.sqrt(count[common]), CLASSES - 3, seed)
    classes[start], classes[end] = 1, 2
    return classes


def _forget_words() -> None:
    """No text is encoded any more: the words that a reused worker remembers make room for what is computed."""
    word_encoder.cache_clear()
    give_back()
    keep_freed()


def _train_part(batches: Iterator[pa.RecordBatch], given: Broadcast, values: np.ndarray, turn: int) -> Iterator[pa.RecordBatch]:
    """Weights after one pass over each part, summed by the numbers of their windows."""
    corpus = given.value
    _forget_words()
    n_classes = corpus.prior.shape[1]
    total, count = np.zeros(len(values)), 0
    for batch in batches:
        for block, part, packed in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "packed")), strict=True):
            ids, lengths = _read_ids(packed)
            ids = corpus.place[ids]

            def cut(chosen: np.ndarray, ids=ids, lengths=lengths) -> tuple[np.ndarray, ...]:
                _, inputs, ahead, targets, valid = attention.windows(ids, lengths, chosen)
                before = np.where(ahead, np.float32(-1e9), np.float32(0))
                return corpus.classes[inputs], inputs, before, corpus.classes[targets], valid.astype(np.float32)

            order = np.random.default_rng([turn, block, part]).permutation(int(attention.window_counts(lengths).sum()))
            found = attention.train(attention.unflat(values, n_classes), corpus.prior, cut, order)
            total += attention.flat(found).astype(np.float64) * len(order)
            count += len(order)
    give_back()
    if count:
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), float(count))),
        ], names=["place", "total", "windows"])


def learn(pairs: DataFrame, parts: DataFrame, subwords: Subwords, seed: int = 1) -> tuple[Broadcast, attention.Weights]:
    """Corpus tables, sent to all tasks, and attention weights from all pairs and parts of the training texts."""
    spark = pairs.sparkSession
    classes = find_classes(pairs, subwords.size, subwords.start, subwords.end, seed)
    of = spark.createDataFrame(pa.table({"a": np.arange(len(classes)), "class": classes}))
    left, right = F.shiftright("pair", PAIR_BITS), F.col("pair").bitwiseAND((1 << PAIR_BITS) - 1)
    both = pairs.select(left.alias("a"), right.alias("b"), "n")
    sums = both.join(F.broadcast(of), "a").groupBy("class", "b").agg(F.sum("n").alias("n"))
    after_id = both.join(F.broadcast(of.withColumnRenamed("a", "b")), "b").groupBy("a", "class").agg(
        F.sum("n").alias("n"), F.count("*").alias("kinds")
    )
    *after, kinds = _columns(after_id)
    corpus = attention.corpus_tables(classes, CLASSES, tuple(_columns(sums)), tuple(after), kinds)
    weights = attention.initial(CLASSES, seed)
    given = spark.sparkContext.broadcast(corpus)
    for turn in range(ROUNDS if len(kinds) else 0):
        found = parts.mapInArrow(
            partial(_train_part, given=given, values=attention.flat(weights), turn=turn), "place long, total double, windows double"
        )
        mean = found.groupBy("place").agg((F.sum("total") / F.sum("windows")).alias("value")).orderBy("place")
        weights = attention.unflat(_columns(mean)[1], CLASSES)
    return given, weights


class _Words:
    """Distinct words of many texts, numbered as they come, with their ids and their counts in training texts."""

    def __init__(self, subwords: Subwords):
        self.numbers: dict[bytes, int] = {}
        self.counts = np.zeros(0, dtype=np.int64)
        self._subwords = subwords
        self._ids, self._lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def add(self, texts: list[bytes], learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words one after the other, and how many words each text has."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).cast(pa.string())))
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.cast(pa.binary()).to_pylist()
        before, get = len(self.numbers), self.numbers.setdefault
        # White space at either end of a text leaves an empty string there, which is no word.
        own = np.fromiter((get(w, len(self.numbers)) if w else -1 for w in names), np.int64, len(names))
        self._learn(names, own >= before)
        numbers = own[coded.indices.to_numpy(zero_copy_only=False)]
        real = numbers >= 0
        lengths = np.diff(np.concatenate([[0], np.cumsum(real)])[lists.offsets.to_numpy()])
        numbers = numbers[real]
        counts = np.bincount(numbers[np.repeat(learned, lengths)], minlength=len(self.numbers))
        counts[:before] += self.counts
        self.counts = counts
        return numbers, lengths

    def _learn(self, names: list[bytes], new: np.ndarray) -> None:
        # The encoder gets all words at hand, of which it remembers those that it knows, as other blocks have them too.
        ids, lengths = self._subwords.words(names)
        self._ids = np.concatenate([self._ids, ids[np.repeat(new, lengths)]])
        self._lengths = np.concatenate([self._lengths, lengths[new]])
        self._starts = np.cumsum(self._lengths) - self._lengths

    def lengths(self, numbers: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """Ids of each text, given as numbers of its words, with start and end."""
        after = np.concatenate([[0], np.cumsum(self._lengths[numbers])])[np.cumsum(n_words)]
        return np.diff(after, prepend=0) + 2

    def encode(self, numbers: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts given as numbers of their words, as `Subwords.encode` has them."""
        ids = self._ids[ragged(self._starts[numbers], self._lengths[numbers])]
        return self._subwords.enclosed(ids, self.lengths(numbers, n_words) - 2)


def _in_order(words, buckets: int) -> list[tuple[int, list[bytes]]]:
    """Distinct words by bucket, sorted in each."""
    held: dict[int, list[bytes]] = {}
    for word in words:
        held.setdefault(xxhash.xxh3_64_intdigest(word) % buckets, []).append(word)
    return [(bucket, sorted(own)) for bucket, own in sorted(held.items())]


def _pair_order(pairs: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """Places of distinct pairs, which are in order, by bucket."""
    bucket = (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets))
    return [(k, own) for k, own in enumerate(np.split(order, ends[:-1])) if len(own)]


class _Pairs:
    """Distinct pairs of ids of many texts with their counts, merged as they grow."""

    def __init__(self):
        self._held: list[tuple[np.ndarray, np.ndarray]] = []
        self._size = 0

    def add(self, pairs: np.ndarray, counted: bool) -> None:
        keys, n = np.unique(pairs, return_counts=True)
        self.merge(keys, n * counted)

    def merge(self, keys: np.ndarray, n: np.ndarray) -> None:
        self._held.append((keys, n))
        self._size += len(keys)
        if self._size > _PAIRS_AT_ONCE:
            self.all()

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if not self._held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, n = (np.concatenate(x) for x in zip(*self._held, strict=True))
        unique, place = np.unique(keys, return_inverse=True)
        self._held = [(unique, np.bincount(place, n, minlength=len(unique)).astype(np.int64))]
        # What is merged is not counted: the next merge waits for as much again.
        self._size = 0
        return self._held[0]


#: Kinds of rows that a block sends: distinct words, distinct pairs, training texts and other texts.
WORDS, PAIRS, PART, HELD = range(4)
_SENT = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("packed", pa.binary()),
                   ("words", pa.binary())])
_SENT_DDL = "kind int, bucket long, block long, packed binary, words binary"


def _pack_ids(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(
        struct.pack("<I", len(lengths)) + lengths.astype("<u8").tobytes() + ids.astype("<u4").tobytes()
    )


def _read_ids(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    plain = zstandard.ZstdDecompressor().decompress(packed)
    (size,) = struct.unpack_from("<I", plain)
    return np.frombuffer(plain, "<u4", -1, 4 + 8 * size), np.frombuffer(plain, "<u8", size, 4).astype(np.int64)


def _send(key: tuple, table: pa.Table, buckets: int, tokenizer: str) -> pa.Table:
    """The distinct words and pairs of a block with their counts in its training texts, and its texts.

    Texts go as their ids and as their words' places among all words sent, with the rows they are of.
    """
    block, subwords = key[0].as_py(), Subwords(tokenizer)
    words, pairs, out, parts = _Words(subwords), _Pairs(), [], []
    texts = text_bytes(table.column("text"))
    learned = np.array(table.column("learned").to_pylist(), dtype=bool)
    # An order that does not depend on how the rows came.
    order = np.array(sorted(range(len(texts)), key=lambda i: (xxhash.xxh3_128_digest(texts[i]), learned[i])))
    sent = {PART: 0, HELD: 0}
    for chunk in chunks([len(texts[i]) for i in order], _PART_BYTES):
        own = order[chunk]
        train = learned[own]
        numbers, n_words = words.add([texts[i] for i in own], train)
        sizes, first = words.lengths(numbers, n_words), np.cumsum(n_words) - n_words
        for kind, chosen in (PART, np.flatnonzero(train)), (HELD, np.flatnonzero(~train)):
            for part in chunks(sizes[chosen].tolist(), PART_IDS):
                at = chosen[part]
                some = numbers[ragged(first[at], n_words[at])]
                ids, lengths = words.encode(some, n_words[at])
                pairs.add(attention.pairs_of(ids, lengths)[0], kind == PART)
                parts.append((kind, sent[kind], _pack_ids(ids, lengths), some.astype(np.uint32), n_words[at], own[at]))
                sent[kind] += 1
        give_back()
    compress = zstandard.ZstdCompressor(level=3).compress
    place, before = np.empty(len(words.numbers), dtype=np.int64), 0
    for bucket, held in _in_order(words.numbers, buckets):
        at = np.fromiter((words.numbers[w] for w in held), np.int64, len(held))
        place[at] = before + np.arange(len(held))
        before += len(held)
        out.append({"kind": WORDS, "bucket": bucket, "block": block,
                    "packed": compress(struct.pack("<I", len(held)) + words.counts[at].astype("<u4").tobytes() + b" ".join(held))})
    give_back()
    keys, n = pairs.all()
    for bucket, held in _pair_order(keys, buckets):
        out.append({"kind": PAIRS, "bucket": bucket, "block": block, "packed": _pack_pairs(keys[held], n[held])})
    offsets = np.cumsum([0] * (1 + len(out)) + [len(rows) for *_, rows in parts])
    for kind, number, packed, numbers, n_words, _ in parts:
        out.append({"kind": kind, "bucket": number, "block": block, "packed": packed, "words": _pack_ids(place[numbers], n_words)})
    found = pa.Table.from_pylist(out, schema=_SENT)
    if "row" not in table.column_names:
        return found
    rows = table.column("row").combine_chunks().take(pa.array(np.concatenate([rows for *_, rows in parts])))
    return found.append_column("rows", pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows))


def _pack_pairs(pairs: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs in order, as differences, and their counts."""
    plain = np.diff(pairs, prepend=0).astype("<u8").tobytes() + n.astype("<u8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(plain)


def _read_pairs(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<u8").astype(np.int64).reshape(2, -1)
    return np.cumsum(both[0]), both[1]


_ANSWER_DDL = "kind int, block long, bucket long, totals binary, all_words long, known long"
_ANSWER = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int64()), ("totals", pa.binary()),
                     ("all_words", pa.int64()), ("known", pa.int64())])


def _add(key: tuple, table: pa.Table) -> pa.Table:
    """Totals of a bucket's words or pairs, for each block in the order in which it sent them.

    Pairs come with their totals; those that are in training texts follow in a row without a block.
    """
    kind, bucket = key[0].as_py(), key[1].as_py()
    blocks, packs = table.column("block").to_pylist(), table.column("packed").to_pylist()
    compress = zstandard.ZstdCompressor(level=3).compress
    row = {"kind": kind, "bucket": bucket, "all_words": 0, "known": 0}
    if kind == PAIRS:
        merged, rows = _Pairs(), []
        for packed in packs:
            merged.merge(*_read_pairs(packed))
        keys, n = merged.all()
        for block, packed in zip(blocks, packs, strict=True):
            own = _read_pairs(packed)[0]
            rows.append(row | {"block": block, "totals": _pack_pairs(own, n[np.searchsorted(keys, own)])})
        if n.any():
            rows.append(row | {"block": None, "totals": _pack_pairs(keys[n > 0], n[n > 0])})
        return pa.Table.from_pylist(rows, schema=_ANSWER)
    decompress, held, totals = zstandard.ZstdDecompressor().decompress, [], Counter()
    for packed in packs:
        plain = decompress(packed)
        (size,) = struct.unpack_from("<I", plain)
        words, n = plain[4 + 4 * size :].split(b" "), np.frombuffer(plain, "<u4", size, 4).tolist()
        held.append(words)
        for word, k in zip(words, n, strict=True):
            totals[word] += k
    sums = {"all_words": sum(totals.values()), "known": sum(1 for n in totals.values() if n)}
    return pa.Table.from_pylist([
        row | {"block": block, "totals": compress(np.fromiter((totals[w] for w in words), "<u8", len(words)).tobytes())}
        | (sums if i == 0 else {})
        for i, (block, words) in enumerate(zip(blocks, held, strict=True))
    ], schema=_ANSWER)


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed in batch.column("totals").to_pylist():
            pairs, n = _read_pairs(packed)
            for at in range(0, len(pairs), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + 100_000]), pa.array(n[at : at + 100_000])], names=["pair", "n"])


def _score(parts: pa.Table, answers: pa.Table, sums: tuple[int, int, int], corpus: Broadcast, weights: attention.Weights) -> pa.Table:
    """Counts and scores of a block's texts."""
    _forget_words()
    n_tokens, n_types, n_texts = sums
    answers = answers.sort_by([("kind", "ascending"), ("bucket", "ascending")])
    kinds, totals = (answers.column(c).to_pylist() for c in ("kind", "totals"))
    decompress = zstandard.ZstdDecompressor().decompress
    # Counts of the block's words in the order in which it sent them, and of the end token.
    found = np.concatenate([*(np.frombuffer(decompress(t), "<u8") for k, t in zip(kinds, totals, strict=True) if k == WORDS),
                            np.array([n_texts], "<u8")]).astype(np.int64)
    keys, n = np.concatenate([np.stack(_read_pairs(t)) for k, t in zip(kinds, totals, strict=True) if k == PAIRS], axis=1)
    order = np.argsort(keys)
    scorer = attention.Scorer(corpus.value, weights, keys[order], n[order])
    value = np.log10(found + 1.0) - np.log10(float(n_tokens + n_types + 1))
    tokens, known, base, model = [], [], [], []
    for packed, packed_words in zip(*(parts.column(c).to_pylist() for c in ("packed", "words")), strict=True):
        ids, lengths = _read_ids(packed)
        model += scorer(ids.astype(np.int64), lengths).tolist()
        words, n_words = _read_ids(packed_words)
        for row in np.split(words, np.cumsum(n_words)[:-1]):
            tokens.append(len(row) + 1)
            known.append(int((found[row] > 0).sum() + (n_texts > 0)))
            base.append(float(value[row].sum() + value[-1]))
    column = lambda values, kind: pa.chunked_array([pa.array(values, kind)])
    return pa.Table.from_arrays([
        pc.list_flatten(parts.column("rows")), column(tokens, pa.int64()), column(known, pa.int64()),
        column([n_tokens] * len(tokens), pa.int64()), column(base, pa.float64()), column(model, pa.float64()),
    ], names=["row", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _lean(make: Callable[[], pa.Table]) -> pa.Table:
    """A block's result, after the memory that it no longer needs went back to the system."""
    found = make()
    give_back()
    return found


def score(
    docs: DataFrame, learned: Column, tokenizer: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Each row of docs with token counts, word-count score and model score of its whole text."""
    spark, subwords = docs.sparkSession, Subwords(tokenizer)
    blocks = block_count(docs, text, block_bytes)
    buckets = max(1, blocks // 4)
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text).cast("string")), F.lit(blocks)).alias("block"),
        F.col(text).cast("string").alias("text"), F.coalesce(learned, F.lit(False)).alias("learned"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"),
    )
    held = T.StructType([*T.StructType.fromDDL(_SENT_DDL).fields, T.StructField("rows", T.ArrayType(rows.schema["row"].dataType))])
    sent = private_stage(spark, "sent", lambda: rows.groupBy("block").applyInArrow(
        lambda key, table: _lean(lambda: _send(key, table, buckets, tokenizer)), held
    ), partition_by=("kind",))
    answers = private_stage(
        spark, "totals", lambda: sent.where(F.col("kind") < PART).select("kind", "bucket", "block", "packed").groupBy("kind", "bucket").applyInArrow(_add, _ANSWER_DDL)
    )
    pairs = private_stage(
        spark, "pairs", lambda: answers.where("block IS NULL").select("totals").mapInArrow(_pair_rows, "pair long, n long")
    )
    corpus, weights = learn(pairs, sent.where(F.col("kind") == PART).select("block", "bucket", "packed"), subwords)
    counted = answers.agg(F.sum("all_words"), F.sum("known")).first()
    n_texts = docs.where(learned).count()
    sums = (counted[0] or 0) + n_texts, (counted[1] or 0) + (n_texts > 0), n_texts
    added = T.StructType.fromDDL("n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = T.StructType([T.StructField("row", rows.schema["row"].dataType, False), *added.fields])
    texts = sent.where(F.col("kind") >= PART).select("block", "packed", "words", "rows")
    return texts.groupBy("block").cogroup(answers.where("block IS NOT NULL").groupBy("block")).applyInArrow(
        lambda own, totals: _lean(lambda: _score(own, totals, sums, corpus, weights)), out
    )


def op4_attention(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Score all `documents`; those whose crc32 is 2 modulo 7 are held out."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, id_remainder("doc_id", 7) != 2, tokenizer).select(
        F.col("row.doc_id").alias("doc_id"), (id_remainder("row.doc_id", 7) == 2).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )
