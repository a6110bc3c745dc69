"""Ranked lexical search of many items at once, sums of shared terms formed once.

Items of one language share many terms. Sets of terms that several items hold are mined
greedily: the pair of symbols (terms, or sets found before) that most items hold becomes a
set of its own, until no pair is in two items. What comes out is a directed graph: terms at
its sources, a node for each set, the items at its ends. A block of documents is scored
along the graph: the accumulator of a node is the sum of two others, formed once however
many items use it, and an item's scores are the sum of the few symbols it is left with.

A first map over the documents looks up the items' vocabulary and writes each document's
length and term counts; document frequencies are added up from that table, and a second map
over it scores and keeps the best of each task. Documents are never grouped by term, so a
term that all documents hold is as good as any. Items beyond `ITEM_BYTES` of text are
worked off in further passes.

Contract of `search`: null and empty documents and items have no terms; such documents do
not count, such items find nothing. A document without an id counts in the statistics, but cannot be
named, so it is not ranked. Repeated rows are documents of their own. An item id, null too,
with several texts asks with the smallest one. Equal scores go by document id. Texts of
any length are read whole, piece by piece. Empty tables give no rows. Further columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from couponloom.llm.text import text_bytes
from couponloom.llm.top_k import Best
from couponloom.llm.wu_manber import FOLD
from couponloom.workspace import private_folder, private_stage

#: Bytes of item texts whose vocabulary is looked up in one pass over the documents.
ITEM_BYTES = 1 << 20
#: Items that share one graph.
GROUP = 256
#: Symbols of an item among which pairs are mined; those of a longer item are mined part by part.
SPAN = 128
#: Bytes of the accumulators of a block of documents.
_MATRIX_BYTES = 32 << 20
_PIECE_BYTES = 1 << 20
_FOUND = "item long, doc_id long, score long"


def term_counts(text: bytes) -> Counter[bytes]:
    """Occurrences of each term [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+, A-Z lower-cased."""
    folded, counts, at = text.translate(FOLD), Counter(), 0
    while at < len(folded):
        end = folded.find(b" ", at + _PIECE_BYTES)
        end = len(folded) if end < 0 else end
        counts.update(folded[at:end].split())
        at = end
    return counts


def shared_sets(items: list[list[int]], symbols: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """(nodes, rests): node i is symbol `symbols + i`, the union of two; an item is the union of its rest.

    Symbols of an item are distinct. Every symbol of an item is in exactly one member of its
    rest, so sums over rests are sums over items.
    """
    spans: list[set[int]] = []
    owner: list[int] = []
    for i, item in enumerate(items):
        for at in range(0, len(item), SPAN):
            spans.append(set(item[at : at + SPAN]))
            owner.append(i)
    holders: dict[int, set[int]] = {}
    for s, span in enumerate(spans):
        for x in span:
            holders.setdefault(x, set()).add(s)
    mined = {x for x, held in holders.items() if len(held) > 1}
    counts: Counter[tuple[int, int]] = Counter()
    for span in spans:
        common = sorted(span & mined)
        counts.update((x, y) for k, x in enumerate(common) for y in common[k + 1 :])
    heap = [(-n, *pair) for pair, n in counts.items() if n > 1]
    heapq.heapify(heap)
    nodes: list[tuple[int, int]] = []
    while heap:
        n, a, b = heapq.heappop(heap)
        now = counts[a, b]
        if now != -n:
            if now > 1:
                heapq.heappush(heap, (-now, a, b))
            continue
        new = symbols + len(nodes)
        nodes.append((a, b))
        inside = holders[a] & holders[b]
        fresh: Counter[int] = Counter()
        for s in inside:
            span = spans[s]
            span -= {a, b}
            for x in span & mined:
                fresh[x] += 1
                counts[min(a, x), max(a, x)] -= 1
                counts[min(b, x), max(b, x)] -= 1
            span.add(new)
        mined.add(new)
        counts[a, b] = 0
        holders[a], holders[b], holders[new] = holders[a] - inside, holders[b] - inside, inside
        for x, n in fresh.items():
            counts[x, new] = n
            if n > 1:
                heapq.heappush(heap, (-n, x, new))
    rests: list[list[int]] = [[] for _ in items]
    for s, span in enumerate(spans):
        rests[owner[s]] += sorted(span)
    return nodes, rests


@dataclass(frozen=True)
class Graph:
    """Items that are scored together. Symbols: leaves, a term taken `repeats` times, then nodes."""

    first: int
    terms: np.ndarray
    leaf_place: np.ndarray
    repeats: np.ndarray
    nodes: list[tuple[int, int]]
    rests: list[list[int]]

    @property
    def documents(self) -> int:
        """Documents whose accumulators are held at once."""
        rows = len(self.terms) + len(self.leaf_place) + len(self.nodes) + len(self.rests)
        return max(1, min(1024, _MATRIX_BYTES // (8 * max(1, rows))))

    def scores(self, place: np.ndarray, doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """(items, documents) from the values of term places in documents."""
        base = np.zeros((len(self.terms), n), dtype=np.int64)
        base[place, doc] = value
        leaves = len(self.leaf_place)
        sums = np.empty((leaves + len(self.nodes), n), dtype=np.int64)
        np.multiply(base[self.leaf_place], self.repeats[:, None], out=sums[:leaves])
        for i, (a, b) in enumerate(self.nodes, leaves):
            np.add(sums[a], sums[b], out=sums[i])
        out = np.zeros((len(self.rests), n), dtype=np.int64)
        for i, rest in enumerate(self.rests):
            for symbol in rest:
                out[i] += sums[symbol]
        return out


def graphs(items: list[Counter[int]]) -> list[Graph]:
    """The items' graphs, a group of items each."""
    out = []
    for first in range(0, len(items), GROUP):
        group = items[first : first + GROUP]
        leaves = sorted({leaf for item in group for leaf in item.items()})
        number = {leaf: i for i, leaf in enumerate(leaves)}
        terms = np.array(sorted({t for t, _ in leaves}), dtype=np.int64)
        nodes, rests = shared_sets([sorted(number[x] for x in item.items()) for item in group], len(leaves))
        out.append(Graph(
            first, terms, np.searchsorted(terms, np.array([t for t, _ in leaves], dtype=np.int64)),
            np.array([r for _, r in leaves], dtype=np.int64), nodes, rests,
        ))
    return out


@dataclass(frozen=True)
class Plan:
    graphs: list[Graph]
    weights: np.ndarray
    documents: int
    all_terms: int
    items: int


def _look_up(batches: Iterator[pa.RecordBatch], vocabulary: Broadcast) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, terms, counts) of the documents that have terms."""
    known = vocabulary.value
    for batch in batches:
        rows, lengths, offsets, terms, counts = [], [], [0], [], []
        for i, text in enumerate(text_bytes(batch.column(1))):
            held = term_counts(text)
            if not held:
                continue
            rows.append(i)
            lengths.append(held.total())
            hits = [(known[t], n) for t, n in held.items() if t in known]
            terms += [t for t, _ in hits]
            counts += [n for _, n in hits]
            offsets.append(len(terms))
        at = pa.array(offsets, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())),
                pa.ListArray.from_arrays(at, pa.array(counts, pa.int64())),
            ],
            names=["doc_id", "n", "terms", "counts"],
        )


def _best_of_task(batches: Iterator[pa.RecordBatch], plan: Broadcast, k: int) -> Iterator[pa.RecordBatch]:
    held: Plan = plan.value
    best = [Best(len(g.rests), k) for g in held.graphs]
    for batch in batches:
        ids, n, lists, counted = (batch.column(c) for c in ("doc_id", "n", "terms", "counts"))
        ids, n = ids.to_numpy(), n.to_numpy()
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        terms, tf = (x.flatten().to_numpy().astype(np.int64) for x in (lists, counted))
        doc = np.repeat(np.arange(len(ids)), np.diff(ends))
        spread = 100 - 25 + (25 * n * held.documents) // held.all_terms
        value = held.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * spread[doc]))
        for graph, found in zip(held.graphs, best, strict=True):
            place = np.full(len(held.weights), -1, dtype=np.int64)
            place[graph.terms] = np.arange(len(graph.terms))
            for at in range(0, len(ids), graph.documents):
                end = min(at + graph.documents, len(ids))
                part = slice(ends[at], ends[end])
                own = place[terms[part]]
                here = own >= 0
                scores = graph.scores(own[here], doc[part][here] - at, value[part][here], end - at)
                item, row = np.nonzero(scores >= np.maximum(found.least, 1)[:, None])
                found.add(item, scores[item, row], ids[at + row])
    for graph, found in zip(held.graphs, best, strict=True):
        item, rank = np.nonzero(found.scores > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(graph.first + item), pa.array(found.ids[item, rank]), pa.array(found.scores[item, rank])],
            names=["item", "doc_id", "score"],
        )


def _score_block(docs: DataFrame, texts: list[bytes], k: int) -> DataFrame | None:
    """(item, doc_id, score): the best of each task for the items of a block."""
    spark = docs.sparkSession
    counted = [term_counts(t) for t in texts]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counted)))}
    if not vocabulary:
        return None
    known = spark.sparkContext.broadcast(vocabulary)
    hits = private_stage(spark, "search-terms", lambda: docs.mapInArrow(
        partial(_look_up, vocabulary=known), "doc_id long, n long, terms array<int>, counts array<long>"
    ))
    documents, all_terms = hits.agg(F.count("*"), F.sum("n")).first()
    if not documents:
        return None
    held = hits.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()
    frequency = np.zeros(len(vocabulary), dtype=np.int64)
    for row in held:  # a row for each term of the block's items at most
        frequency[row["term"]] = row["df"]
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in frequency.tolist()]
    items = [Counter({vocabulary[t]: n for t, n in c.items()}) for c in counted]
    plan = Plan(graphs(items), np.array(weights, dtype=np.int64), documents, all_terms, len(items))
    return hits.where("doc_id IS NOT NULL AND size(terms) > 0").mapInArrow(
        partial(_best_of_task, plan=spark.sparkContext.broadcast(plan), k=k), _FOUND
    )


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0."""
    spark = docs.sparkSession
    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked = items.groupBy(F.col(item_key).alias("item_id")).agg(F.min(F.col(item_text).cast("string")).alias("text"))
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / ITEM_BYTES))
    folder = private_folder(spark, "search")
    kind = asked.schema["item_id"].dataType
    schema = f"item_id {kind.simpleString()}, doc_id long, score long"
    spark.createDataFrame([], schema).write.parquet(folder)
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else asked
        rows = sorted(part.where("text IS NOT NULL").collect(), key=lambda r: (r["text"], str(r["item_id"])))
        found = _score_block(read, [r["text"].encode() for r in rows], k)
        if found is not None:
            names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item long, item_id {kind.simpleString()}")
            found.join(F.broadcast(names), "item").select("item_id", "doc_id", "score").write.mode("append").parquet(folder)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return (
        spark.read.schema(schema).parquet(folder).withColumn("rank", rank).where(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score")
    )


def op11_shared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best of all `documents` for every item of `benchmark`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
