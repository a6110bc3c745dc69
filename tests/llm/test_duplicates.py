"""Substring dedup, SimHash near-dedup and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from couponloom.llm import simhash, super_kmers, wu_manber
from couponloom.llm.components import components
from couponloom.llm.super_kmers import repeated_windows
from couponloom.llm.wu_manber import WuManber, occurrences, with_counts
from tests.llm.conftest import ODD, as_rows, by_id, text


def kept_words(texts, size):
    """Words outside repeated windows, by counting all windows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = {p for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for p in range(i, i + size)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def digested(frame):
    return by_id(
        frame.select(
            F.col("row.doc_id").alias("d"), "n_words",
            F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n"), "kept_sha256",
        ), "d", "n_words", "n", "kept_sha256",
    )


def expected(rows, size):
    found = kept_words([t for _, t in rows], size)
    return sorted(
        [(i, n, gone, hashlib.sha256(k.encode()).hexdigest()) for (i, _), (n, gone, k) in zip(rows, found)],
        key=lambda r: [(v is not None, v) for v in r],
    )


@pytest.mark.parametrize("size", [35, 5, 2])
def test_repeated_windows_equal_brute_force(odd, size):
    found = repeated_windows(odd, size=size, block_bytes=10_000)
    assert digested(found) == expected(ODD, size)
    whole = {r["row"]["doc_id"]: r for r in found.collect()}
    assert whole[2]["cleaned"] is None and whole[5]["cleaned"] is not None
    assert whole[7]["cleaned"] == ODD[9][1]


def test_repeated_windows_of_random_texts(documents, monkeypatch):
    rng = random.Random(4)
    shared = [text(100 + k, rng.randrange(36, 90)) for k in range(4)]
    rows = [(i, " ".join(rng.choice([rng.choice(shared), text(i, rng.randrange(60))]) for _ in range(4))) for i in range(80)]
    rows += [(200 + i, "\n".join(["x y z"] * rng.randrange(5, 80))) for i in range(6)]
    docs = documents(rows)
    assert digested(repeated_windows(docs, block_bytes=6000)) == expected(rows, 35)
    # Minimisers that are dealt out by window give the same.
    assert not len(super_kmers.hot_minimisers(docs.select("text"), 35))
    monkeypatch.setattr(super_kmers, "HOT_STRINGS", 2)
    hot = super_kmers.hot_minimisers(docs.select("text"), 35)
    assert len(hot) > 5
    assert digested(repeated_windows(docs, block_bytes=6000)) == expected(rows, 35)


def test_one_long_text_makes_a_minimiser_hot(documents, monkeypatch):
    """Many different strings of one minimiser, all in one text and in no other."""
    monkeypatch.setattr(super_kmers, "HOT_STRINGS", 20)
    rng = random.Random(9)
    # Four words of a small hash are the minimiser wherever they stand.
    runs = [f"k{i} four words here" for i in range(3000)]
    least = min(runs, key=lambda r: int(super_kmers.Words([r.encode()]).super_kmers(4)[2][0]))
    lines = [" ".join([least] + [f"v{rng.randrange(9999)}" for _ in range(rng.randrange(31, 36))]) for _ in range(300)]
    rows = [(0, " ".join(lines)), (1, text(1, 200)), (2, " ".join(lines[5:7]))]
    docs = documents(rows)
    assert len(super_kmers.hot_minimisers(docs.select("text"), 35))
    assert digested(repeated_windows(docs)) == expected(rows, 35)


def test_equal_runs_have_equal_hashes():
    words = super_kmers.Words([b"a b c d e", b"x a b c d", b"b c d e a"])
    hashes = words.run_hashes(np.array([0, 6, 1, 10, 2]), np.array([4, 4, 4, 4, 3]))
    assert hashes[0] == hashes[1] and hashes[2] == hashes[3] and len(set(hashes.tolist())) == 3


def test_no_documents_no_rows(none):
    assert repeated_windows(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0


# SimHash


def test_fingerprint_is_the_majority_of_the_shingles():
    for t in ["", " ", "One", "two WORDS", "three of them", text(1, 50)]:
        words = t.lower().split()
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(t.encode()) == want


def brute_components(values, distance):
    parent = list(range(len(values)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(values)):
        for b in range(a):
            if bin((values[a] ^ values[b]) & (1 << 64) - 1).count("1") <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(values))]


@pytest.mark.parametrize("block_rows", [1024, 8])
def test_links_lose_no_component(spark, monkeypatch, block_rows):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block_rows)
    rng = random.Random(2)
    values = []
    for _ in range(25):
        centre = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 30)):
            flipped = centre
            for _ in range(rng.randrange(5)):
                flipped ^= 1 << rng.randrange(64)
            values.append(flipped)
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(fps, 3)).collect()}
    want = brute_components(values, 3)
    assert [roots.get(v, v) for v in values] == [values[w] for w in want]


def test_allocation_sums_to_the_pigeonhole():
    cost, thresholds = simhash.allocate([[0, 5, 9, 20], [0, 1, 2, 50], [0, 30, 60, 90]], 1)
    assert sum(thresholds) == 1 and thresholds == (1, 1, -1) and cost == 11


def test_bits_are_all_used_once():
    rng = np.random.default_rng(0)
    both = rng.integers(0, 50, (64, 64))
    for m in range(2, 6):
        assert sorted(b for g in simhash.group_bits(100, both + both.T, m) for b in g) == list(range(64))


def test_near_duplicates_of_odd_rows(odd):
    found = by_id(simhash.near_duplicates(odd), "doc_id", "fingerprint", "component_id")
    assert len(found) == len(ODD)
    component = dict((i, c) for i, _, c in found if i is not None)
    assert component[1] == component[6] == 1
    assert component[2] == component[3] == component[4] == 2
    assert [f for i, f, _ in found if i == 3] == ["0" * 16]


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(60)] + [(7, 7)]
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert dict(as_rows(found.collect())) == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)}


# Decontamination


def test_wu_manber_finds_every_occurrence():
    rng = random.Random(5)
    for trial in range(60):
        alphabet = b"ab " if trial % 2 else b"abcdefgh "
        content = bytes(rng.choice(alphabet) for _ in range(rng.randrange(3000)))
        shortest = rng.choice([1, 2, 3, 9, 12])
        patterns = list({bytes(rng.choice(alphabet) for _ in range(rng.randrange(shortest, shortest + 6))) for _ in range(8)})
        want = sorted((i, k) for k, p in enumerate(patterns) for i in range(len(content)) if content.startswith(p, i))
        assert sorted(WuManber(patterns).search(content)) == want


ITEMS = [
    (1, "w1x w2x!"), (2, None), (3, ""), (4, text(1, 30).upper()), (4, text(9, 12)), (5, text(5, 400, 5000)[100:600]),
    (None, text(12, 12)), (11, "ONE"), (21, "Ünï cödé"),
]


def contaminated(rows, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))

    windows = [
        (str(i) if i is not None else "", tuple(w[k : k + 10]))
        for i, t in items for w in [words(t)] if w for k in range(max(1, len(w) - 9))
    ]
    out = []
    for i, t in rows:
        w = words(t)
        hit, found = set(), set()
        for item, window in windows:
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    found.add(item)
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=lambda r: [(v is not None, v) for v in r])


@pytest.mark.parametrize("item_bytes", [1 << 20, 300])
def test_occurrences_equal_brute_force(spark, odd, none, monkeypatch, item_bytes):
    monkeypatch.setattr("couponloom.llm.wu_manber.ITEM_BYTES", item_bytes)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, row string")
    rows = [r for r in ODD if r[0] != 5] + [(5, ODD[4][1][:3000])]
    docs = odd.withColumn("text", F.when(F.col("doc_id") == 5, F.substring("text", 1, 3000)).otherwise(F.col("text")))
    found = with_counts(occurrences(docs, items))
    assert found.select("row.*").columns == docs.columns
    got = by_id(found.select(F.col("row.doc_id").alias("d"), "n_words", "n_hit", "items"), "d", "n_words", "n_hit", "items")
    assert got == contaminated(rows, ITEMS)
    assert occurrences(none, items).count() == 0
    empty = with_counts(occurrences(docs, items.where("false")))
    assert empty.where("n_hit > 0").count() == 0 and empty.count() == len(ODD)


def test_tables_grow_with_the_patterns_and_find_the_same(monkeypatch):
    rng = random.Random(12)
    words = [f"{rng.randrange(10**6):x}" for _ in range(3000)]
    patterns = sorted({" " + " ".join(rng.sample(words, 10)) + " " for _ in range(4000)})
    patterns = [p.encode() for p in patterns]
    content = b" ".join(rng.choice([patterns[rng.randrange(4000)], " ".join(rng.sample(words, 12)).encode()]) for _ in range(400))
    table = WuManber(patterns)
    assert len(table._shift) > 1 << 18 and (table._shift == 0).mean() < 0.05
    found = sorted(table.search(content))
    places = {m.start() for m in re.finditer(b" ", content)}
    want = sorted((at, i) for at in places for i, p in enumerate(patterns) if content.startswith(p, at))
    assert found == want and len(found) > 100
    monkeypatch.setattr(wu_manber, "_TABLE_BITS", (4, 6))
    assert sorted(WuManber(patterns).search(content)) == want
