"""Ranked search, url filters and hard negatives against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from couponloom.llm import hard_negatives, shared_search, url_filter
from couponloom.llm.shared_search import search, shared_sets, term_counts
from couponloom.llm.url_filter import ALLOW, BLOCK, Cascade, Level, judge
from tests.llm.conftest import ODD, by_id, text

# Ranked search


def terms(t):
    capitals = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(capitals))


def brute_search(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_all, all_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, t in items:
        asked, found = Counter(terms(t)), []
        for i, c in counted:
            m = 75 + 25 * c.total() * n_all // all_terms
            score = sum(
                r * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 12 * m))
                for x, r in asked.items() if c[x]
            )
            if i is not None and score > 0:
                found.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=lambda r: [(v is not None, v) for v in r])


ITEMS = [
    (1, text(1, 40)), (2, text(1, 40) + " " + text(9, 20)), (3, None), (4, ""), (5, "ZZZ unknown"), (6, "One, ONE one!"),
    (None, "w1x w2x"), (7, text(5, 300, 5000)), (8, text(1, 40)), (9, "ünï CÖDÉ Ünï"),
]


def asked(spark, items):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, score int, doc_id int")


def test_search_equals_brute_force(spark, documents, odd, none):
    got = by_id(search(odd, asked(spark, ITEMS), 7), "item_id", "rank", "doc_id", "score")
    assert got == brute_search(ODD, ITEMS, 7)
    rows = [(i, text(i, 5 + i % 90, 200)) for i in range(300)]
    many = [(i, text(i * 7, 30, 200)) for i in range(60)]
    got = by_id(search(documents(rows).repartition(5), asked(spark, many)), "item_id", "rank", "doc_id", "score")
    assert got == brute_search(rows, many, 20)
    assert search(none, asked(spark, ITEMS)).count() == 0
    assert search(odd, asked(spark, ITEMS).where("false")).count() == 0
    assert search(odd, asked(spark, [(1, None), (2, " ,")])).count() == 0


def test_search_in_blocks_of_items_and_groups(spark, documents, monkeypatch):
    monkeypatch.setattr(shared_search, "ITEM_BYTES", 2000)
    monkeypatch.setattr(shared_search, "GROUP", 3)
    monkeypatch.setattr(shared_search, "SPAN", 8)
    rows = [(i, text(i, 5 + i % 90, 200)) for i in range(80)]
    many = [(i, text(i * 7, 30, 200)) for i in range(30)] + [(5, "a"), (40, "W1X")]
    chosen = {}
    for i, t in many:
        chosen[i] = min(t, chosen.get(i, t))
    got = by_id(search(documents(rows), asked(spark, many)), "item_id", "rank", "doc_id", "score")
    assert got == brute_search(rows, sorted(chosen.items()), 20)


def test_search_of_ties_and_copies(spark, documents):
    rows = [(i, "alpha beta") for i in range(40)] + [(3, "alpha beta"), (50, "gamma")]
    got = by_id(search(documents(rows), asked(spark, [(1, "alpha")])), "item_id", "rank", "doc_id", "score")
    assert got == brute_search(rows, [(1, "alpha")], 20)


def test_long_texts_are_counted_piece_by_piece(monkeypatch):
    monkeypatch.setattr(shared_search, "_PIECE_BYTES", 7)
    content = "Some-words  and a veryveryveryverylongword, some more. " * 20
    assert term_counts(content.encode()) == Counter(x.encode() for x in terms(content))


def test_shared_sets_keep_every_item_and_save_sums():
    rng = random.Random(3)
    for _ in range(20):
        items = [sorted(rng.sample(range(30), rng.randrange(1, 25))) for _ in range(rng.randrange(1, 12))]
        nodes, rests = shared_sets([list(i) for i in items], 30)
        members = {x: {x} for x in range(30)}
        for i, (a, b) in enumerate(nodes, 30):
            assert not members[a] & members[b]
            members[i] = members[a] | members[b]
        for item, rest in zip(items, rests, strict=True):
            assert sorted(x for r in rest for x in members[r]) == item
    common = list(range(20))
    nodes, rests = shared_sets([[*common, 20 + i] for i in range(10)], 30)
    assert len(nodes) == 19 and all(len(r) == 2 for r in rests)


# Url filters

URLS = [
    "http://a.net/x", "https://example.net/en/1", "http://www.EXAMPLE.net/en/", "http://example.net/en", "http://example.com/de/q?x#y",
    "http://m.example.com/de", "ftp://x.org/fr/a#b", "org/fr/", None, "", "http://", "http:///de/", "http://org?/fr/", "x://net/", "x://net",
    "http://anet/", "http://.net/", "http://net./", "a://b://net/", "http://a.net:80/", "http://example.org/FR/", "http://Ü.org/fr/é",
    "http://" + "a." * 50_000 + "net/" + "p" * 100_000, "http://example.com\n.net/de/", "http://a.net/x",
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest).group()
    return re.sub("[A-Z]", lambda x: x.group().lower(), host), re.match("[^?#]*", rest[len(host) :]).group()


def brute_judge(urls, rules):
    out = []
    for i, url in urls:
        host, path = split(url)
        fits = [
            (len((h + p).encode()), len(h.encode()), v == BLOCK, h + p) for h, p, v in rules
            if h and (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        best = max(fits, default=None)
        out.append((i, host, path, best and best[3], ALLOW if best is None or not best[2] else BLOCK))
    return sorted(out, key=lambda r: [(v is not None, v) for v in r])


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", 1) for i, u in urls], "page_id long, url string, host string, row int")


def rules_of(spark, rules):
    return spark.createDataFrame(rules, "host string, path string, verdict string")


OUT = ("row.page_id", "host", "path", "rule", "verdict")


def test_judge_equals_brute_force(spark):
    urls = list(enumerate(URLS)) + [(None, "http://a.net/"), (3, URLS[3])]
    got = by_id(judge(pages(spark, urls), rules_of(spark, url_filter.RULES)).select(*OUT), "page_id", "host", "path", "rule", "verdict")
    assert got == brute_judge(urls, url_filter.RULES)


def many_rules(rng, n):
    hosts = [".".join(rng.choice(["a", "b", "c", "www", "x"]) for _ in range(rng.randrange(1, 4))) + rng.choice([".net", ".org"]) for _ in range(n)]
    return [(h, rng.choice(["", "/", "/a", "/a/", "/a/b"]), rng.choice([BLOCK, ALLOW])) for h in hosts]


def test_many_rules_in_one_and_in_several_cascades(spark):
    rng = random.Random(4)
    rules = many_rules(rng, 300)
    urls = [
        (i, f"http://{h}{rng.choice(['', '/', '/a', '/a/b/c', '/b', '/a/c'])}{rng.choice(['', '?q', '#f'])}")
        for i, (h, _, _) in enumerate(many_rules(rng, 1500))
    ]
    want = brute_judge(urls, rules)
    assert len({r[3] for r in want}) > 50
    odd = [(None, "/", BLOCK), ("", "/", BLOCK), ("a/b", "/", BLOCK), ("a.net", "x", BLOCK), ("a.net", None, BLOCK), ("b.net", "/?", None)]
    frame, listed = pages(spark, urls).repartition(3), rules_of(spark, rules + rules[:9] + odd)
    for bits in (1 << 28, 700):
        got = judge(frame, listed, cascade_bits=bits).select(*OUT)
        assert by_id(got, "page_id", "host", "path", "rule", "verdict") == want


def test_judge_of_nothing(spark):
    rules = rules_of(spark, url_filter.RULES)
    assert judge(pages(spark, []), rules).count() == 0
    got = judge(pages(spark, [(1, "http://a.net/")]), rules.where("false"), default=BLOCK).collect()
    assert [(r["rule"], r["verdict"]) for r in got] == [(None, BLOCK)]


def test_cascade_is_exact_on_its_universe(spark):
    rng = random.Random(5)
    universe = [f"k{i}".encode() for i in range(20_000)]
    listed = rng.sample(universe, 400)
    frame = spark.createDataFrame([(bytearray(k), True) for k in listed], "key binary, listed boolean")
    everything = spark.createDataFrame([(bytearray(k), False) for k in universe], "key binary, listed boolean")

    def passing(sent):
        from functools import partial

        return everything.mapInArrow(partial(url_filter._survivors, cascade=sent), "key binary, listed boolean")

    cascade = url_filter.build(frame, passing, len(listed), len(universe))
    assert set(np.array(universe)[cascade.listed(universe)].tolist()) == set(listed)
    assert len(cascade.levels) > 3
    # The first level lets about as many unlisted keys through as there are listed ones.
    first = cascade.levels[0].held(universe).sum()
    assert len(listed) < first < 2.5 * len(listed)
    assert sum(level.bits for level in cascade.levels) < 16 * len(listed)
    assert not Cascade().listed([b"x"]).any() and Level.sized(0, 1, 0).bits == 64


# Hard negatives


def brute_mine(rows, positives=5, negatives=5):
    usable = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))

    def score(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    out = set()
    for anchor in sorted({i for i, _, _ in usable if i % 100 == 0}):
        vector, label = min((v, lab) for i, lab, v in usable if i == anchor)
        others = sorted((-score(vector, v), i, lab == label) for i, lab, v in usable if i != anchor)
        for s, p, _ in [o for o in others if o[2]][:positives]:
            found = [(-t, i) for t, i, same in others if not same and -80 * s <= -100 * t <= -100 * s][:negatives]
            out |= {(anchor, p, r, i, -s, t) for r, (t, i) in enumerate(found, 1)}
    return sorted(out)


def embedded(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows], "vec_id long, embedding array<double>, label int, id string")


MINED = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(spark, rows, **kwargs):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return by_id(hard_negatives.mine(embedded(spark, rows).repartition(3), F.col("vec_id") % 100 == 0, moved, **kwargs), *MINED)


def vectors(seed, n, width, scale=1.0, labels=4):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0.1, 0.2) * scale for _ in range(width)], rng.randrange(labels)) for i in range(n)]


def test_mine_equals_brute_force(spark):
    rows = vectors(1, 900, 24)
    odd = [
        (200, None, 1), (None, [1.0] * 24, 1), (300, [math.nan] * 24, 1), (901, [None] * 24, 2), (902, [1.0] * 24, None),
        (903, [0.5], 1), (904, [], 2), (905, [math.inf] * 24, 0), (906, [0.1] * 30, 3), (400, rows[7][1], 3), (11, rows[11][1], rows[11][2]),
    ]
    rows = [r for r in rows if r[0] not in {200, 300}] + odd
    want = brute_mine(rows)
    assert len(want) > 100
    assert mined(spark, rows) == want
    assert mined(spark, rows, anchor_rows=2) == want
    assert mined(spark, []) == []


def test_mine_of_ties_few_rows_and_wide_scores(spark):
    same = [(i, [0.5, 0.25], i % 3) for i in range(250)]
    assert mined(spark, same) == brute_mine(same)
    few = vectors(2, 4, 5, labels=2)
    assert mined(spark, few) == brute_mine(few)
    wide = vectors(3, 260, 12, 1e4)
    assert mined(spark, wide) == brute_mine(wide)
    assert mined(spark, [(i, [], i % 2) for i in range(101)]) == brute_mine([(i, [], i % 2) for i in range(101)])


def test_packed_products_are_exact():
    rng = np.random.default_rng(0)
    for top, narrow in ((300, True), (1 << 20, False), (1 << 28, False)):
        candidates, anchors = (rng.integers(-top, top, (n, 40)) for n in (131, 17))
        packed = hard_negatives.Packed(candidates, int(anchors.min()), int(anchors.max()))
        assert packed.narrow == narrow and packed.fields > 1
        assert (packed.scores(anchors) == anchors @ candidates.T).all()
    edge = np.array([[2**63 - 1, -(2**63)], [0, 1]], dtype=np.int64)
    packed = hard_negatives.Packed(edge, -5, 5)
    assert packed.scores(np.array([[5, -5], [1, 0]])).tolist() == [[2**63 - 1, -5], [2**63 - 1, 0]]
