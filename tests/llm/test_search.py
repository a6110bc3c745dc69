"""Exact top-k, WARC bundles and license scans."""

import hashlib
import math
import random

import numpy as np
import zstandard
from pyspark.sql import functions as F

from couponloom.llm import license_scan, top_k
from couponloom.llm.license_scan import NOTICES, band_count, least_similarity, scan
from couponloom.llm.warc import Bundle, BundleReader, read_records, write_bundles
from tests.llm.conftest import ODD, by_id, text


def brute_top(rows, k):
    usable = [
        (i, [math.floor(64 * x) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q in sorted({i for i, _ in usable if i % 20 == 0}):
        own = min(v for i, v in usable if i == q)
        found = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in usable if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return out


def vectors(seed, n, width, scale=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 0.2) * scale for _ in range(width)]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, id string")


def test_top_k_equals_brute_force(spark):
    odd = [(20, None), (None, [1.0] * 40), (40, [float("nan")] * 40), (41, [None] * 40), (60, [0.1]), (61, []), (43, [math.inf] * 40)]
    rows = [r for r in vectors(1, 300, 40) if r[0] not in {20, 40, 41, 60, 61, 43}] + odd
    rows += [(5, rows[7][1]), (5, rows[7][1]), (80, rows[3][1]), (301, rows[0][1])]
    got = by_id(top_k.top_k(frame(spark, rows).repartition(4), F.col("vec_id") % 20 == 0, 7), "query_id", "rank", "vec_id", "score")
    assert got == brute_top(rows, 7)


def test_top_k_in_blocks_of_queries_and_with_few_candidates(spark):
    rows = vectors(2, 120, 33)
    got = top_k.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, 20, query_rows=2)
    assert by_id(got, "query_id", "rank", "vec_id", "score") == brute_top(rows, 20)
    few = rows[:5]
    got = top_k.top_k(frame(spark, few), F.col("vec_id") % 20 == 0, 20)
    assert by_id(got, "query_id", "rank", "vec_id", "score") == brute_top(few, 20)
    assert top_k.top_k(frame(spark, few).where("false"), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_top_k_of_ties_and_large_values(spark):
    same = [(i, [0.5, 0.25]) for i in range(50)]
    got = by_id(top_k.top_k(frame(spark, same), F.col("vec_id") % 20 == 0, 3), "query_id", "rank", "vec_id", "score")
    assert got == brute_top(same, 3)
    large = vectors(3, 60, 20, 1e6)
    got = by_id(top_k.top_k(frame(spark, large), F.col("vec_id") % 20 == 0, 5), "query_id", "rank", "vec_id", "score")
    assert got == brute_top(large, 5)


def test_pruning_leaves_out_candidates():
    rng = np.random.default_rng(0)
    near = rng.normal(0, 1, (200, 64)) * 2
    far = rng.normal(0, 1, (4000, 64)) * 30
    queries = np.floor(far[:50] * 10).astype(np.int64)
    among = top_k.Search(np.arange(50), queries, 5)
    best = among.start()
    among.scan(best, np.arange(50), queries)
    search = top_k.Search(np.arange(50), queries, 5, best.least)
    kind = np.float64
    q, c, s = search._pairs(
        search.vectors.astype(kind), search.rest, search.start().least,
        np.ascontiguousarray(np.floor(near).T.astype(kind)), top_k._rest(np.floor(near)),
    )
    assert len(q) < 50 * 200 / 4


# WARC


def test_bundle_frames_are_sought_alone(tmp_path):
    bundle, rng = Bundle(frame_bytes=1000), random.Random(0)
    records = [rng.randbytes(rng.randrange(1, 2500)) for _ in range(60)]
    places = [bundle.add(r) for r in records]
    content = bundle.content()
    (tmp_path / "b").write_bytes(content)
    import pyarrow as pa

    reader = BundleReader(pa.memory_map(str(tmp_path / "b")))
    order = list(range(60))
    rng.shuffle(order)
    assert all(reader.record(*places[i]) == records[i] for i in order)
    assert len({f for f, _, _ in places}) > 20
    plain = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
    assert plain == b"".join(records)


PAGES = [
    (1, "http://a/1", "x" * 150), (2, "http://a/2", "x" * 150), (3, None, "x" * 99), (4, "http://a/ 4\r\nX: y", "x" * 99),
    (5, "u", None), (6, "u", ""), (None, "u", "x" * 150), (7, "u", "é" * 60), (8, "u", "é" * 60), (2, "http://a/2", "x" * 150),
    (9, "u", "\r\n\r\nWARC/1.1\r\n" * 30), (0, "u", "y" * 200_000), (11, "u", "y" * 200_000), (11, "u", "z" * 100), (1, "u", "x" * 150),
]


def test_records_are_read_back(spark):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, payload int")
    index = write_bundles(pages, frame_bytes=5000, bundle_bytes=100_000)
    got = by_id(read_records(index), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = []
    for i, _, html in PAGES:
        payload = (html or "").encode()
        first = min((j for j, _, h in PAGES if j is not None and (h or "") == (html or "")), default=None)
        revisit = len(payload) >= 100 and i is not None and first < i
        want.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=lambda r: [(v is not None, v) for v in r])
    assert index.select("bundle").distinct().count() > 1
    payloads = {bytes(r["payload"]) for r in read_records(index).where("payload is not null").collect()}
    assert payloads == {(h or "").encode() for _, _, h in PAGES}
    empty = pages.where("false")
    assert read_records(write_bundles(empty)).count() == 0


# Licenses


def fold(t):
    import re

    return re.findall("[a-z0-9]+", (t or "").lower())


def brute_scan(rows, notices, least=0.8):
    out = {}
    for name, notice in notices.items():
        w = fold(notice)
        if not w:
            continue
        k = min(5, len(w))
        wanted = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
        size, kinds = len(wanted), set(wanted)
        for i, t in rows:
            d = fold(t)
            held = [tuple(d[j : j + k]) for j in range(len(d) - k + 1)]
            shares = [len(kinds & set(held[first : first + 2 * size])) / len(kinds) for first in range(len(held))]
            if max(shares, default=0) < least:
                continue
            best = (-max(shares), min(j for j, s in enumerate(shares) if s == max(shares) and held[j] in kinds))
            out[i, name] = min(best, out.get((i, name), best))
    return sorted(((i, n, -s, f) for (i, n), (s, f) in out.items()), key=lambda r: [(v is not None, v) for v in r])


def test_scan_equals_brute_force(documents, none):
    rng = random.Random(6)
    texts = [t for _, t in ODD]
    for name in sorted(NOTICES):
        words = NOTICES[name].split()
        worn = [w for k, w in enumerate(words) if k % 25 != 20]
        texts += [text(3, 40) + " " + NOTICES[name].upper() + "\n" + text(4, 7), " ".join(worn), NOTICES[name] * 3,
                  text(5, rng.randrange(30)) + " " + " ".join(words[: len(words) // 2])]
    rows = list(enumerate(texts))
    got = by_id(scan(documents(rows), NOTICES), "doc_id", "license", "containment", "first_word")
    assert got == brute_scan(rows, NOTICES)
    assert {n for _, n, _, _ in got} == set(NOTICES)
    assert scan(none, NOTICES).count() == 0
    assert scan(documents(rows), {}).count() == 0
    assert scan(documents(rows), {"blank": " .. "}).count() == 0


def test_notice_with_words_put_in_is_found_wherever_it_stands(documents):
    words, more = NOTICES["gpl-3.0"].split(), text(8, 20)
    texts = [" ".join([text(9, before), *words[:20], more, *words[20:]]) for before in range(40)]
    texts += [" ".join([text(9, 7), *words[:at], more, *words[at:], text(4, 50)]) for at in range(1, len(words))]
    rows = list(enumerate(texts))
    got = by_id(scan(documents(rows), NOTICES), "doc_id", "license", "containment", "first_word")
    assert got == brute_scan(rows, NOTICES)
    assert [i for i, name, *_ in got if name == "gpl-3.0"] == list(range(len(rows)))


def test_scan_runs_no_python(documents):
    plan = scan(documents([(1, "a")]), NOTICES)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_bands_guarantee_the_collision():
    similarity = least_similarity(0.8)
    for rows in (1, 2):
        bands = band_count(similarity, rows, 1e-6)
        assert (1 - similarity**rows) ** bands <= 1e-6 < (1 - similarity**rows) ** (bands - 1)
    assert license_scan.SHINGLE == 5
