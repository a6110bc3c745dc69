"""Nearest neighbours by blocks against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from couponloom.operators import nearest as module
from couponloom.operators.nearest import asking, blocks_of, nearest


def frame(spark, ids, vectors):
    rows = [(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows, "product int, embedding array<double>").repartition(3)


def brute_force(ids, vectors, n):
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)
    out = []
    for i, x in zip(ids, unit, strict=True):
        near = sorted((-round(float(x @ y), 9) + 0.0, int(j)) for j, y in zip(ids, unit, strict=True) if j != i)
        out += [(int(i), r, j, -s + 0.0) for r, (s, j) in enumerate(near[:n], 1)]
    return sorted(out)


def same(got, want):
    """Equal neighbours and cosines; rounding may differ in the last digit."""
    rows = sorted((r["product"], r["rank"], r["similar"], r["similarity"]) for r in got.collect())
    assert [r[:3] for r in rows] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in rows], [r[3] for r in want], atol=2e-9)


def planted(groups, members, width, noise, seed=0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, width))
    vectors = np.repeat(middles, members, axis=0) + noise * rng.normal(size=(groups * members, width))
    return rng.permutation(10 * len(vectors))[: len(vectors)], vectors * rng.uniform(0.1, 9, (len(vectors), 1))


def test_planted_groups_skip_most_blocks(spark):
    ids, vectors = planted(24, 50, 16, 0.02)
    df = frame(spark, ids, vectors)
    same(nearest(df, 10, block_rows=40), brute_force(ids, vectors, 10))
    inside = blocks_of(df, 10, 40)
    blocks = inside.select("block").distinct().count()
    pairs = asking(inside, 10).agg(F.sum(F.size("blocks"))).first()[0]
    assert blocks > 40 and pairs < 0.12 * blocks * len(ids)


@pytest.mark.parametrize("block_rows,asking_rows", [(2048, 16_384), (7, 16_384), (30, 11)])
def test_scattered_zero_and_equal_vectors(spark, monkeypatch, block_rows, asking_rows):
    monkeypatch.setattr(module, "ASKING_ROWS", asking_rows)
    ids, vectors = planted(3, 30, 5, 1.5, seed=1)
    vectors[:4] = 0
    vectors[10:20] = vectors[9]
    vectors[20] = -vectors[9]
    same(nearest(frame(spark, ids, vectors), 6, block_rows), brute_force(ids, vectors, 6))


def test_few_products(spark):
    ids, vectors = np.array([5, 2, 9]), np.array([[1.0, 0.0], [0.0, 2.0], [1.0, 1.0]])
    same(nearest(frame(spark, ids, vectors), 10), brute_force(ids, vectors, 10))
    assert nearest(frame(spark, ids[:1], vectors[:1]), 10).count() == 0
    assert nearest(frame(spark, [], []), 10).count() == 0
