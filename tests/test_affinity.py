"""Baskets, co-occurrence, clusters and embeddings."""

import random
from collections import Counter

import pytest

from couponloom.operators import affinity
from couponloom.operators import embeddings as embedding_module
from couponloom.operators.affinity import (
    basket_lists,
    clip_diagonal,
    cluster_positions,
    context_lists,
    cooccurrence,
    cooccurrence_blocks,
    cooccurrence_table,
    max_basket_size,
    member_clusters,
    order_by_cluster,
    with_basket_id,
)
from couponloom.operators.embeddings import (
    all_similar_products,
    embeddings,
    load_or_train,
    projection,
    similar_products,
)

SCHEMA = "week int, shopper int, product int"


def some_baskets(seed=0, members=12, hot=True):
    """Random baskets with repeated products; one basket holds a third of all rows."""
    rng = random.Random(seed)
    rows = [(rng.randrange(3), rng.randrange(6), rng.randrange(members)) for _ in range(200)]
    return rows + [(1, 1, rng.randrange(members)) for _ in range(100 if hot else 0)]


def brute_force(rows):
    groups = {}
    for week, shopper, product in rows:
        groups.setdefault((week, shopper), Counter())[product] += 1
    want = Counter()
    for counts in groups.values():
        for i, n in counts.items():
            for j, m in counts.items():
                want[i, j] += n * m
    return dict(want)


@pytest.mark.parametrize("tile,held", [(2048, 1 << 21), (4, 40), (4, 1)])
def test_cooccurrence_equals_brute_force(spark, monkeypatch, tile, held):
    monkeypatch.setattr(affinity, "TILE", tile)
    monkeypatch.setattr(affinity, "PAIRS_HELD", held)
    rows = some_baskets()
    got = cooccurrence(spark.createDataFrame(rows, SCHEMA), "product", 12)
    edges = {(r.member_1, r.member_2): r.n for r in got.collect()}
    assert edges == brute_force(rows)
    assert all(edges[j, i] == n for (i, j), n in edges.items())


def test_members_without_id_are_left_out(spark):
    df = spark.createDataFrame([(0, 0, 1), (0, 0, None)], SCHEMA)
    assert [tuple(r) for r in cooccurrence(df, "product", 5).collect()] == [(1, 1, 1)]


def test_sparse_baskets_of_a_wide_catalogue(spark, monkeypatch):
    monkeypatch.setattr(affinity, "TILE", 16)
    rng = random.Random(1)
    rows = [(0, s, rng.randrange(20_000)) for s in range(300) for _ in range(6)]
    rows += [(1, 0, p) for p in rng.sample(range(20_000), 100)] + [(1, 1, 25_000), (1, 1, 3)]
    edges = cooccurrence(spark.createDataFrame(rows, SCHEMA), "product", 100)
    assert {(r.member_1, r.member_2): r.n for r in edges.collect()} == brute_force(rows)


def test_table_and_clipped_diagonal(spark):
    edges = spark.createDataFrame([(0, 0, 9), (0, 1, 4), (1, 0, 4), (1, 1, 7)], "member_1 int, member_2 int, n long")
    table = {r.member_1: (r.with_0, r.with_1, r.with_2) for r in cooccurrence_table(edges, 3).collect()}
    assert table == {0: (9, 4, 0), 1: (4, 7, 0)}
    clipped = {(r.member_1, r.member_2): (r.n, r.distance) for r in clip_diagonal(edges).collect()}
    assert clipped == {(0, 0): (2.0, -1.0), (1, 1): (2.0, -1.0), (0, 1): (4.0, -3.0), (1, 0): (4.0, -3.0)}
    with pytest.raises(ValueError):
        cooccurrence_table(edges, 100_000)


def test_clusters_separate_planted_groups_and_order_the_edges(spark):
    rows = [(w, s, 3 * (s % 3) + k) for w in range(3) for s in range(9) for k in range(3)]
    edges = cooccurrence(spark.createDataFrame(rows, SCHEMA), "product", 9)
    clusters = member_clusters(edges)
    label = {r.member: r.cluster for r in clusters.collect()}
    assert len(set(label.values())) == 3
    assert all(label[3 * g] == label[3 * g + k] for g in range(3) for k in range(3))
    ordered = order_by_cluster(edges, clusters).collect()
    assert len(ordered) == 27
    assert [(r.position_1, r.position_2) for r in ordered] == sorted((r.position_1, r.position_2) for r in ordered)
    assert all(r.cluster_1 == r.cluster_2 for r in ordered)


def test_basket_ids_are_dense_and_ordered_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(affinity, "SHOPPERS_PER_BUCKET", 2)
    rows = some_baskets()
    got = with_basket_id(spark.createDataFrame(rows, SCHEMA)).collect()
    want = {key: i for i, key in enumerate(sorted({(w, s) for w, s, _ in rows}))}
    assert len(got) == len(rows)
    assert all(r.basket == want[r.week, r.shopper] for r in got)


def test_basket_lists_keep_every_item(spark, monkeypatch):
    rows = some_baskets()
    df = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for week, shopper, product in rows:
        want.setdefault((week, shopper), []).append(product)
    whole = {(r.week, r.shopper): r["items"] for r in basket_lists(df).collect()}
    assert whole == {k: [str(p) for p in sorted(v)] for k, v in want.items()}
    assert max_basket_size(df).first()[0] == max(map(len, want.values()))
    monkeypatch.setattr(affinity, "PRODUCTS_PER_LIST", 5)
    monkeypatch.setattr(affinity, "COPIES_PER_LIST", 3)
    parts = basket_lists(df).collect()
    assert max(len(r["items"]) for r in parts) <= 15
    assert len({(r.week, r.shopper, r.part) for r in parts}) == len(parts)
    again = {}
    for r in parts:
        again.setdefault((r.week, r.shopper), []).extend(map(int, r["items"]))
    assert {k: sorted(v) for k, v in again.items()} == {k: sorted(v) for k, v in want.items()}


def test_a_basket_is_one_list_whatever_its_products(spark, monkeypatch):
    df = spark.createDataFrame([(0, 0, 9000), (0, 0, 1), (0, 0, 5000), (0, 0, 1)], SCHEMA)
    assert [(r.part, r["items"]) for r in basket_lists(df).collect()] == [(0, ["1", "1", "5000", "9000"])]
    monkeypatch.setattr(affinity, "PRODUCTS_PER_LIST", 2)
    rows = [(0, 0, p) for p in range(7)] + [(0, 1, 8), (0, 1, 9)]
    contexts = [r["items"] for r in context_lists(spark.createDataFrame(rows, SCHEMA)).collect()]
    met = {frozenset((a, b)) for c in contexts for a in c for b in c if a != b}
    assert met == {frozenset(map(str, (a, b))) for a in range(7) for b in range(a)} | {frozenset(("8", "9"))}


def planted(groups, size, seed, hub=False, stray=0.0):
    """Baskets of one group each; a hub is in all of them, strays come from anywhere."""
    rng, rows = random.Random(seed), []
    for week in range(6):
        for shopper in range(20 * groups):
            group = shopper % groups
            rows += [(week, shopper, group * size + p) for p in rng.sample(range(size), size // 2)]
            rows += [(week, shopper, groups * size)] if hub else []
            rows += [(week, shopper, rng.randrange(groups * size))] if rng.random() < stray else []
    return rows


@pytest.mark.parametrize("hub,stray", [(False, 0.0), (True, 0.0), (True, 0.3)])
def test_clusters_find_groups_around_a_hub(spark, hub, stray):
    rows = planted(3, 12, 5, hub, stray) + [(9, 9, 500)]
    edges = cooccurrence(spark.createDataFrame(rows, SCHEMA), "product")
    label = {r.member: r.cluster for r in member_clusters(edges).collect()}
    assert set(label) == {p for _, _, p in rows}
    assert [{label[12 * g + p] for p in range(12)} for g in range(3)] == [{0}, {1}, {2}]
    assert label[500] == 3  # meets no other member
    assert label == {r.member: r.cluster for r in member_clusters(edges.repartition(3)).collect()}


def test_clusters_of_thousands_of_members(spark):
    rows = [(w, s, 1000 * (s % 3) + k) for w in range(2) for s in range(60) for k in range(s, s + 700, 7)]
    edges = cooccurrence(spark.createDataFrame(rows, SCHEMA), "product").cache()
    clusters = member_clusters(edges)
    assert clusters.count() == len({p for _, _, p in rows}) > 1_000
    assert {r.cluster for r in clusters.select("cluster").distinct().collect()} == {0, 1, 2}


def test_clusters_of_members_that_never_meet(spark):
    edges = cooccurrence(spark.createDataFrame([(0, 0, 1), (0, 1, 2)], SCHEMA), "product")
    assert sorted(tuple(r) for r in member_clusters(edges).collect()) == [(1, 3), (2, 3)]
    assert member_clusters(edges.limit(0)).count() == 0


def test_positions_are_those_of_a_sort(spark, monkeypatch):
    monkeypatch.setattr(affinity, "MEMBERS_PER_BUCKET", 7)
    rng = random.Random(8)
    label = {m: rng.randrange(3) for m in rng.sample(range(200), 90)}
    clusters = spark.createDataFrame(list(label.items()), "member int, cluster int")
    got = {r.member: r.position for r in cluster_positions(clusters).collect()}
    want = sorted(label, key=lambda m: (label[m], m))
    assert got == {m: i for i, m in enumerate(want)}
    members = sorted(label)
    edges = spark.createDataFrame([(a, b, 1) for a in members for b in rng.sample(members, 5)], "member_1 int, member_2 int, n int")
    ordered = order_by_cluster(edges, clusters).collect()
    assert [(r.position_1, r.position_2) for r in ordered] == sorted((want.index(r.member_1), want.index(r.member_2)) for r in ordered)
    assert len(ordered) == edges.count()


def test_table_in_blocks_of_columns(spark):
    edges = spark.createDataFrame([(0, 0, 9), (0, 4, 4), (4, 0, 4), (4, 4, 7)], "member_1 int, member_2 int, n long")
    got = sorted((r.member_1, r["first"], r.counts) for r in cooccurrence_blocks(edges, 5, width=2).collect())
    assert got == [
        (0, 0, [9, 0]), (0, 2, [0, 0]), (0, 4, [4]), (4, 0, [4, 0]), (4, 2, [0, 0]), (4, 4, [7]),
    ]
    wide = cooccurrence_blocks(edges, 100_000)
    assert wide.count() == 2 * 100 and wide.agg({"member_1": "max"}).first()[0] == 4


def test_embeddings_find_products_bought_together(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for week in range(40):
        for shopper in range(10):
            group = shopper % 2
            rows += [(week, shopper, 10 * group + p) for p in rng.sample(range(10), 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = load_or_train(df, f"{tmp_path}/model", dimensions=16, partitions=1)
    vectors = embeddings(model).collect()
    assert {r["product"] for r in vectors} == set(range(20))
    assert {len(r.embedding) for r in vectors} == {16}
    near = [r["product"] for r in similar_products(model, 3, 5).collect()]
    assert len(near) == 5 and sum(p < 10 for p in near) >= 4
    every = all_similar_products(model, 5).collect()
    assert len(every) == 20 * 5 and all(r["product"] != r.similar for r in every)
    assert [r.similar for r in sorted(every, key=lambda r: r["rank"]) if r["product"] == 3] == near
    assert sorted(all_similar_products(model, 5, block_rows=3).collect()) == sorted(every)
    points = projection(model)
    assert points.columns == ["product", "x", "y"] and points.count() == 20
    loaded = load_or_train(df.repartition(5), f"{tmp_path}/model", dimensions=16, partitions=1)
    first, second = (
        {r["product"]: r.embedding for r in embeddings(m).collect()} for m in (model, loaded)
    )
    assert first == second


def test_other_baskets_or_parameters_never_get_the_old_model(spark, tmp_path, monkeypatch):
    trained, train = [], embedding_module.train_embeddings
    monkeypatch.setattr(embedding_module, "train_embeddings", lambda b, **k: trained.append(k) or train(b, **k))
    df = spark.createDataFrame([(w, s, p) for w in range(3) for s in range(4) for p in range(3)], SCHEMA)

    def load(baskets, **kwargs):
        return {r["product"] for r in embeddings(load_or_train(baskets, str(tmp_path), partitions=1, **kwargs)).collect()}

    assert load(df, dimensions=4) == load(df, dimensions=4) == {0, 1, 2}
    assert len(trained) == 1
    assert load(df.filter("product < 2"), dimensions=4) == {0, 1}
    load(df, dimensions=5)
    assert len(trained) == 3
    # A model without its marker was left half written.
    for marker in tmp_path.glob("stages/embeddings-*/_SUCCESS"):
        marker.unlink()
    assert load(df, dimensions=4) == {0, 1, 2}
    assert len(trained) == 4


def test_partitions_of_the_training_follow_the_baskets(spark, tmp_path, monkeypatch):
    used, train = [], embedding_module.train_embeddings
    monkeypatch.setattr(embedding_module, "train_embeddings", lambda b, **k: used.append(k["partitions"]) or train(b, **k))
    monkeypatch.setattr(embedding_module, "ROWS_PER_PARTITION", 4)
    df = spark.createDataFrame([(w, s, p) for w in range(3) for s in range(4) for p in range(3)], SCHEMA)
    load_or_train(df, str(tmp_path), dimensions=4)
    monkeypatch.setattr(embedding_module, "ROWS_PER_PARTITION", 36)
    load_or_train(df, str(tmp_path), dimensions=4)
    assert used == [9, embedding_module.PARTITIONS]
