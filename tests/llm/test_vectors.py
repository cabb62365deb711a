"""Multiprobe search and cover-tree near-dedup against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from hedgeline.llm import cover_tree, multiprobe, queries
from hedgeline.llm.common import Scratch, table

from . import brute

NAN, INF = float("nan"), float("inf")
ODD = [(900, None, 1), (901, [0.0] * 8, 1), (902, [1.0, None] * 4, 1), (903, [NAN] * 8, 1), (904, [INF] * 8, 1), (905, [], 1), (906, [1.0] * 8, None)]
SCHEMA = "vec_id bigint, embedding array<double>, label int"


def nearest(rows: list[tuple], k: int, every: int) -> dict[int, list[tuple[int, float]]]:
    """All of the k nearest, by brute force."""
    good = [(i, np.array(v, dtype=float)) for i, v, *_ in rows if brute.usable(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    out = {}
    for i, v in good:
        if i % every == 0:
            scores = (x * v).sum(axis=1)
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    made = [(i, (centres[i % 12] * rng.uniform(0.5, 2) + rng.normal(0, 0.25, 8)).tolist(), i % 3) for i in range(400)]
    made += [(500 + i, made[i][1], made[i][2]) for i in range(20)]  # equal vectors
    made += [(600 + i, (3 * np.array(made[5][1])).tolist(), made[5][2]) for i in range(40)]  # a large group
    return made + ODD


def test_neighbours_of_a_small_table_are_exact(spark, rows):
    """At a success of 1 every query visits all buckets."""
    df = spark.createDataFrame([(*r, "x") for r in rows[:350] + ODD], SCHEMA + ", rank string").drop("label")
    found: dict = {}
    for r in multiprobe.nearest(df, Scratch(spark, "t"), index=multiprobe.Index(success=1.0)).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    expected = nearest([r for r in rows[:350] if len(r[1]) == 8], 20, 20)
    assert found.keys() == expected.keys()
    for q, near in expected.items():
        assert [i for i, _ in found[q]] == [i for i, _ in near]
        assert np.allclose([s for _, s in found[q]], [s for _, s in near], rtol=1e-12)


def test_neighbours_among_repeated_rows(spark, rows):
    """Copies of a row, and other vectors of one vec_id, are one candidate and crowd no other out."""
    some = [r for r in rows[:350] if brute.usable(r[1])]
    often = some * 3 + some[1:13] * 30 + [(i, (np.array(v) * (1 + n / 1000)).tolist(), label) for i, v, label in some[20:50] for n in range(1, 25)]
    found: dict = {}
    for r in multiprobe.nearest(spark.createDataFrame(often, SCHEMA).repartition(4), Scratch(spark, "t"), index=multiprobe.Index(success=1.0)).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids, x = np.array([i for i, *_ in often]), np.array([v for _, v, _ in often])
    assert found.keys() == {i for i, *_ in some if i % 20 == 0}
    for q, near in found.items():
        best: dict = {}
        scores = (x[ids == q] @ x.T).max(axis=0)
        for i, s in zip(ids.tolist(), scores.tolist(), strict=True):
            if i != q:
                best[i] = max(s, best.get(i, s))
        expected = sorted(best.values(), reverse=True)[:20]
        assert [rank for rank, _, _ in near] == list(range(1, 21)) and len({i for _, i, _ in near}) == 20
        assert np.allclose([s for _, _, s in near], expected, rtol=1e-12)
        assert all(s == pytest.approx(best[i], rel=1e-12) for _, i, s in near)


def test_neighbours_recall(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, folder, "embeddings").collect()]
    by_id = dict(rows)
    found: dict = {}
    for r in queries.op6_multiprobe_neighbours(spark, folder).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    expected = nearest(rows, 20, 20)
    hits = total = 0
    for q, near in expected.items():
        mine = sorted(found[q])
        assert [rank for rank, _, _ in mine] == list(range(1, len(mine) + 1))
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        for _, i, s in mine:
            assert s == pytest.approx(float(np.dot(np.array(by_id[q], dtype=float), np.array(by_id[i], dtype=float))), rel=1e-12)
        hits += len({i for i, _ in near} & {i for _, i, _ in mine})
        total += len(near)
    assert hits / total >= 0.9


def test_recall_and_what_is_visited_of_many_vectors():
    """Spread over all directions and in loose groups: recall where far from all vectors are visited."""
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=(20_000, 64)), rng.normal(size=(100, 64))[rng.integers(0, 100, 5_000)] + rng.normal(0, 0.5, (5_000, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = multiprobe.Index()
    tables = multiprobe.Tables(index, x[rng.permutation(len(x))[: index.fit_rows]], len(x), 1.0, 20)
    queries = x[::250]
    buckets, chance = tables.buckets(x), tables.slot_success(queries)
    visited = np.zeros((len(queries), len(x)), dtype=bool)
    for table in range(index.tables):
        probes, n = tables.probes(chance[table])
        for i in range(len(queries)):
            visited[i] |= np.isin(buckets[table], probes[i, : n[i]])
    scores = queries @ x.T
    scores[np.arange(len(queries)), np.arange(0, len(x), 250)] = -2
    near = np.argpartition(-scores, 20, axis=1)[:, :20]
    assert np.take_along_axis(visited, near, axis=1).mean() >= 0.9
    assert visited.mean() < 0.5


def test_probes_come_in_the_order_of_success():
    rng = np.random.default_rng(13)
    x = rng.normal(size=(4000, 16))
    tables = multiprobe.Tables(multiprobe.Index(rows=1), x, len(x), float(np.linalg.norm(x, axis=1).max()), 20)
    log_p = tables.slot_success(x[:5])[2]
    found, n = tables.probes(log_p)
    every = np.arange(multiprobe.SLOTS**tables.projections)
    slots = every[:, None] >> multiprobe.SLOT_BITS * np.arange(tables.projections) & multiprobe.SLOTS - 1
    need = 1 - (1 - tables.index.success) ** (1 / tables.index.tables)
    for i in range(5):
        p = np.exp(log_p[i][np.arange(tables.projections), slots].sum(axis=1))
        order = np.argsort(-p, kind="stable")
        assert np.allclose(p[found[i, : n[i]]], p[order[: n[i]]]) and len(set(found[i].tolist())) == found.shape[1]
        assert n[i] == np.searchsorted(np.cumsum(p[order]), need) + 1


def test_neighbours_of_nothing(spark):
    assert multiprobe.nearest(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).count() == 0
    assert multiprobe.nearest(spark.createDataFrame(ODD[:-1], SCHEMA), Scratch(spark, "t")).count() == 0
    assert multiprobe.nearest(spark.createDataFrame([(20, [1.0, 2.0], 1)], SCHEMA), Scratch(spark, "t")).count() == 0


def test_cover_tree(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", n_links string").repartition(4)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cover_tree.near_duplicates(df, Scratch(spark, "t")).collect()}
    assert found == brute.vector_links(rows)
    assert max(n for n, _ in found.values()) > 30


def test_cover_tree_on_the_test_table(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table(spark, folder, "embeddings").collect()]
    out = queries.op8_cover_tree_near_dedup(spark, folder).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == brute.vector_links(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


def test_cover_tree_of_nothing_and_without_ids(spark):
    assert cover_tree.near_duplicates(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).count() == 0
    out = cover_tree.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1)], SCHEMA), Scratch(spark, "t")).collect()
    assert sorted((r["n_links"], r["component_id"] is None) for r in out) == [(0, False), (0, True)]


def unit_rows(seed: int, centres: int, n: int, size: int, spread: float) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(centres, size))[rng.integers(0, centres, n)] + rng.normal(0, spread, (n, size))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_walk_equals_all_pairs():
    for spread in (0.0, 0.02, 0.15, 0.6):
        x = unit_rows(4, 6, 700, 16, spread)
        a, b = cover_tree.CoverTree(x[:400]), cover_tree.CoverTree(x[400:])
        wa, wb = np.arange(400) % 3 + 1, np.arange(300) % 2 + 1
        walk = cover_tree.Walk(a, b, wa, wb, 0.93)
        near = a.x @ b.x.T >= 0.93
        assert (walk.of_a == near @ wb).all() and (walk.of_b == near.T @ wa).all()
        i, j = np.nonzero(near)
        found, expected = (brute.components(range(700), pairs) for pairs in (zip(walk.u.tolist(), walk.v.tolist(), strict=True), zip(i.tolist(), (j + 400).tolist(), strict=True)))
        assert found == expected
        own = cover_tree.Walk(a, None, wa, wa, 0.93)
        near = a.x @ a.x.T >= 0.93
        np.fill_diagonal(near, False)
        assert (own.of_a + own.of_b == near @ wa).all()


def test_levels_halve_their_radii_and_hold_all_rows():
    for x in (unit_rows(1, 20, 1500, 64, 0.02), unit_rows(2, 1, 1500, 64, 99.0)):
        tree = cover_tree.CoverTree(x)
        assert sorted(tree.order) == list(range(1500)) and tree.level.max() >= 1
        for node in range(len(tree.start)):
            rows = tree.x[tree.start[node] : tree.stop[node]]
            apart = np.sqrt(np.maximum(0, 2 - 2 * rows @ rows[0]))
            assert apart.max() <= tree.radius[node] + cover_tree.SLACK
            for child in range(tree.first[node], tree.last[node]):
                assert tree.radius[child] <= tree.radius[node] / 2 + cover_tree.SLACK and tree.level[child] == tree.level[node] + 1
            if tree.last[node] == tree.first[node]:
                assert len(rows) == 1 or tree.radius[node] <= cover_tree.LEAST
            else:
                assert (np.concatenate([np.arange(tree.start[c], tree.stop[c]) for c in range(tree.first[node], tree.last[node])]) == np.arange(tree.start[node], tree.stop[node])).all()


def test_pairs_that_the_walk_never_compares():
    """In clusters nearly all; of vectors spread over all directions few, which the README says."""
    clustered, spread = unit_rows(1, 20, 1500, 64, 0.02), unit_rows(2, 1, 1500, 64, 99.0)
    shares = []
    for x in (clustered, spread):
        ones = np.ones(1500, dtype=np.int64)
        shares.append(1 - cover_tree.Walk(cover_tree.CoverTree(x), None, ones, ones, 0.93).compared / (1500 * 1499 / 2))
    assert shares[0] > 0.99 and 0 <= shares[1] < 0.2


def test_cores_and_cells_of_clusters(spark):
    """Clusters larger than a part, copies, and vectors that link with a core as a whole, in part or not at all."""
    rng = np.random.default_rng(8)
    x = np.concatenate([unit_rows(5, 1, 2500, 16, 0.03), unit_rows(6, 3, 900, 16, 0.06), unit_rows(7, 40, 600, 16, 0.0)])
    steps = x[:200] + rng.normal(size=(200, 16)) * np.linspace(0.01, 0.2, 200)[:, None]  # from inside the first core outwards
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, steps, 2 * x[:30]]))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cover_tree.near_duplicates(df, Scratch(spark, "t")).collect()}
    u = np.array([v for _, v, _ in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.93
    np.fill_diagonal(near, False)
    expected = brute.components(range(len(rows)), zip(*(k.tolist() for k in np.nonzero(np.triu(near))), strict=True))
    assert found == {i: (int(near[i].sum()), expected[i]) for i in range(len(rows))}


def test_only_queries_that_need_more_buckets_are_tried_again():
    rng = np.random.default_rng(14)
    x = rng.normal(size=(4000, 32))
    tables = multiprobe.Tables(multiprobe.Index(rows=1), x, len(x), float(np.linalg.norm(x, axis=1).max()), 20)
    log_p = tables.slot_success(x[:40])[1]
    every, n = tables.probes(log_p)
    groups = list(tables.probes_of_each(log_p, 64))
    assert len(groups) > 1 and sorted(k for who, *_ in groups for k in who) == list(range(40))
    for who, buckets, of in groups:
        assert all(n[k] == m <= len(b) and np.array_equal(np.sort(every[k, :m]), np.sort(b[:m])) for k, b, m in zip(who, buckets, of, strict=True))


@pytest.mark.parametrize("columns", [5, 20, 319, 320, 5000])
def test_a_floor_is_reached_by_k_columns_and_hardly_more(columns):
    scores = np.random.default_rng(15).normal(size=(30, columns)).astype(np.float32)
    k = min(20, columns)
    reached = (scores >= multiprobe.floor_of(scores, k)[:, None]).sum(axis=1)
    assert (reached >= k).all() and (reached <= 2 * k).all()
