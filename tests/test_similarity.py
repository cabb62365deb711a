"""The pruned top-k join against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hedgeline.operators import similarity
from hedgeline.operators.similarity import TopK


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "id bigint, vector array<double>").repartition(4)


def brute(a, b, k, least):
    out = set()
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)
    for i, x in a:
        if ok(x):
            scores = sorted(((-round(float(np.dot(x, y)), 6), j) for j, y in b if ok(y) and len(y) == len(x)))
            out |= {(i, j, -s, n) for n, (s, j) in enumerate([(s, j) for s, j in scores if -s >= least][:k], 1)}
    return out


def found(search: TopK):
    return {(r["a_id"], r["b_id"], r["score"], r["place"]) for r in search.found().collect()}


ODD = [(9000, None), (9001, []), (9002, [1.0, None, 0.0, 0.0]), (9003, [float("nan")] * 4), (9004, [0.0] * 4), (9005, [1.0, 2.0]), (9006, [50.0] * 4), (9007, [3.0, 1.0])]


def test_it_equals_brute_force_and_skips_other_groups(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(16, 24))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    # a third of both sides lies in one group
    near = lambda n, at: [(at + i, (centres[0 if i % 3 == 0 else i % 16] + rng.normal(0, 0.02, 24)).round(6)) for i in range(n)]
    a, b = near(300, 0), near(1500, 1000)
    b += [(3000 + i, b[7][1]) for i in range(30)]  # ties
    search = TopK(frame(spark, a), frame(spark, b), 3, 0.5, digits=6)
    assert found(search) == brute(a, b, 3, 0.5)
    assert search.compared() < 0.4 * len(a) * len(b)
    visits = spark.read.parquet(f"{search.folder}/visits-then").unionByName(spark.read.parquet(f"{search.folder}/visits-first"))
    assert visits.groupBy("id", "size", "pivot", "block").count().where("count > 1").count() == 0


@pytest.mark.parametrize("least", [-5.0, 0.25])
def test_vectors_of_all_kinds(spark, monkeypatch, least):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 30)
    rng = np.random.default_rng(4)
    a = [(i, rng.normal(size=4).round(3)) for i in range(60)] + ODD
    b = [(100 + i, rng.normal(size=4).round(3) * (1 + i % 5)) for i in range(400)] + ODD
    search = TopK(frame(spark, a), frame(spark, b), 4, least, digits=6)
    assert found(search) == brute(a, b, 4, least)
    nothing = frame(spark, b).where(F.lit(False))
    assert similarity.top_candidates(nothing, frame(spark, b)).count() == 0 and similarity.top_candidates(frame(spark, a), nothing).count() == 0


def test_a_block_is_not_sorted_and_ties_go_to_the_smaller_id(monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(5)
    side = lambda at, x: pd.DataFrame({"id": rng.permutation(len(x)) + at, "size": x.shape[1], "vector": [v.tobytes() for v in x]})
    monkeypatch.setattr(np, "argsort", None)  # a sort of every product
    huge = np.vstack([np.full((3, 4), 1e200), np.full((3, 4), -1e200)])
    huge[3:, 2:] *= -1
    for x, y in ((rng.normal(size=(50, 4)), rng.normal(size=(400, 4))), (rng.integers(0, 3, (40, 4)).astype(float), rng.integers(0, 2, (900, 4)).astype(float)), (huge, huge)):
        one, two = side(0, x), side(1000, y)
        with np.errstate(all="ignore"):
            scores, k = (x @ y.T).round(6), 3
            expected = {}
            for i, row in zip(one["id"], scores, strict=True):
                expected[i] = sorted(((-s, j) for s, j in zip(row, two["id"], strict=True) if s >= 0.25))[:k]
            for frame in (one, one.assign(floor=[-expected[i][-1][0] if len(expected[i]) == k else np.nan for i in one["id"]])):
                got = similarity.best_of(frame, two, k, 0.25, 6)
                assert {i: v for i, v in expected.items() if v} == {i: [(-s, j) for s, j in zip(g["score"], g["b_id"], strict=True)] for i, g in got.groupby("a_id")}


def test_what_is_found_is_written_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8)) for i in range(300)]
    search = TopK(frame(spark, rows), frame(spark, rows), 3, -5.0)
    assert "FlatMapCoGroupsInPandas" not in search.found()._jdf.queryExecution().executedPlan().toString()
