"""Exact search over inverted lists against brute force: ties, unusable vectors, lengths, and what is pruned."""

import numpy as np
import pytest

from kgspark.functions import vector, vector_index


def brute(rows, queries, k):
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = lambda v: np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max())
    out = []
    for q, w in queries:
        if ok(w):
            near = sorted((round(1 - float(unit(v) @ unit(w)), 11), i) for i, v in rows if ok(v) and len(v) == len(w))[:k]
            out += [(q, r + 1, i) for r, (_, i) in enumerate(near)]
    return sorted(out)


def found(spark, rows, queries, k):
    own = vector.nearest(spark.createDataFrame(rows, "id long, embedding array<double>"), spark.createDataFrame(queries, "query_id long, query array<double>"), k)
    return sorted((r.query_id, r.rank, r.id) for r in own.collect())


@pytest.mark.parametrize("listed, block", [(512, 2048), (7, 5)])
def test_as_brute_force(spark, monkeypatch, listed, block):
    monkeypatch.setattr(vector_index, "LISTED", listed)
    monkeypatch.setattr(vector_index, "BLOCK", block)
    rng = np.random.default_rng(listed)
    points = rng.normal(size=(8, 6))[rng.integers(0, 8, 300)] + rng.normal(size=(300, 6)) * 0.2
    rows = [(i, list(map(float, v))) for i, v in enumerate(points)]
    rows += [(1000 + i, v) for i, v in rows[:40]] + [(2000 + i, [2 * x for x in v]) for i, v in rows[:10]]  # ties
    rows += [(3000 + i, [float(i), 1.0]) for i in range(30)]  # another length
    rows += [(5000, None), (5001, []), (5002, [0.0] * 6), (5003, [float("nan")] * 6), (5004, [None] * 6), (5005, [float("inf")] + [1.0] * 5), (5006, [1e-300] * 6), (5007, [1e300] * 6)]
    queries = [(i, v) for i, v in rows if i % 9 == 0 or i >= 5000] + [(9000, [1.0, 2.0, 3.0])]
    assert found(spark, rows, queries, 4) == brute(rows, queries, 4)
    assert found(spark, rows, queries[:3], 1000) == brute(rows, queries[:3], 1000)


def test_zero_and_null_vectors_are_nobodys_neighbours(spark):
    assert found(spark, [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [0.0, 1.0])], [(7, [1.0, 0.1])], 3) == [(7, 1, 0), (7, 2, 3)]
    assert found(spark, [], [(7, [1.0])], 3) == found(spark, [(1, [1.0])], [], 3) == []


def test_lists_out_of_reach_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "LISTED", 60)
    rng = np.random.default_rng(3)
    middle = np.eye(32)
    rows = [(i, (middle[i % 32] + rng.normal(size=32) * 0.02).tolist()) for i in range(32 * 60)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = vector_index.build(vectors)
    queries = spark.createDataFrame(rows[:40], "query_id long, query array<double>")
    got, work = vector_index.search(index, queries, 5)
    assert index.total == len(rows) and index.lists.count() == len(rows)
    assert sorted((r.query_id, r.rank, r.id) for r in got.collect()) == brute(rows, rows[:40], 5)
    seen = {r.query_id: r.compared for r in work.collect()}
    assert len(seen) == 40 and max(seen.values()) < len(rows) // 4
