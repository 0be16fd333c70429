"""All pairs that share nodes: whole against brute force, over ranges, batches and hubs."""

import pytest

from kgspark.operators import shares

from .test_draws import frames, graph, overlaps


@pytest.mark.parametrize("numbers, batch", [(1 << 16, "10000"), (8, "3"), (5, "1")])
def test_all_pairs_are_counted(spark, monkeypatch, numbers, batch):
    """More than 200 partners of an anchor, hubs over several ranges, lists of an anchor over several batches."""
    monkeypatch.setattr(shares, "RANGE", numbers)
    monkeypatch.setitem(shares.BATCHES, "spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    edges = graph(260 if batch == "10000" else 60)
    want = overlaps(edges, edges)
    for low, high in ((1, None), (2, 3)):
        got = shares.pairs(*frames(spark, edges, edges), low, high).collect()
        assert len(got) == len({(r.anchor, r.partner) for r in got})
        assert {(r.anchor, r.partner): r.overlap for r in got} == {k: n for k, n in want.items() if n >= low and (high is None or n <= high)}


def test_no_edges(spark):
    edges = graph()
    left, right = frames(spark, edges, edges)
    assert shares.pairs(left.limit(0), right).count() == shares.pairs(left, right.limit(0)).count() == 0


def test_a_list_holds_partners_of_a_wide_range(spark):
    """sm03_paired, sm04_bridge_exists: an anchor's edge is sent once for each 200,000 partners at least, not for each 65,536."""
    assert shares.RANGE >= 200_000
    right = spark.range(70_000).selectExpr("concat('p', id) AS partner", "'x' AS x")
    got = shares.pairs(spark.createDataFrame([("a", "x")], "anchor string, x string"), right)
    assert got.count() == got.select("partner").distinct().count() == 70_000
