"""Draws of partners: exact overlaps, whole pools, uniform draws, hubs, and anchors without a partner, against brute force."""

import collections
import random

import pytest

from kgspark.operators import draws


def frames(spark, left, right):
    return spark.createDataFrame(left, "anchor string, x string"), spark.createDataFrame(right, "partner string, x string")


def overlaps(left, right):
    has = collections.defaultdict(set)
    for p, x in right:
        has[p].add(x)
    own = collections.defaultdict(set)
    for a, x in left:
        own[a].add(x)
    return {(a, p): len(own[a] & has[p]) for a in own for p in has if a != p and own[a] & has[p]}


def graph(n=60, hubs=12, fan=5, seed=1):
    rng = random.Random(seed)
    edges = sorted({(f"e{i:03d}", f"x{min(rng.randrange(hubs), rng.randrange(hubs)):02d}") for i in range(n) for _ in range(rng.randrange(1, fan))})
    edges += [(f"e{i:03d}", "hub") for i in range(n)] + [("wide", f"x{i:02d}") for i in range(hubs)] + [("alone", "own")]
    return edges


@pytest.mark.parametrize("sets", [256, 2])
def test_all_partners_where_there_are_few(spark, monkeypatch, sets):
    """The pool is whole if it has fewer than are drawn; nodes with many hubs are looked up, with the same result."""
    monkeypatch.setattr(draws, "SETS", sets)
    edges = graph()
    want = overlaps(edges, edges)
    for low, high in ((1, None), (2, 3)):
        got = draws.common(*frames(spark, edges, edges), "t", 10**6, 10**6, low, high, "s").collect()
        assert {(r.anchor, r.partner): r.overlap for r in got} == {k: v for k, v in want.items() if v >= low and (high is None or v <= high)} and len(got) == len({(r.anchor, r.partner) for r in got})


def test_few_draws_are_exact_and_leave_no_anchor_out(spark):
    """Every anchor with a partner in bounds has one, however rare those are; overlaps are exact; reruns agree."""
    edges = graph(400, 30)
    want = overlaps(edges, edges)
    for low, high in ((1, None), (4, None)):
        got = draws.common(*frames(spark, edges, edges), "t", 3, 4, low, high, "s").collect()
        assert all(want[r.anchor, r.partner] == r.overlap >= low for r in got)
        assert {r.anchor for r in got} == {a for (a, _), n in want.items() if n >= low}
        assert max(collections.Counter(r.anchor for r in got).values()) <= 3
        assert sorted(got) == sorted(draws.common(*frames(spark, edges, edges), "t", 3, 4, low, high, "s").collect())


def test_partners_of_many_common_nodes_are_not_drawn_more_often(spark):
    """Anchor a shares one node with 40 partners and five with 40 others: both are drawn alike."""
    left = [(f"a{i}", f"{i}-{k}") for i in range(60) for k in range(6)]
    right = [(f"{i}-one{j}", f"{i}-0") for i in range(60) for j in range(40)] + [(f"{i}-five{j}", f"{i}-{k}") for i in range(60) for j in range(40) for k in range(1, 6)]
    got = draws.common(*frames(spark, left, right), "t", 1000, 60, 1, None, "s").collect()
    kinds = collections.Counter(r.overlap for r in got)
    assert set(kinds) == {1, 5} and 0.75 < kinds[1] / kinds[5] < 1.33


def test_a_hub_is_not_read_whole(spark):
    """Of one hub with all nodes, each anchor gets about as many candidates as it draws."""
    edges = [(f"e{i:05d}", "hub") for i in range(20_000)]
    got = draws.common(*frames(spark, edges, edges), "t", 200, 40, 1, None, "s").groupBy("anchor").count().collect()
    assert len(got) == 20_000 and sum(r["count"] for r in got) < 20_000 * 60


def test_complement(spark):
    """One partner without a common node for each anchor that has any; all alike; none for an anchor that is linked with all."""
    right = [(f"p{j:02d}", f"x{j}") for j in range(40)] + [("none", "elsewhere")]
    left = [(f"a{i:04d}", f"x{j}") for i in range(1500) for j in range(40) if j >= 4] + [("all", x) for _, x in right] + [("p00", "x1")]
    anchors = spark.createDataFrame([(a,) for a in sorted({a for a, _ in left} | {"free"})], "anchor string")
    got = {r.anchor: r.partner for r in draws.apart(*frames(spark, left, right), anchors, "t", "s").collect()}
    assert set(got) == {a for a, _ in left} - {"all"} | {"free"}
    assert all(got[f"a{i:04d}"] in ("p00", "p01", "p02", "p03", "none") for i in range(1500))
    seen = collections.Counter(got[f"a{i:04d}"] for i in range(1500))
    assert len(seen) == 5 and min(seen.values()) > 220 and max(seen.values()) < 390
    assert got["p00"] not in ("p00", "p01")
    nothing = draws.apart(*frames(spark, left, right[:0]), anchors, "t", "s")
    assert nothing.columns == ["anchor", "partner"] and nothing.count() == 0


def test_numbers_are_positions(spark):
    own = draws.numbered(spark.createDataFrame([(f"{i * 7919 % 1000:04d}",) for i in range(1000)], "k string").repartition(7), "k")
    assert sorted((r.k, r.number) for r in own.collect()) == [(f"{i:04d}", i) for i in range(1000)]
    assert draws.numbered(own.drop("number").limit(0), "k").count() == 0


@pytest.mark.parametrize("start, tries", [("e", 12), ("n/", 12), ("n/", 1)])
def test_first_candidates_are_those_of_common(spark, monkeypatch, start, tries):
    """sm10_sample_boolean: slots without sets give each anchor the partner that slots with sets give, with names as numbers or as they are."""
    monkeypatch.setattr(draws, "TRIES", tries)
    node = lambda name: start + (name[1:].lstrip("0") or "0" if name[1:].isdigit() else "9" * len(name))
    edges = [(node(a), "x/" + node(x)) for a, x in graph(80, 12)]
    for draws_ in (2,):
        left, right = (draws.written(df, "t") for df in frames(spark, edges, edges))
        assert (draws.Names([left.select("anchor"), left.select("x")]).starts is None) == (start == "e")
        want = {(r.anchor, r.partner) for r in draws.common(left, right, "t", 1, draws_, seed="s").collect()}
        got = draws.one(left, right, "t", draws_, "s").collect()
        assert want and {tuple(r) for r in got} == want and len(got) == len(want)


def test_slots_of_one_draw_hold_no_sets(spark, sf, monkeypatch):
    """sm10_sample_boolean: what a partner points at does not travel with each of its edges, and edges are made once."""
    from kgspark import registry

    kept, own = [], draws.written
    monkeypatch.setattr(draws, "written", lambda df, name: kept.append((name, dict(df.dtypes))) or own(df, name))
    registry.load()
    assert registry.QUERIES["sm10_sample_boolean"](spark, sf).count() == 5
    assert not any("struct" in kind for kind in next(kinds for name, kinds in kept if name == "slots").values())
    assert [name for name, _ in kept].count("left") == 1
