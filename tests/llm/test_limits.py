"""Inputs at the far ends: tiny and huge numbers, many lengths, long unbroken texts, other digits, repeated rows."""

import time

import numpy as np

from kgspark.llm import covertree, embedding_dedup, mixing, pseudonyms


def test_tiny_and_huge_vectors_link(spark):
    rows = [(1, [1e-200, 1e-200]), (2, [1.0, 1.01]), (3, [1e200, 1e200]), (4, [5e-324, 0.0]), (5, [1.0, 0.0]), (6, [-1.0, 1e-9]), (7, [0.0, 0.0])]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (0, 7)}


def test_vectors_of_many_lengths(spark):
    rows = [(i, [float(k == i % 3) + 1e-3 for k in range(1 + i % 1100)]) for i in range(2200)]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    want = {i: int(unit[i] @ unit[(i + 1100) % 2200] >= 0.9) for i, _ in rows}
    assert {r.vec_id: r.n_links for r in out} == want


def test_blocks_in_cells_lose_no_link(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    x[100:] = x[rng.integers(0, 100, 200)] + rng.normal(size=(200, 8)) * 0.3
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((u @ u.T >= 0.9) & ~np.eye(300, dtype=bool)).sum(1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=16).collect()
    assert {r.vec_id: r.n_links for r in out} == dict(enumerate(want.tolist()))


def test_top_k_of_several_lengths_and_ties(spark):
    rows = [(i, [1.0] * (2 + i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = covertree.top_k(df, df.vec_id % 50 == 0, k=4, data_block=7, query_block=1).collect()
    got = {q: [r.vec_id for r in sorted(out, key=lambda r: r.rank) if r.query_id == q] for q in (0, 50)}
    assert got == {0: [3, 6, 9, 12], 50: [2, 5, 8, 11]}


def test_long_unbroken_texts_are_quick():
    own = pseudonyms.Pseudonyms(b"k")
    for text in ("a" * 1_000_000, "x" * 500_000 + "@b.com", "a@" * 200_000, "x.y" * 300_000, "7" * 1_000_000):
        began = time.time()
        out, _ = own.replace(text)
        assert len(out) == len(text) and time.time() - began < 20
        assert pseudonyms.Pseudonyms(b"k", back=True).replace(out)[0] == text


def test_spellings_of_a_date_are_linked():
    own = pseudonyms.Pseudonyms(b"k")
    days = [tuple(map(int, own.replace(t)[0].replace("/", "-").replace(".", "-").split("-"))) for t in ("2024-01-05", "2024-1-5", "2024/1/05")]
    assert len(set(days)) == 1
    y, m, d = days[0]
    assert own.replace("5.1.2024 and 05/01/2024")[0] == f"{d}.{m}.{y} and {d:02d}/{m:02d}/{y}"


def test_other_digits_stay_and_are_not_counted():
    text = "ssn \uff11\uff12\uff13-\uff14\uff15-\uff16\uff17\uff18\uff19 and \u0664\u0661\u0661\u0661"
    assert pseudonyms.Pseudonyms(b"k").replace(text) == (text, {})


def test_repeated_rows_at_the_end_of_a_mix(spark):
    rows = [(7, "w " * 10, "a")] * 30 + [(i, "w " * 10, "b") for i in range(100, 130)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out, _ = mixing.drawn(df)
    taken = {}
    for r in out.select("source", "_mix_target", mixing.taken().alias("t")).collect():
        taken.setdefault(r.source, [r[1], 0])[1] += r.t
    assert all(abs(target - n) < 1 for target, n in taken.values()) and len(taken) == 2


def test_trees_are_never_joined(spark):
    """op1: a join of trees may be planned as a broadcast of all of them through the driver; a tree of whole numbers travels as these."""
    import pickle

    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(100)], "vec_id long, embedding array<double>")
    plan = covertree.top_k(df, df.vec_id % 50 == 0, data_block=20, query_block=1)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    tree = covertree.Tree(np.arange(4000.0).reshape(-1, 4), np.arange(1000))
    again = pickle.loads(pickle.dumps(tree, protocol=5))
    assert again.points.dtype == np.float64 and (again.points == tree.points).all() and len(pickle.dumps(tree.__getstate__()["points"], protocol=5)) < 4000 * 8 // 3


def test_blocks_are_sent_to_strips(spark, monkeypatch):
    """op7: of 40 blocks that all meet, a task holds many, and another block is sent to it once, not once for each of these."""
    sent = []
    monkeypatch.setattr(embedding_dedup, "compare", lambda axes, least, real=embedding_dedup.compare: sent.append(least) or real(axes, least))
    seen = []
    monkeypatch.setattr(embedding_dedup.shared, "written", lambda df, name, real=embedding_dedup.shared.written: seen.append((name, real(df, name))) or seen[-1][1])
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6))
    x[200:300] = x[:100] + 1e-3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for size in (embedding_dedup.STRIP_BYTES, 2000):  # one strip, and several
        seen.clear()
        monkeypatch.setattr(embedding_dedup, "STRIP_BYTES", size)
        out = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, block=10).collect()}
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = u @ u.T >= 0.9
        assert all(out[i].n_links == near[i].sum() - 1 for i in range(400))
        wanted = next(t for name, t in seen if name == "wanted")
        blocks = wanted.select("block").distinct().count()
        assert blocks > 30 and (size == 2000 or wanted.count() <= blocks * (embedding_dedup.SHARES + 1))
