"""Patterns in texts, all matches and leftmost longest ones, in one shard and in many, against brute force."""

import random
import re

import pytest

from kgspark.operators import matching

norm = lambda s: re.sub("[^0-9a-z]+", " ", (s or "").lower()).strip()


def brute(texts, patterns, longest):
    out = []
    for t, text in texts:
        words = norm(text).split(" ")
        hits = []
        for p, pattern in patterns:
            run = norm(pattern).split(" ")
            if run != [""]:
                hits += [(i, i + len(run), p) for i in range(len(words) - len(run) + 1) if words[i : i + len(run)] == run]
        if longest:
            hits.sort(key=lambda h: (h[0], -h[1], h[2]))
            kept, free, last = [], 0, None
            for h in hits:
                if h[0] >= free or h[:2] == last:
                    kept.append(h)
                    free, last = h[1], h[:2]
            hits = kept
        begin = lambda i: len(" ".join(words[:i])) + (i > 0)
        out += [(t, p, begin(a), begin(a) + len(" ".join(words[a:b]))) for a, b, p in hits]
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1 << 20, 60])
@pytest.mark.parametrize("longest", [False, True])
def test_as_brute_force(spark, monkeypatch, size, longest):
    monkeypatch.setattr(matching, "SHARD_BYTES", size)
    rng = random.Random(5)
    run = lambda n: " ".join(rng.choice("a b c ab ba abc".split()) for _ in range(n))
    texts = [(i, run(rng.randrange(0, 40))) for i in range(80)] + [(100, None), (101, ""), (102, "!?"), (103, "A, B -- C!"), (104, "x " * 20_000 + "needle in it")]
    patterns = [(f"p{i}", run(rng.randrange(1, 6))) for i in range(30)] + [("same1", "a b"), ("same2", "A  b"), ("none", None), ("empty", ""), ("sign", "?"), ("long", "b c " * 40), ("needle", "needle in"), ("whole", "a b c")]
    a = spark.createDataFrame(texts, "tid long, text string")
    b = spark.createDataFrame(patterns, "pid string, text string")
    got = matching.matches(a, b, longest=longest)
    assert got.columns == ["tid", "pid", "start", "stop"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(texts, patterns, longest)
    assert matching.matches(a, b.limit(0), longest=longest).count() == matching.matches(a.limit(0), b, longest=longest).count() == 0
