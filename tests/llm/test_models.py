"""The trained models against plain versions: loops over rows and every cut, and the closed form of isotonic regression.

Labels are soft, so that no two cuts gain the same by chance; cuts that part the
rows alike may differ, therefore only the rows learned from are compared.
"""

from __future__ import annotations

from fractions import Fraction
from math import exp, log

import numpy as np
import pytest

from kgspark.llm.quality import Additive
from kgspark.llm.toxicity import Boosted, Isotonic


def drawn(seed: int, rows: int, features: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    x = random.normal(size=(rows, features))
    x[:, 0] = np.round(x[:, 0])  # ties
    return x, random.random(rows) * (x[:, 1] > 0) * 0.9 + 0.05


def cut_points(values: np.ndarray, bins: int) -> list[float]:
    return sorted(set(np.quantile(values, [i / bins for i in range(1, bins)]).tolist()))


def logistic(s: float) -> float:
    return 1 / (1 + exp(-s))


def gain_of(parts: list[list[int]], grad: list[float], hess: list[float], weight: float) -> float:
    both = [i for part in parts for i in part]
    one = lambda rows: sum(grad[i] for i in rows) ** 2 / (sum(hess[i] for i in rows) + weight)
    return sum(map(one, parts)) - one(both)


def leaf_of(rows: list[int], grad: list[float], hess: list[float], weight: float) -> float:
    return sum(grad[i] for i in rows) / (sum(hess[i] for i in rows) + weight)


@pytest.mark.parametrize(("seed", "rows", "depth"), [(1, 60, 3), (2, 25, 2), (3, 2, 3)])
def test_boosted_trees(seed, rows, depth):
    x, y = drawn(seed, rows, 3)
    trees, bins, rate, weight = 4, 7, 0.3, 0.5
    edges = [cut_points(f, bins) for f in x.T]
    mean = (y.sum() + 0.5) / (rows + 1)
    score = [log(mean / (1 - mean))] * rows
    for _ in range(trees):
        p = [logistic(s) for s in score]
        grad, hess = [a - b for a, b in zip(y, p)], [b * (1 - b) for b in p]

        def leaves(own: list[int], left: int) -> list[list[int]]:
            best, parts = 1e-9, None
            for f in range(3) if left else ():
                for e in edges[f]:
                    cut = [[i for i in own if x[i, f] <= e], [i for i in own if x[i, f] > e]]
                    if (gain := gain_of(cut, grad, hess, weight)) > best:
                        best, parts = gain, cut
            return [one for part in parts for one in leaves(part, left - 1)] if parts else [own]

        for own in leaves(list(range(rows)), depth):
            for i in own:
                score[i] += rate * leaf_of(own, grad, hess, weight)
    np.testing.assert_allclose(Boosted(x, y, trees, depth, bins, rate, weight).margin(x), score, rtol=0, atol=1e-9)


@pytest.mark.parametrize("seed", range(5))
def test_isotonic(seed):
    random = np.random.default_rng(seed)
    margin, y = random.permutation(40) / 7.0, random.integers(0, 2, 40).astype(float)
    order = np.argsort(margin)
    label = [Fraction(int(v)) for v in y[order]]
    mean = lambda a, b: sum(label[a : b + 1]) / (b + 1 - a)
    fitted = [max(min(mean(a, b) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    steps = sorted(set(fitted))
    got = Isotonic(margin, y)
    np.testing.assert_allclose(got.value, [float(v) for v in steps], rtol=0, atol=1e-12)
    np.testing.assert_allclose(got.at, [np.mean([m for m, v in zip(margin[order], fitted) if v == step]) for step in steps], rtol=0, atol=1e-12)


@pytest.mark.parametrize(("seed", "rows"), [(4, 70), (5, 20), (6, 1)])
def test_additive_tables(seed, rows):
    x, y = drawn(seed, rows, 3)
    bins, rounds, pairs, pair_bins, pair_rounds, rate, weight = 6, 4, 2, 3, 3, 0.2, 0.7
    side = lambda v, cuts: sum(e <= v for e in cuts)
    fine = [[side(v, cut_points(f, bins)) for v in f] for f in x.T]
    coarse = [[side(v, cut_points(f, pair_bins)) for v in f] for f in x.T]
    mean = (y.sum() + 1) / (rows + 2)
    score = [log(mean / (1 - mean))] * rows

    def gradients() -> tuple[list[float], list[float]]:
        p = [logistic(s) for s in score]
        return [a - b for a, b in zip(y, p)], [b * (1 - b) for b in p]

    def parted(own: list[int], at: list[int], least: float) -> list[list[int]] | None:
        best, parts = least, None
        for c in sorted({at[i] for i in own})[1:]:
            cut = [[i for i in own if at[i] < c], [i for i in own if at[i] >= c]]
            if (gain := gain_of(cut, grad, hess, weight)) > best:
                best, parts = gain, cut
        return parts

    def leaves(own: list[int], at: list[int], left: int) -> list[list[int]]:
        parts = parted(own, at, 1e-9) if left else None
        return [one for part in parts for one in leaves(part, at, left - 1)] if parts else [own]

    def add(found: list[list[int]]) -> None:
        for own in found:
            step = rate * leaf_of(own, grad, hess, weight)
            for i in own:
                score[i] += step

    everyone = list(range(rows))
    for _ in range(rounds):
        for f in range(3):
            grad, hess = gradients()
            add(leaves(everyone, fine[f], 2))
    grad, hess = gradients()
    cells = lambda *key: [[i for i in everyone if tuple(coarse[k][i] for k in key) == c] for c in {tuple(coarse[k][i] for k in key) for i in everyone}]
    total = lambda groups: sum(sum(grad[i] for i in g) ** 2 / (sum(hess[i] for i in g) + weight) for g in groups)
    ranked = sorted(((total(cells(f, g)) - total(cells(f)) - total(cells(g)), f, g) for f in range(3) for g in range(f + 1, 3)), reverse=True)
    for _ in range(pair_rounds):
        for _, f, g in ranked[:pairs]:
            grad, hess = gradients()
            halves = parted(everyone, coarse[f], -1.0) or [everyone]
            add([one for half in halves for one in leaves(half, coarse[g], 1)])
    got = Additive(x, y, bins, rounds, pairs, pair_bins, pair_rounds, rate, weight).score(x)
    np.testing.assert_allclose(got, [logistic(s) for s in score], rtol=0, atol=1e-9)
