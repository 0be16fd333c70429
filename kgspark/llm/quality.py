"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into quantile bins.  Cyclic boosting fits one shallow tree
at a time, feature after feature, to the gradient of the log loss and adds its
leaves to the feature's lookup table; then pairs of features whose residuals
depend on both are fitted in the same way.  A score is the logistic of a sum of
table entries, read by vectorised bin lookups.

Training uses at most ``most`` texts of as many labelled ids (a documented bound; the rest
of the tables is never sampled).  Defined cases: null and empty texts get the
score of all-zero features; repeated rows get equal scores; without any
training row every score is 0.5; ties in a feature fall into one bin; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import features as ft
from .kernels import WS, Words

MOST = 20_000  # labelled documents to learn from
FEATURES = ["log_words", "upper", "symbol", "mark", "stop", "pipe", "digit", "high", "quote", "distinct", "top", "again", "lines", "line_distinct", "word_bytes", "function", "ends_symbol", "all_upper", "long", "single"]
FUNCTION = ft.word_values(ft.FUNCTION_WORDS)


def quality_features(words: Words) -> np.ndarray:
    """(texts x features) of whole texts."""
    c = ft.Chunk(words)
    n, size = c.n_words, c.n_bytes
    bare = Words(words.raw, words.offsets, lower=True, gaps=ft.NOT_LETTER)
    values = bare.hashes()
    n_bare = np.diff(bare.first).astype(float)
    distinct, top = ft.repeats(values, bare.first)
    same = np.concatenate(([False], values[1:] == values[:-1]))
    lines = Words(words.raw, words.offsets, gaps=ft.LINE)
    n_lines = np.diff(lines.first).astype(float)
    line_distinct, _ = ft.repeats(lines.hashes(), lines.first)
    lengths = (words.ends - words.starts).astype(float)
    last = words.raw[words.ends - 1] if len(words.ends) else np.zeros(0, np.uint8)
    upper = np.concatenate(([0], np.cumsum(ft.UPPER[words.raw])))
    upper_share = upper[words.ends] - upper[words.starts] >= 0.6 * lengths
    each = lambda flags: ft.per(c.per_text(words, flags), n)
    return np.column_stack([
        np.log1p(n), *(ft.per(c.bytes_in(t), size) for t in (ft.UPPER, ft.SYMBOL, ft.MARK, ft.STOP, ft.PIPE, ft.DIGIT, ft.HIGH, ft.QUOTE)),
        ft.per(distinct, n_bare), ft.per(top, n_bare), ft.per(c.per_text(bare, same), n_bare), ft.per(n_lines, n), ft.per(line_distinct, n_lines),
        ft.per(size, n), ft.per(c.per_text(bare, ft.among(values, FUNCTION)), n_bare), each(ft.SYMBOL[last] | ft.MARK[last]), each(upper_share & (lengths > 1)), each(lengths > 20), each(lengths == 1),
    ])


class Additive:
    """Tables by feature and by pair of features; each side of a cut is a leaf of a tree of depth two."""

    def __init__(self, x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, pairs: int = 8, pair_bins: int = 8, pair_rounds: int = 40, rate: float = 0.08, weight: float = 4.0):
        self.base, self.edges, self.tables, self.pairs = 0.0, [], [], []
        if not len(y):
            return
        rate_1 = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(rate_1 / (1 - rate_1)))
        self.edges = [np.unique(np.quantile(f, np.linspace(0, 1, bins + 1)[1:-1])) for f in x.T]
        self.wide = [np.unique(np.quantile(f, np.linspace(0, 1, pair_bins + 1)[1:-1])) for f in x.T]
        at = [np.searchsorted(e, f, "right") for e, f in zip(self.edges, x.T, strict=True)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        score = np.full(len(y), self.base)
        for _ in range(rounds):
            for f, own in enumerate(at):
                step = rate * self._tree(*self._sums(own, y, score, len(self.tables[f])), weight)
                self.tables[f] += step
                score += step[own]
        coarse = [np.searchsorted(e, f, "right") for e, f in zip(self.wide, x.T, strict=True)]
        gains = []
        for f in range(x.shape[1]):
            for g in range(f + 1, x.shape[1]):
                k, m = len(self.wide[f]) + 1, len(self.wide[g]) + 1
                a, b = self._sums(coarse[f] * m + coarse[g], y, score, k * m)
                a, b = a.reshape(k, m), b.reshape(k, m)
                own = (a**2 / (b + weight)).sum() - (a.sum(0) ** 2 / (b.sum(0) + weight)).sum() - (a.sum(1) ** 2 / (b.sum(1) + weight)).sum()
                gains.append((float(own), f, g))
        for _, f, g in sorted(gains, reverse=True)[:pairs]:
            self.pairs.append((f, g, np.zeros((len(self.wide[f]) + 1, len(self.wide[g]) + 1))))
        for _ in range(pair_rounds):
            for f, g, table in self.pairs:
                k, m = table.shape
                own = coarse[f] * m + coarse[g]
                a, b = (v.reshape(k, m) for v in self._sums(own, y, score, k * m))
                cut = self._cut(a.sum(1), b.sum(1), weight)[1] or k
                step = np.empty((k, m))
                for part in (slice(0, cut), slice(cut, k)):
                    step[part] = rate * self._tree(a[part].sum(0), b[part].sum(0), weight, depth=1)
                table += step
                score += step.ravel()[own]

    @staticmethod
    def _sums(own, y, score, n):
        p = 1 / (1 + np.exp(-score))
        return np.bincount(own, y - p, n), np.bincount(own, p * (1 - p), n)

    @staticmethod
    def _cut(a, b, weight):
        """(gain, first bin of the right side) of the best cut."""
        if len(a) < 2:
            return 0.0, 0
        left_a, left_b = np.cumsum(a)[:-1], np.cumsum(b)[:-1]
        gain = left_a**2 / (left_b + weight) + (a.sum() - left_a) ** 2 / (b.sum() - left_b + weight) - a.sum() ** 2 / (b.sum() + weight)
        best = int(np.argmax(gain))
        return float(gain[best]), best + 1

    def _tree(self, a, b, weight, depth=2):
        gain, cut = self._cut(a, b, weight)
        if not depth or gain <= 1e-9:
            return np.full(len(a), a.sum() / (b.sum() + weight))
        return np.concatenate((self._tree(a[:cut], b[:cut], weight, depth - 1), self._tree(a[cut:], b[cut:], weight, depth - 1)))

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edges, x[:, f], "right")]
        for f, g, table in self.pairs:
            out += table[np.searchsorted(self.wide[f], x[:, f], "right"), np.searchsorted(self.wide[g], x[:, g], "right")]
        return 1 / (1 + np.exp(-out))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST) -> Additive:
    """A model from the labelled rows that ``learn`` (a condition on labels) allows, at most ``most`` of them."""
    return Additive(*ft.sampled_features(ft.training_rows(docs, labels, id_col, text_col, label_col, learn, most), quality_features, most))


def scored(docs: DataFrame, model: Additive, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a column score_col (double, 0 to 1; replaces one of that name)."""
    return ft.scored(docs, text_col, score_col, lambda words: model.score(quality_features(words)))
