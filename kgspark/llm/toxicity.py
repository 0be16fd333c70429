"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a fixed and of a learned lexicon, nearness of lexicon
words to second-person words, capitals, punctuation and obfuscation (words whose
digits and signs stand for letters).  The lexicon, of words and of beginnings of
words, is learned from the training sample by smoothed log odds of document
frequencies, one document of each family of copies.  Trees see features by the
lexicon of the other half of the sample, so that they learn what it is worth on
texts that it was not made from; margins of folds left out fit the calibration.

Training uses at most ``most`` labelled documents (a documented bound; nothing
else is sampled).  Defined cases: null and empty texts get the score of
all-zero features; repeated rows get equal scores; without any training row
every score is 0; further columns are ignored.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import features as ft
from .kernels import Words

MOST = 40_000  # labelled documents to learn from
LEXICON_WORDS = 4_000  # most learned words
SUPPORT = 3  # least toxic documents of a learned word
HEAD = 6  # bytes of a word's beginning
HEAD_MARK = np.uint64(0x7F4A7C159E3779B9)
NEAR = 5  # words on either side
SECOND = ft.word_values(ft.SECOND_PERSON)

# General insults of four languages.
INSULTS = "idiot moron stupid dumb scum loser trash pathetic worthless disgusting clown fool ugly jerk crap garbage filth vermin imbecile cretin freak hate shut dumm blöd trottel abschaum versager dreck wertlos widerlich erbärmlich idiote imbécile débile connard ordure minable pathétique dégoûtant nul crétin idiota imbécil estúpido basura asqueroso patético inútil payaso escoria perdedor".split()
FIXED = ft.word_values(INSULTS)


@dataclass
class Lexicon:
    values: np.ndarray  # sorted word values
    odds: np.ndarray  # log odds of each


def streams(words: Words) -> tuple[Words, np.ndarray, np.ndarray]:
    """Bare words, their values with letters for the signs that stand for them, and which words hold such signs."""
    bare = Words(words.raw, words.offsets, lower=True, gaps=ft.NOT_LEET)
    bare.data = ft.LEET[words.raw]
    plain = Words(words.raw, words.offsets, lower=True, gaps=ft.NOT_LETTER)
    signs = np.concatenate(([0], np.cumsum(ft.NOT_LETTER[words.raw])))
    letters = np.concatenate(([0], np.cumsum(ft.LETTER[words.raw])))
    hidden = (signs[bare.ends] > signs[bare.starts]) & (letters[bare.ends] - letters[bare.starts] >= 2)
    values = bare.hashes()
    # A word without such signs is the same in both; one whose signs only trail is a plain word.
    first = np.searchsorted(plain.starts, bare.starts)
    trail = hidden & (first < len(plain.starts))
    if trail.any():
        own = plain.hashes()
        k = np.flatnonzero(trail)
        k = k[plain.starts[first[k]] == bare.starts[k]]
        rest = letters[bare.ends[k]] - letters[plain.ends[first[k]]]
        k = k[rest == 0]
        values[k] = own[first[k]]
        hidden[k] = False
    return bare, values, hidden


def heads(bare: Words) -> np.ndarray:
    """Values of the beginnings of words that are longer, 0 of others."""
    cut = copy.copy(bare)
    cut.ends = np.minimum(bare.ends, bare.starts + HEAD)
    return np.where(bare.ends - bare.starts > HEAD, cut.hashes() ^ HEAD_MARK, np.uint64(0))


def learn_lexicon(rows: DataFrame, most: int = LEXICON_WORDS, support: int = SUPPORT) -> Lexicon:
    """Words of the highest log odds among (text, label); bounded by ``most``."""

    def run(part: pa.RecordBatch, words: Words) -> dict:
        bare, values, _ = streams(words)
        text = np.repeat(np.arange(len(words)), np.diff(bare.first))
        begin = heads(bare)
        text, values = np.concatenate((text, text[begin > 0])), np.concatenate((values, begin[begin > 0]))
        order = np.lexsort((values, text))
        text, values = text[order], values[order]
        new = np.concatenate(([True], (text[1:] != text[:-1]) | (values[1:] != values[:-1]))) if len(text) else np.zeros(0, bool)
        text, values = text[new], values[new]
        label = part.column("label").to_numpy()[text] > 0.5
        return {"value": values.view(np.int64), "family": ft.family(words)[text].view(np.int64), "toxic": label}

    each = ft.map_texts(rows, "value long, family long, toxic boolean", run).distinct()
    sizes = rows.agg(F.coalesce(F.sum("label"), F.lit(0.0)).alias("t"), F.count("*").alias("n")).first()
    odds = F.log((F.col("t") + 0.5) / (sizes["t"] + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (sizes["n"] - sizes["t"] + 1))
    top = each.groupBy("value").agg(F.sum(F.col("toxic").cast("int")).alias("t"), F.count("*").alias("n")).where(F.col("t") >= support).select("value", odds.alias("odds")).where("odds > 2")
    got = top.orderBy(F.desc("odds"), "value").limit(most).toArrow()
    values = got.column("value").to_numpy().view(np.uint64)
    order = np.argsort(values)
    return Lexicon(values[order], got.column("odds").to_numpy()[order])


def toxicity_features(words: Words, lexicon: Lexicon) -> np.ndarray:
    """(texts x features) of whole texts."""
    c = ft.Chunk(words)
    bare, values, hidden = streams(words)
    n, size = np.diff(bare.first).astype(float), c.n_bytes
    fixed = ft.among(values, FIXED)
    learned = ft.among(values, lexicon.values)
    odds = np.zeros(len(values))
    if learned.any():
        odds[learned] = lexicon.odds[np.searchsorted(lexicon.values, values[learned])]
    begin = heads(bare)
    begun = ft.among(begin, lexicon.values) & (begin > 0)
    begin_odds = np.zeros(len(values))
    if begun.any():
        begin_odds[begun] = lexicon.odds[np.searchsorted(lexicon.values, begin[begun])]
    second = ft.among(values, SECOND)
    hit = fixed | learned
    text = np.repeat(np.arange(len(words)), np.diff(bare.first))
    near = np.zeros(len(values), bool)
    for step in range(1, NEAR + 1):
        if len(values) > step:
            same = text[step:] == text[:-step]
            near[step:] |= second[:-step] & same
            near[:-step] |= second[step:] & same
    top = np.zeros(len(words))
    np.maximum.at(top, text, odds)
    hits, n_fixed = c.per_text(bare, hit), c.per_text(bare, fixed)
    kinds, most = ft.repeats(values[hit], np.concatenate(([0], np.cumsum(hit)))[bare.first])
    return np.column_stack([
        np.log1p(n), n_fixed, ft.per(n_fixed, n), hits, ft.per(hits, n), c.per_text(bare, odds), ft.per(c.per_text(bare, odds), n), top, kinds, most,
        c.per_text(bare, begun), ft.per(c.per_text(bare, begun), n), ft.per(c.per_text(bare, begin_odds), n),
        ft.per(c.per_text(bare, second), n), ft.per(c.per_text(bare, hit & near), np.maximum(hits, 1)), ft.per(c.per_text(bare, hidden), n), c.per_text(bare, hidden & hit),
        *(ft.per(c.bytes_in(t), size) for t in (ft.UPPER, ft.MARK, ft.SYMBOL, ft.STOP, ft.DIGIT, ft.HIGH)),
    ])


class Boosted:
    """Trees of a fixed depth on quantile bins, fitted to the gradient of the log loss; complete binary trees in arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 3, bins: int = 48, rate: float = 0.1, weight: float = 3.0):
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.base, self.depth = float(np.log(p / (1 - p))), depth
        edges = [np.unique(np.quantile(f, np.linspace(0, 1, bins + 1)[1:-1])) if len(y) else np.zeros(0) for f in x.T]
        at = np.column_stack([np.searchsorted(e, f, "left") for e, f in zip(edges, x.T, strict=True)]) if len(y) else np.zeros((0, 0), int)
        score = np.full(len(y), self.base)
        for _ in range(trees if len(y) else 0):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            feature, cut = np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf)
            node = np.zeros(len(y), int)
            for level in range(depth):
                low, width = 2**level - 1, 2**level
                gains = np.full((width, x.shape[1]), 0.0)
                cuts = np.zeros((width, x.shape[1]), int)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    k = len(e) + 1
                    own = (node - low) * k + at[:, f]
                    a, b = (np.bincount(own, v, width * k).reshape(width, k) for v in (grad, hess))
                    la, lb = np.cumsum(a, 1)[:, :-1], np.cumsum(b, 1)[:, :-1]
                    ta, tb = a.sum(1, keepdims=True), b.sum(1, keepdims=True)
                    gain = la**2 / (lb + weight) + (ta - la) ** 2 / (tb - lb + weight) - ta**2 / (tb + weight)
                    cuts[:, f] = gain.argmax(1)
                    gains[:, f] = gain.max(1)
                best = gains.argmax(1)
                for i in range(width):
                    if gains[i, best[i]] > 1e-9:
                        feature[low + i], cut[low + i] = best[i], edges[best[i]][cuts[i, best[i]]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - (2**depth - 1)
            value = rate * np.bincount(leaf, grad, 2**depth) / (np.bincount(leaf, hess, 2**depth) + weight)
            score += value[leaf]
            self.trees.append((feature, cut, value))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


class Isotonic:
    """Pool-adjacent-violators fit of labels on margins, read by linear interpolation."""

    def __init__(self, margin: np.ndarray, y: np.ndarray):
        order = np.argsort(margin, kind="stable")
        blocks: list[list[float]] = []  # sum of labels, rows, sum of margins
        for m, label in zip(margin[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([label, 1.0, m])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                top = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
        self.at = np.array([b[2] / b[1] for b in blocks])
        self.value = np.array([b[0] / b[1] for b in blocks])

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.value) if len(self.at) else np.zeros(len(margin))


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted
    calibration: Isotonic

    def score(self, words: Words) -> np.ndarray:
        margin = self.trees.margin(toxicity_features(words, self.lexicon))
        # a little of the margin keeps the order within the steps of the calibration
        return np.clip(0.999 * self.calibration(margin) + 0.001 / (1 + np.exp(-margin)), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST) -> Model:
    """Lexicons of both halves of the sample (by hash of the text) for the trees, that of all of it for the model."""
    rows = ft.training_rows(docs, labels, id_col, text_col, label_col, learn, most).withColumn("part", F.pmod(F.xxhash64("text"), F.lit(2)))
    xs, ys = [], []
    for part in (0, 1):
        half = learn_lexicon(rows.where(F.col("part") != part))
        x, y = ft.sampled_features(rows.where(F.col("part") == part), lambda words, half=half: toxicity_features(words, half), most)
        if len(y):
            xs.append(x)
            ys.append(y)
    lexicon = learn_lexicon(rows)
    if not xs:
        return Model(lexicon, Boosted(np.zeros((0, 1)), np.zeros(0)), Isotonic(np.zeros(0), np.zeros(0)))
    x, y = np.concatenate(xs), np.concatenate(ys)
    fold, left_out = np.arange(len(y)) % 3, np.zeros(len(y))
    for k in range(3):
        if (fold == k).any() and (fold != k).any():
            left_out[fold == k] = Boosted(x[fold != k], y[fold != k]).margin(x[fold == k])
    return Model(lexicon, Boosted(x, y), Isotonic(left_out, y))


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a column score_col (double, 0 to 1; replaces one of that name)."""
    return ft.scored(docs, text_col, score_col, model.score)
