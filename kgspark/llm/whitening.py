"""Embedding whitening: vectors on their principal components, each scaled to variance one.

Sums of all dimensions, and then of the centred products of every pair of
dimensions (the upper triangle of the covariance), are Spark SQL expressions
generated for one aggregation each; only their d + d * (d + 1) / 2 results
reach the driver, where LAPACK decomposes the covariance.  Projections are
generated expressions as well.

A component c counts as the whole number floor(unit * c) + shift.  Defined
cases: vectors that are null, empty, or hold null or non-finite entries take no
part and have no rows; vectors of different lengths are fitted apart; repeated
rows count and return each for itself; a null id is kept; an empty table gives
no rows; components without variance (a single vector, equal vectors, dependent
dimensions) are 0 in ``whitened`` and left out of ``identity_error``; columns
beyond those named are ignored.  Entries beyond 2^40 in absolute value are
an error (an overflow), as their exact sums would have none of the types.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .vectors import usable

UNIT, SHIFT = 1024, 100_000
COMPONENTS = 8
PAIRS_AT_ONCE = 8192  # expressions of one aggregation; longer vectors take several
FLAT = 1e-12  # of the largest eigenvalue: less is no variance

SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass
class Fit:
    n: int
    sums: list[int]  # of each dimension
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors, a column each

    @property
    def trace(self) -> float:
        return float(np.sum(self.values))

    def live(self, k: int) -> bool:
        return bool(self.values[k] > FLAT * max(float(self.values[0]), 0.0)) and self.values[k] > 0


def whole(vectors: DataFrame, id_col: str, vector_col: str, unit: int, shift: int) -> DataFrame:
    """(vec_id, x): usable vectors as whole numbers."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("v")).where(usable(F.col("v")))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(F.lit(float(unit)) * c.cast("double")) + F.lit(shift).cast("long")).alias("x"))


def spread(rows: DataFrame, size: int, *keep: str) -> DataFrame:
    """Dimensions as columns x0, x1, ..."""
    return rows.selectExpr(*keep, *[f"x[{i}] AS x{i}" for i in range(size)])


def covariance(rows: DataFrame, size: int, n: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor n, centred before multiplying."""
    # (no entry is null; said in the expression, it halves the time of the sums)
    centred = spread(rows, size).selectExpr(*[f"coalesce(double(x{i}) - {s / n!r}D, 0D) AS d{i}" for i, s in enumerate(sums)])
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    out = np.zeros((size, size))
    for at in range(0, len(pairs), PAIRS_AT_ONCE):
        part = pairs[at : at + PAIRS_AT_ONCE]
        got = centred.selectExpr(*[f"sum(d{i} * d{j}) AS s{k}" for k, (i, j) in enumerate(part)]).first()
        for (i, j), s in zip(part, got, strict=True):
            out[i, j] = out[j, i] = s / n
    return out


def fit(rows: DataFrame, size: int) -> Fit:
    """Of rows (x) that all have ``size`` dimensions, at least one row."""
    n, *sums = spread(rows, size).selectExpr("count(*)", *[f"sum(decimal(x{i}))" for i in range(size)]).first()
    sums = [int(s) for s in sums]
    values, vectors = np.linalg.eigh(covariance(rows, size, n, sums))
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(size)])
    return Fit(n, sums, values, vectors * signs)


def projected(rows: DataFrame, own: Fit, components: int) -> DataFrame:
    """rows with w0, w1, ...: the whitened components."""
    size = len(own.sums)
    parts = []
    for k in range(components):
        weights = own.vectors[:, k] / np.sqrt(own.values[k]) if own.live(k) else []
        terms = [f"(double(x{i}) - {own.sums[i] / own.n!r}D) * {float(w)!r}D" for i, w in enumerate(weights)]
        parts.append(f"{' + '.join(terms) if terms else '0D'} AS w{k}")
    return spread(rows, size, "vec_id", "x").selectExpr("vec_id", "x", *parts)


def identity_error(rows: DataFrame, own: Fit, components: int) -> float:
    """The largest entry by which the covariance of the whitened rows differs from the identity."""
    live = [k for k in range(components) if own.live(k)]
    if not live:
        return 0.0
    pairs = [(i, j) for i in live for j in live if i <= j]
    got = rows.selectExpr(*[f"covar_pop(w{i}, w{j}) AS c{k}" for k, (i, j) in enumerate(pairs)]).first()
    return max(abs(c - (i == j)) for (i, j), c in zip(pairs, got, strict=True))


def deviation(own: Fit) -> Column:
    """The exact sum over the dimensions of (n * x - S)^2."""
    whole = lambda v, digits: v.cast(f"decimal({digits},0)")
    off = F.zip_with("x", F.array(*[whole(F.lit(s), 19) for s in own.sums]), lambda x, s: whole(whole(F.lit(own.n), 18) * whole(x, 18) - s, 19))
    return F.aggregate(off, whole(F.lit(0), 38), lambda total, d: whole(total + d * d, 38))


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", unit: int = UNIT, shift: int = SHIFT, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and each of its first components: SCHEMA.

    deviation: the exact sum over dimensions of (n * x - S)^2, S the dimension's sum; explained: the share of the
    trace; identity_error: of the whole fit.  Lengths are fitted one after the other.
    """
    rows = whole(vectors, id_col, vector_col, unit, shift)
    sizes = sorted(r[0] for r in rows.select(F.size("x")).distinct().collect())
    parts = []
    for size in sizes:
        own_rows = rows.where(F.size("x") == size)
        own, count = fit(own_rows, size), min(components, size)
        flat = projected(own_rows, own, count)
        error = identity_error(flat, own, count)
        shares = [float(v / own.trace) if own.trace > 0 else 0.0 for v in own.values[:count]]
        each = F.inline(F.array(*[F.struct(F.lit(k + 1).alias("component"), F.col(f"w{k}").alias("whitened"), F.lit(s).alias("explained")) for k, s in enumerate(shares)]))
        out = flat.select("vec_id", deviation(own).alias("deviation"), *[f"w{k}" for k in range(count)]).select("vec_id", "deviation", each)
        parts.append(out.select("vec_id", "component", F.lit(own.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(float(error)).alias("identity_error")))
    if not parts:
        id_type = vectors.schema[id_col].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], SCHEMA.replace("vec_id long", f"vec_id {id_type}"))
    return reduce(DataFrame.unionByName, parts)
