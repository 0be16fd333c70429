"""Embedding near-dedup: PCA-ordered tiled comparison.

Equal vectors are one node.  A rotation to principal axes, fitted on a bounded
sample, puts the directions of large variance first; a rotation keeps cosines,
so the sample never affects the result.  Nodes are packed into blocks of nearby
vectors (cells along the leading axes).  A pair of blocks is skipped when the
angle of their centres exceeds their angular radii and the threshold's angle, and
so are whole pairs of cells, so that blocks are only paired within pairs of cells.
In a tile the leading coordinates are multiplied first, and Cauchy-Schwarz on
the norms of the rest bounds the cosine; pairs that can still reach the
threshold get more coordinates and then the cosine of the given components in
double precision.

A tile returns link counts by node and a spanning forest of its links, never its
pairs; components of the forests are the classes.

Defined cases: vectors that ``vectors.usable`` rejects and zero vectors link with
nothing and are their own class; repeated rows are linked with one another;
vectors of other lengths are never compared; a null id is kept, and is greater
than any other for the choice of a class's id; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import shared
from .components import components
from .kernels import released
from .vectors import block_count, matrix, packed, usable

SAMPLE = 5_000  # vectors that the rotation and the cells are fitted on
LEAST_SAMPLE = 50  # of a length; rarer lengths are compared without a rotation, in one cell
BLOCK = 4096
TILE = 512
STRIP_BYTES = 32 << 20  # of the blocks that a task holds, about; every other block that meets one of them is sent to it once
SHARES = 8  # tasks that share the other blocks of a strip
SLACK = 1e-5  # for products in single precision


def axes_of(sample: np.ndarray, length: int) -> np.ndarray:
    """Principal axes as columns, by falling variance."""
    if len(sample) < 2:
        return np.eye(length)
    _, axes = np.linalg.eigh(np.cov(sample.T).reshape(length, length))
    return np.ascontiguousarray(axes[:, ::-1])


def median_cuts(sample: np.ndarray, depth: int) -> list[float]:
    """Cuts of a complete binary tree, level l along axis l, at the sample's medians."""
    cuts = [0.0] * (2**depth - 1)
    own = {0: sample}
    for node in range(len(cuts)):
        axis = (node + 1).bit_length() - 1
        part = own.pop(node)
        cuts[node] = float(np.median(part[:, axis])) if len(part) else 0.0
        right = part[:, axis] > cuts[node]
        own[2 * node + 1], own[2 * node + 2] = part[~right], part[right]
    return cuts


def cell_of(x: np.ndarray, cuts: list[float], depth: int) -> np.ndarray:
    cut, node = np.array(cuts), np.zeros(len(x), int)
    for axis in range(depth):
        node = 2 * node + 1 + (x[:, axis] > cut[node])
    return node - (2**depth - 1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows brought near 1 by powers of two: cosines stay, and squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) if len(x) else x


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Tile:
    """Two blocks compared: counts of links by row of each, and a forest of links."""

    def __init__(self, left: tuple, right: tuple, axes: np.ndarray, least: float, same: bool):
        self.a, self.b, self.least, self.same = left, right, least, same  # (names, weights, vectors)
        self.x, self.y = (unit(v[2]) for v in (left, right))
        length = axes.shape[0]
        self.cuts = [c for c in (min(16, length), min(32, length), length) if c]
        self.ra, self.rb = (self.x @ axes).astype(np.float32), (self.y @ axes).astype(np.float32)
        suffix = lambda r: [np.sqrt(np.maximum(0, (r[:, c:].astype(float) ** 2).sum(1))).astype(np.float32) for c in self.cuts]
        self.sa, self.sb = suffix(self.ra), suffix(self.rb)
        self.count_a, self.count_b = np.zeros(len(self.x), np.int64), np.zeros(len(self.y), np.int64)
        self.group = np.arange(len(self.x) + (0 if same else len(self.y)))
        self.links: list[tuple[int, int]] = []

    def run(self) -> None:
        for i in range(0, len(self.x), TILE):
            for j in range(i if self.same else 0, len(self.y), TILE):
                self._part(slice(i, i + TILE), slice(j, j + TILE), self.same and i == j)

    def _part(self, i: slice, j: slice, diagonal: bool) -> None:
        first = self.cuts[0]
        open_ = self.ra[i, :first] @ self.rb[j, :first].T + np.outer(self.sa[0][i], self.sb[0][j]) >= self.least - SLACK
        if diagonal:
            open_ = np.triu(open_, 1)
        if not open_.any():
            return
        if open_.mean() > 0.05:
            found = np.argwhere(open_ & (self.x[i] @ self.y[j].T >= self.least - 1e-12))
            r, c = found[:, 0] + i.start, found[:, 1] + j.start
        else:
            found = np.argwhere(open_)
            r, c = found[:, 0] + i.start, found[:, 1] + j.start
            for k in range(1, len(self.cuts) - 1):
                cut = self.cuts[k]
                keep = np.einsum("ij,ij->i", self.ra[r, :cut], self.rb[c, :cut]) + self.sa[k][r] * self.sb[k][c] >= self.least - SLACK
                r, c = r[keep], c[keep]
        keep = np.zeros(len(r), bool)
        for at in range(0, len(r), 65_536):
            p, q = self.a[2][r[at : at + 65_536]], self.b[2][c[at : at + 65_536]]
            dot, pp, qq = (np.einsum("ij,ij->i", u, v) for u, v in ((p, q), (p, p), (q, q)))
            keep[at : at + 65_536] = dot / (np.sqrt(pp) * np.sqrt(qq)) >= self.least
        r, c = r[keep], c[keep]
        if not len(r):
            return
        self.count_a += np.bincount(r, self.b[1][c], len(self.x)).astype(np.int64)
        (self.count_a if self.same else self.count_b)[:] += np.bincount(c, self.a[1][r], len(self.y)).astype(np.int64)
        c = c if self.same else c + len(self.x)
        group = self.group
        apart = group[r] != group[c]
        while apart.any():  # join what is not yet joined, one link of a pair of groups at a time
            r, c = r[apart], c[apart]
            u, v = int(r[0]), int(c[0])
            self.links.append((u, v))
            group[group == group[v]] = group[u]
            apart = group[r] != group[c]


def compare(axes: dict[int, np.ndarray], least: float) -> Callable:
    """Rows (strip, share, side, block, length, partners, names, weights, data), sorted by the first three -> (u, v, links).

    Blocks of side 0 are held; one of side 1 is compared with its partners among them.
    """

    def compared(length: int, left: tuple, right: tuple, same: bool) -> pa.RecordBatch:
        own = axes.get(length)
        tile = Tile(left, right, np.eye(length) if own is None else own, least, same)
        tile.run()
        names = left[0] if same else np.concatenate((left[0], right[0]))
        counts = tile.count_a if same else np.concatenate((tile.count_a, tile.count_b))
        some = np.flatnonzero(counts)
        u = np.concatenate((names[some], names[[p for p, _ in tile.links]] if tile.links else names[:0]))
        v = pa.array([None] * len(some) + [int(names[q]) for _, q in tile.links], pa.int64())
        return pa.RecordBatch.from_pydict({"u": u, "v": v, "links": np.concatenate((counts[some], np.zeros(len(tile.links), np.int64)))})

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place = {}, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if (row["strip"], row["share"]) != place:
                    held, place = {}, (row["strip"], row["share"])
                own = (np.frombuffer(row["names"], np.int64), np.frombuffer(row["weights"], np.int64), np.frombuffer(row["data"], np.float64).reshape(-1, row["length"]))
                if row["side"] == 0:
                    held[row["block"]] = own
                else:
                    for a in row["partners"]:
                        yield compared(row["length"], held[a], own, a == row["block"])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row."""
    vector = F.col(vector_col)
    zero = ~F.exists(vector, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.when(usable(vector) & ~zero, F.transform(vector, lambda x: x.cast("double"))).alias("vector"))
    rows = rows.withColumn("name", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))
    nodes = rows.where("name is not null").groupBy("name").agg(F.first("vector").alias("vector"), F.count("*").alias("weight")).withColumn("length", F.size("vector"))
    nodes = shared.written(nodes, "nodes")
    total = nodes.count()
    seen = nodes.orderBy("name").limit(sample).select("length", "vector").toArrow()
    depth = min(10, max(0, (block_count(total, block) - 1).bit_length()))
    axes, cuts = {}, {}
    for length in pc.unique(seen.column("length")).to_pylist():
        own = matrix(seen.filter(pc.equal(seen.column("length"), length)).column("vector"))
        if len(own) >= LEAST_SAMPLE:
            own = unit(own)
            axes[length] = axes_of(own, length)
            cuts[length] = median_cuts(own @ axes[length], min(depth, length))

    def with_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            for length in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == length))
                cell = np.zeros(part.num_rows, int)
                if length in axes:
                    cell = cell_of(unit(matrix(part.column("vector"))) @ axes[length], cuts[length], min(depth, length))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int64())], [*part.schema.names, "cell"])

    celled = shared.written(nodes.mapInArrow(with_cell, "name long, vector array<double>, weight long, length int, cell long"), "cells")
    shared.drop(nodes)
    counts = celled.groupBy("length", "cell").agg(F.count("*").alias("n"))  # at most 1024 cells for each length
    parts = counts.select("length", "cell", F.ceil(F.col("n") / block).alias("parts"))
    celled = celled.join(F.broadcast(parts), ["length", "cell"])
    celled = celled.withColumn("block", F.xxhash64("length", "cell", F.pmod("name", "parts")))

    def ball(u: np.ndarray, angles: np.ndarray | float) -> dict:
        centre = u.sum(0)
        norm = np.linalg.norm(centre)
        centre = centre / norm if norm > 0 else u[0]
        return {"centre": centre.tolist(), "angle": float((np.arccos(np.clip(u @ centre, -1, 1)) + angles).max())}

    def pack(group: pa.Table) -> dict:
        x = scaled(matrix(group.column("vector")))
        return {"names": group.column("name").to_numpy().tobytes(), "weights": group.column("weight").to_numpy().tobytes(), "data": x.tobytes()} | ball(unit(x), 0.0)

    blocks = packed(celled.select("block", "length", "cell", "name", "weight", "vector"), ["block", "length", "cell"], pack, "block long, length int, cell long, names binary, weights binary, data binary, centre array<double>, angle double")
    blocks = shared.written(blocks, "blocks")
    # Pairs of cells that can meet (of at most 1024 cells of a length), then the pairs of their blocks.
    stats = blocks.select("block", "length", "cell", "centre", "angle")
    cells = packed(stats, ["length", "cell"], lambda group: ball(matrix(group.column("centre")), group.column("angle").to_numpy()), "length int, cell long, centre array<double>, angle double")
    cells = shared.written(cells, "balls")
    side = lambda df, s, *names: df.select("length", *[F.col(c).alias(f"{s}_{c}") for c in names])
    product = F.aggregate(F.zip_with("a_centre", "b_centre", lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    reach = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), product))) <= F.col("a_angle") + F.col("b_angle") + float(np.arccos(least)) + 1e-6
    ball_of = ("cell", "centre", "angle")
    met = side(cells, "a", *ball_of).join(side(cells, "b", *ball_of), "length").where((F.col("a_cell") <= F.col("b_cell")) & (reach | (F.col("a_cell") == F.col("b_cell")))).select("length", "a_cell", "b_cell")
    pairs = met.join(side(stats, "a", "block", *ball_of), ["length", "a_cell"]).join(side(stats, "b", "block", *ball_of), ["length", "b_cell"])
    pairs = pairs.where((F.col("a_cell") < F.col("b_cell")) | (F.col("a_block") <= F.col("b_block"))).where(reach | (F.col("a_block") == F.col("b_block"))).select("length", "a_block", "b_block")
    pairs = shared.written(pairs, "pairs")
    # Blocks a are dealt to strips that a task holds, blocks b are sent to the strips that they meet, not to each block of these.
    strips = block_count(blocks.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0], STRIP_BYTES)
    dealt = pairs.select(F.pmod(F.xxhash64("a_block"), F.lit(strips)).alias("strip"), F.pmod(F.xxhash64("b_block", F.lit(1)), F.lit(SHARES)).alias("share"), "a_block", "b_block")
    lefts = dealt.select("strip", "share", F.lit(0).alias("side"), F.col("a_block").alias("block")).distinct().withColumn("partners", F.lit(None).cast("array<long>"))
    rights = dealt.groupBy("strip", "share", F.lit(1).alias("side"), F.col("b_block").alias("block")).agg(F.collect_list("a_block").alias("partners"))
    wanted = shared.written(lefts.unionByName(rights), "wanted")
    shared.drop(pairs)
    sent = wanted.join(blocks.select("block", "length", "names", "weights", "data"), "block").select("strip", "share", "side", "block", "length", "partners", "names", "weights", "data")
    sent = sent.repartition(max(1, min(10_000, strips * SHARES)), "strip", "share").sortWithinPartitions("strip", "share", "side")
    found = shared.written(sent.mapInArrow(compare(axes, least), "u long, v long, links long"), "links")
    classes = components(found.where("v is not null"), "vectors").withColumnRenamed("node", "name")
    linked = found.where("v is null").groupBy(F.col("u").alias("name")).agg(F.sum("links").alias("others"))
    weights = celled.select("name", "weight").join(classes, "name", "left").join(linked, "name", "left")
    named = rows.select("id", "name").join(weights, "name", "left").withColumn("class", F.coalesce("component", "name"))
    least_id = named.where("class is not null").groupBy("class").agg(F.min("id").alias("least_id"))
    out = named.join(least_id, "class", "left")
    own = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("least_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce(F.col("others") + F.col("weight") - 1, F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))
