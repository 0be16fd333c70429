"""Exact top-k search by inner product: dual-tree cover-tree search.

Components become integers, floor(scale * x).  Vectors are packed into blocks,
and each block carries a cover tree: a node is a ball around one of its points,
its children cover it with balls of at most half the radius, and small or
incompressible nodes are leaves.  Queries are indexed in the same way.  A pair of
a query node and a data node is pruned when no inner product of the two balls,
|q||p| by centres and covering radii, can reach the worst kth score of the query
node's queries.  A task takes a block of queries through several data blocks and
keeps its scores, so later blocks are pruned by what earlier ones gave.

Every query meets every data block, as an exact search must; the pairs are of
blocks and are never listed by row.

Defined cases: vectors that ``vectors.usable`` rejects take no part; a query
with fewer than k candidates returns all; ties go to the smaller id; rows that
share an id count with their best score, and never for queries of that id; rows
with a null id take no part; of equal vectors, the k + 1 smallest ids of a block
suffice.  Products beyond 2**63 - 1 are given as that bound.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .kernels import released
from .vectors import block_count, matrix, packed, usable

LEAF = 96  # points of a leaf at most, unless they are one place
DATA_BLOCK, QUERY_BLOCK = 8192, 16384
EXACT = float(1 << 52)


class Tree:
    """A cover tree over rows of a matrix, which it puts in the order of its leaves."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.points, self.ids = points, ids
        self.nodes: list[tuple[np.ndarray, float, int, int, list[int]]] = []  # centre, radius, from, to, children
        order: list[np.ndarray] = []
        if len(ids):
            self._grow(np.arange(len(ids)), order)
            at = np.concatenate(order)
            self.points, self.ids = points[at], ids[at]

    def __getstate__(self) -> dict:
        """Points travel in the smallest type of whole numbers that holds them all."""
        small = next((t for t in (np.int16, np.int32) if len(self.ids) and np.abs(self.points).max() <= np.iinfo(t).max), None)
        return self.__dict__ | ({"points": self.points.astype(small)} if small else {})

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"points": state["points"].astype(np.float64)}

    def _grow(self, own: np.ndarray, order: list[np.ndarray]) -> int:
        """Add the node over the rows ``own``; its number."""
        x = self.points[own].astype(float)
        mean = x.mean(0)
        centre = x[np.argmin(((x - mean) ** 2).sum(1))]
        distance = np.sqrt(((x - centre) ** 2).sum(1))
        radius, start = float(distance.max()), sum(map(len, order))
        number = len(self.nodes)
        self.nodes.append((centre, radius, start, start + len(own), []))
        if len(own) <= LEAF or radius == 0:
            order.append(own)
            return number
        # Centres of the children: farthest points first, until all lie within half the radius or there are enough.
        most = max(2, -(-len(own) // LEAF))
        nearest, to = distance.copy(), np.zeros(len(own), int)
        count = 1
        while count < most and nearest.max() > radius / 2:
            far = int(np.argmax(nearest))
            d = np.sqrt(((x - x[far]) ** 2).sum(1))
            closer = d < nearest
            nearest[closer], to[closer] = d[closer], count
            count += 1
        sizes = np.bincount(to, minlength=count)
        if sizes.max() > 0.9 * len(own):  # balls do not part these points: cut them along the longest direction
            along = (x - mean) @ (x[np.argmax(distance)] - mean)
            halves = np.array_split(np.argsort(along, kind="stable"), 2)
        else:
            halves = [np.flatnonzero(to == i) for i in range(count)]
        self.nodes[number][4].extend(self._grow(own[h], order) for h in halves if len(h))
        return number


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, as int64."""
    if not len(q) or not len(p):
        return np.zeros((len(q), len(p)), np.int64)
    if np.abs(q).max() * np.abs(p).max() * q.shape[1] < EXACT:
        return (q @ p.T).astype(np.int64)
    whole = q.astype(object) @ p.astype(object).T  # far out of the usual range
    return np.vectorize(lambda x: max(-(1 << 63), min((1 << 63) - 1, int(x))), otypes=[np.int64])(whole)


class Search:
    """Best k candidates of each row of a query tree, over the data trees shown to it."""

    def __init__(self, tree: Tree, k: int):
        self.tree, self.k = tree, k
        self.worst = np.full(len(tree.ids), -np.inf)  # kth score so far
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(tree.ids)
        self.tested = 0

    def show(self, data: Tree) -> None:
        if self.tree.nodes and data.nodes and self.tree.points.shape[1] == data.points.shape[1]:
            self._pair(0, 0, data)

    def bound(self, q: tuple, data: Tree, children: list[int]) -> np.ndarray:
        """What no product of the query node with each of the data nodes exceeds."""
        centres = np.array([data.nodes[c][0] for c in children])
        radii = np.array([data.nodes[c][1] for c in children])
        most = centres @ q[0] + np.linalg.norm(q[0]) * radii + np.linalg.norm(centres, axis=1) * q[1] + q[1] * radii
        return most + 1e-9 * np.abs(most) + 1e-6

    def _pair(self, number: int, other: int, data: Tree) -> None:
        q, p = self.tree.nodes[number], data.nodes[other]
        if not q[4] and not p[4]:
            self._leaves(q, p, data)
        elif p[4] and (not q[4] or p[1] >= q[1]):
            most = self.bound(q, data, p[4])
            for i in np.argsort(-most).tolist():
                if most[i] >= self.worst[q[2] : q[3]].min():
                    self._pair(number, p[4][i], data)
        else:
            for child in q[4]:
                own = self.tree.nodes[child]
                if self.bound(own, data, [other])[0] >= self.worst[own[2] : own[3]].min():
                    self._pair(child, other, data)

    def _leaves(self, q: tuple, p: tuple, data: Tree) -> None:
        score = products(self.tree.points[q[2] : q[3]], data.points[p[2] : p[3]])
        self.tested += score.size
        ids = data.ids[p[2] : p[3]]
        good = score >= self.worst[q[2] : q[3], None]
        good &= ids[None, :] != self.tree.ids[q[2] : q[3], None]
        for i in np.flatnonzero(good.any(1)).tolist():
            held_score, held_id = self.best[q[2] + i]
            s, v = np.concatenate((held_score, score[i][good[i]])), np.concatenate((held_id, ids[good[i]]))
            order = np.lexsort((v, ~s))  # ~s falls as s rises, without overflow
            s, v = s[order], v[order]
            _, first = np.unique(v, return_index=True)
            keep = np.sort(first)[: self.k]
            self.best[q[2] + i] = s[keep], v[keep]
            if len(keep) == self.k:
                self.worst[q[2] + i] = s[keep][-1]


def tree_of(k: int, scale: float) -> Callable:
    def make(group: pa.Table) -> dict:
        points = np.floor(scale * matrix(group.column("vector")))
        ids = group.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        points, ids = np.ascontiguousarray(points[order]) + 0.0, ids[order]
        _, place = np.unique(points.view(np.dtype((np.void, points.itemsize * points.shape[1]))).ravel(), return_inverse=True)
        # of one place, the k + 1 smallest distinct ids
        by = np.lexsort((ids, place))
        new_place = np.concatenate(([True], place[by][1:] != place[by][:-1]))
        new_id = new_place | np.concatenate(([True], ids[by][1:] != ids[by][:-1]))
        nth = np.cumsum(new_id)
        nth = nth - np.maximum.accumulate(np.where(new_place, nth, 0))
        keep = np.sort(by[new_id & (nth <= k)]) if k else np.sort(by[new_id])
        return {"tree": pickle.dumps(Tree(points[keep], ids[keep]), protocol=5)}

    return make


def searcher(k: int) -> Callable:
    """Rows (q, share, length, p, tree), sorted by the first four, the tree of queries first with p = -1 -> (query_id, vec_id, score)."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, search = None, None

        def results() -> pa.RecordBatch:
            counts = [len(s) for s, _ in search.best]
            return pa.RecordBatch.from_pydict({"query_id": np.repeat(search.tree.ids, counts), "vec_id": np.concatenate([v for _, v in search.best]), "score": np.concatenate([s for s, _ in search.best])})

        for batch in batches:
            for i in range(batch.num_rows):
                key = tuple(batch.column(c)[i].as_py() for c in ("q", "share", "length"))
                if key != last:
                    if search:
                        yield results()
                    last, search = key, None
                tree = batch.column("tree")[i].as_buffer
                if batch.column("p")[i].as_py() < 0:
                    search = Search(pickle.loads(tree()), k)
                elif search:  # no queries of this length in the block, if there is none
                    search.show(pickle.loads(tree()))
        if search:
            yield results()

    return run


def top_k(data: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK, shares: int = 64) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of the rows that ``is_query`` marks, against all other rows.

    Up to ``shares`` tasks share the data blocks of one block of queries; each
    returns at most k candidates of a query.  The shuffle is the table's size times
    the number of query blocks.
    """
    rows = data.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.size(vector_col).alias("length"), F.coalesce(is_query, F.lit(False)).alias("query"))
    counted = rows.agg(F.count("*"), F.count_if("query")).first()
    n_data, n_query = block_count(counted[0], data_block), block_count(counted[1], query_block)
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    index = packed(rows.withColumn("p", place(n_data)), ["p", "length"], tree_of(k, scale), "p int, length int, tree binary")
    asked = packed(rows.where("query").withColumn("q", place(n_query)), ["q", "length"], tree_of(0, scale), "q int, length int, tree binary")
    # Every data block goes to every query block, by number, and a query block once to each share: no tree is joined with another,
    # so none can be broadcast, and the tree of a query block isn't sent once for each data block.
    shares = max(1, min(shares, n_data))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sent = index.withColumn("share", F.pmod("p", F.lit(shares))).withColumn("q", each(n_query)).select("q", "share", "length", "p", "tree")
    sent = sent.unionByName(asked.withColumn("share", each(shares)).select("q", "share", "length", F.lit(-1).alias("p"), "tree"))
    found = sent.repartition(max(1, min(n_query * shares, 10_000)), "q", "share", "length").sortWithinPartitions("q", "share", "length", "p").mapInArrow(searcher(k), "query_id long, vec_id long, score long")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
