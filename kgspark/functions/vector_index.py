"""Exact cosine search over inverted lists.

Centres are fitted on a bounded sample; every vector is listed at its nearest
centre, and a list knows the largest angle of its vectors to its centre.  No
vector of a list is nearer to a query than the query's angle to the centre less
that angle.  A query first looks through the lists of the nearest centres, until
it has seen enough vectors; then through every list whose bound does not exceed
its k-th best so far.  So the result is that of comparing with all vectors,
however good the centres are.

A vector takes part if it is not null or empty, its components are finite
numbers, and one of them is not 0; vectors of different lengths are never
compared.  Ties (distances equal to 12 digits) go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources import scratch

SAMPLE = 20_000  # vectors on which the centres are fitted
LISTED = 512  # vectors of a list, about
MOST_LISTS = 1024  # of one length; longer lists are compared in blocks
BLOCK = 2048  # vectors, or queries, that a task compares at once
SEEN = 4  # times k: vectors that a query looks through at first
SLACK = 1e-7  # radians by which a bound is loosened, against rounding


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False)) & F.coalesce(some, F.lit(False))


def units(vectors: np.ndarray) -> np.ndarray:
    """Scaled to length 1; very small and very large ones too."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def centres(sample: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """Directions that the sample lies around; n at most."""
    out = sample[:: max(1, len(sample) // n)][:n].copy()
    for _ in range(rounds):
        nearest = (sample @ out.T).argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, nearest, sample)
        some = np.abs(sums).max(1) > 1e-9
        out[some] = units(sums[some])
    return out


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


@dataclass
class Index:
    """lists: written table (list, block, id, v), v scaled; table: the lists' (list, length, radius, n); centre: length -> matrix."""

    lists: DataFrame
    centre: dict[int, np.ndarray]
    first: dict[int, int]  # length -> number of its first list
    radius: np.ndarray
    size: np.ndarray

    @property
    def total(self) -> int:
        return int(self.size.sum())


def build(vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> Index:
    """The index of all usable vectors."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(usable(F.col("v"))).select("id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    counts = dict(map(tuple, rows.groupBy(F.size("v").alias("length")).count().collect()))
    drawn = rows.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).select("v").toArrow().column("v").to_pylist() if counts else []
    centre, first, at = {}, {}, 0
    for length in sorted(counts):
        own = [v for v in drawn if len(v) == length]  # (a length that the sample lacks has one list, around any direction)
        n = max(1, min(MOST_LISTS, counts[length] // LISTED))
        centre[length] = centres(units(np.array(own)), n) if own else np.eye(1, length)
        first[length], at = at, at + len(centre[length])
    blocks = {length: max(1, -(-counts[length] // (BLOCK * len(c)))) for length, c in centre.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column("v").value_lengths())
            for length in np.unique(lengths).tolist():
                own = batch.filter(pa.array(lengths == length))
                v = units(matrix(own.column("v")))
                angle = angles(v, centre[length])
                nearest = angle.argmin(1)
                where = (first[length] + nearest).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(where), own.column("id"), pa.array(list(v), pa.list_(pa.float64())), pa.array(angle[np.arange(len(v)), nearest])], ["list", "id", "v", "angle"])

    kind = rows.schema["id"].dataType.simpleString()
    listed = rows.mapInArrow(assign, f"list int, id {kind}, v array<double>, angle double")
    path = scratch.new_folder(vectors.sparkSession, "lists")
    listed.write.parquet(path)
    listed = vectors.sparkSession.read.schema(listed.schema).parquet(path)
    radius, size = np.zeros(at), np.zeros(at, np.int64)
    for r in listed.groupBy("list").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect():  # a row for each list
        radius[r.list], size[r.list] = r.radius, r.n
    return Index(listed.drop("angle"), centre, first, radius, size)


def compared(lists: DataFrame, asked: DataFrame, size: np.ndarray, k: int) -> DataFrame:
    """(query_id, id, distance): of each asked (query_id, q, list), the k nearest of each block of the list."""
    numbers = lists.sparkSession.createDataFrame([(i, max(1, -(-n // BLOCK))) for i, n in enumerate(size.tolist())], "list int, blocks int")
    load = asked.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).join(F.broadcast(numbers), "list")  # a row for each list
    load = F.broadcast(load)
    ours = lists.join(load, "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select("list", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "v")
    theirs = asked.join(load, "list").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "part", "query_id", "q")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        v, q = matrix(left.column("v")), matrix(right.column("q"))
        ids, names = left.column("id").to_pylist(), right.column("query_id")
        out: list[tuple[int, object, float]] = []
        if len(v) and len(q):
            near = v @ q.T
            for j in range(len(q)):
                own = near[:, j]
                least = np.partition(own, -k)[-k] if len(own) > k else -2.0
                some = np.flatnonzero(own >= least - 1e-9)
                # a sum that depends on the two vectors alone, not on their places
                exact = np.round(1.0 - (v[some] * q[j]).sum(1), 12) + 0.0
                out += [(j, i, d) for d, i in sorted(zip(exact.tolist(), (ids[x] for x in some.tolist()), strict=True))[:k]]
        return pa.table([names.take(pa.array([o[0] for o in out], pa.int64())), pa.array([o[1] for o in out], left.schema.field("id").type), pa.array([o[2] for o in out], pa.float64())], ["query_id", "id", "distance"])

    kinds = asked.schema["query_id"].dataType.simpleString(), lists.schema["id"].dataType.simpleString()
    keys = ["list", "block", "part"]
    return ours.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInArrow(best, f"query_id {kinds[0]}, id {kinds[1]}, distance double")


def search(index: Index, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """((query_id, rank, id, distance), (query_id, compared)): the k nearest of each usable query (query_id, query), and
    how many vectors it was compared with."""
    spark = queries.sparkSession
    rows = queries.select("query_id", "query").where(usable(F.col("query"))).select("query_id", F.transform("query", lambda x: x.cast("double")).alias("q"))
    centre, first, radius, size = index.centre, index.first, index.radius, index.size
    kind = rows.schema["query_id"].dataType.simpleString()

    def lists_of(q: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the length's lists, and for each query their angles and least possible angles."""
        numbers = first[length] + np.arange(len(centre[length]))
        angle = angles(q, centre[length])
        return numbers, angle, np.maximum(0.0, angle - radius[numbers] - SLACK)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists that a query looks through: without ``reach``, those of the nearest centres; with it, all others within reach."""
        for batch in batches:
            lengths = np.asarray(batch.column("q").value_lengths())
            for length in np.unique(lengths).tolist():
                if length not in centre:
                    continue
                own = batch.filter(pa.array(lengths == length))
                q = units(matrix(own.column("q")))
                numbers, angle, bound = lists_of(q, length)
                order = np.argsort(angle, 1, kind="stable")
                before = np.cumsum(size[numbers][order], 1) - size[numbers][order]
                near = np.zeros(angle.shape, bool)
                np.put_along_axis(near, order, before < SEEN * k, 1)
                if "reach" in batch.schema.names:
                    reach = own.column("reach").to_numpy(zero_copy_only=False)  # (null, here NaN: fewer than k were seen)
                    near = ~near & ~(bound > np.where(np.isnan(reach), np.pi, reach)[:, None])
                near &= size[numbers] > 0
                who, which = np.nonzero(near)
                for a in range(0, len(who), 4096):
                    part = who[a : a + 4096]
                    yield pa.RecordBatch.from_arrays([own.column("query_id").take(pa.array(part)), pa.array(list(q[part]), pa.list_(pa.float64())), pa.array(numbers[which[a : a + 4096]].astype(np.int32))], ["query_id", "q", "list"])

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch.new_folder(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    schema = f"query_id {kind}, q array<double>, list int"
    early = stored(rows.mapInArrow(ask, schema), "asked")
    found = stored(compared(index.lists, early, size, k), "found")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    worst = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", F.acos(F.greatest(F.lit(-1.0), F.lit(1.0) - F.col("distance"))).alias("reach"))
    late = stored(rows.join(worst, "query_id", "left").select("query_id", "q", "reach").mapInArrow(ask, schema), "asked")
    more = stored(compared(index.lists, late, size, k), "found")
    ranked = found.unionByName(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
    sizes = F.broadcast(spark.createDataFrame(list(enumerate(size.tolist())), "list int, n long"))
    work = early.select("query_id", "list").unionByName(late.select("query_id", "list")).join(sizes, "list").groupBy("query_id").agg(F.sum("n").alias("compared"))
    return ranked, work
