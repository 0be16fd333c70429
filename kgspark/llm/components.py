"""Connected components by alternating star contractions on DataFrames.

Edges never reach the driver.  Each partition first replaces its edges by a
star forest (local union-find), which also shortens paths; then large-star and
small-star steps alternate until the edges no longer change.  Every round is a
written table of few files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from . import shared

EDGE = "u long, v long"
FILE_ROWS = 500_000  # edges of a file of a round


def star_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) rows with the same components as the partition's edges."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_pydict({"u": pa.array(part, pa.int64()), "v": pa.array([root(x) for x in part], pa.int64())})


def to_least(rows: DataFrame) -> DataFrame:
    """(u, v, m) -> the edges (v, m) and (u, m).  Rows are exploded, not united, so no partitioning is taken over."""
    pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    return rows.select(F.inline(pairs)).where("u is not null and u <> v")


def components(edges: DataFrame, name: str = "components", rounds: int = 500) -> DataFrame:
    """edges (u, v: long, not null) -> (node, component), component the smallest node reachable.

    Nodes without an edge are absent.  Self-loops, repeated edges and an empty
    table are fine.  The result reads a table in the shared folder.
    """
    # Kept first: a stage that runs two Python functions at once has twice the workers.
    given = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").persist(StorageLevel.MEMORY_AND_DISK)
    parts = max(1, given.count() // FILE_ROWS)
    state = shared.written(given.mapInArrow(star_forest, EDGE).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().coalesce(parts), name)
    given.unpersist()
    mark = None
    for _ in range(rounds):
        both = state.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above u, and u itself, to the least around u
        large = to_least(both.where("v > u").join(low, "u", "right")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        # small star: neighbours below u, and u itself, to the least of them
        small = to_least(down.join(down.groupBy("u").agg(F.min("v").alias("m")), "u"))
        after = shared.written(small.mapInArrow(star_forest, EDGE).distinct().coalesce(parts), name)
        shared.drop(state)
        state = after
        now = tuple(state.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return state.select(F.col("u").alias("node"), F.col("v").alias("component"))
