"""All pairs of an anchor and a partner that share nodes, with the number of these, without shuffling pairs.

A node that anchors and partners point at is a hub.  Partners are numbered, and
the members of a hub travel as lists of differences of numbers, cut by ranges of
RANGE numbers, so that no list grows with its hub.  All lists of an anchor and a
range meet in one task, which counts them and names their partners; work and
result grow with the pairs, the shuffle with edges and lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .draws import numbered, written

RANGE = 1 << 18  # partners whose names are in one list
BLOCKS = 64  # tasks that share the anchors of a range
ROWS = 200_000  # rows of a batch of results, about
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
FOUND = "anchor string, partner string, overlap int"


def members(steps: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers within the range, of all rows, and the length of each row."""
    lengths = np.diff(steps.offsets.to_numpy())
    flat = steps.flatten().to_numpy().astype(np.int64)
    run = np.cumsum(flat)
    starts = np.cumsum(lengths) - lengths
    base = np.where(lengths > 0, run[np.minimum(starts, max(len(run) - 1, 0))] - flat[np.minimum(starts, max(len(run) - 1, 0))], 0) if len(run) else np.zeros(len(lengths), np.int64)
    return run - np.repeat(base, lengths), lengths


def counter(low: int, high: int | None) -> Callable:
    """Rows (range, block, anchor, steps, names) sorted by the first three, names first with a null anchor -> FOUND."""

    def counted(anchors: list[str], group: np.ndarray, number: np.ndarray, names: pa.Array) -> Iterator[pa.RecordBatch]:
        key, n = np.unique(group * RANGE + number, return_counts=True)
        keep = n >= low if high is None else (n >= low) & (n <= high)
        key, n = key[keep], n[keep]
        own = pa.array(anchors, pa.string())
        for i in range(0, len(key), ROWS):
            at = key[i : i + ROWS]
            out = pa.RecordBatch.from_arrays([own.take(pa.array(at // RANGE)), names.take(pa.array(at % RANGE)), pa.array(n[i : i + ROWS].astype(np.int32))], ["anchor", "partner", "overlap"])
            yield out.filter(pc.not_equal(out.column(0), out.column(1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, place = None, None
        held: tuple[str, list[np.ndarray]] | None = None  # an anchor whose lists may go on in the next batch

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                number = np.concatenate(held[1])
                yield from counted([held[0]], np.zeros(len(number), np.int64), number, names)

        for batch in batches:
            where = batch.column("range").to_numpy() * BLOCKS + batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if not part.num_rows:
                    continue
                if where[a] != place:
                    yield from close()
                    held, place = None, where[a]
                    lists = part.column("names")
                    names = pa.concat_arrays([lists.slice(0, 1).flatten()])
                    part = part.slice(1)
                    if not part.num_rows:
                        continue
                number, lengths = members(pa.concat_arrays([part.column("steps")]))
                coded = part.column("anchor").dictionary_encode()
                anchors, row = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
                group = np.repeat(row, lengths)
                if held and held[0] != anchors[0]:
                    yield from close()
                    held = None
                last = row[-1]
                if held and last == 0:
                    held[1].append(number)
                    continue
                if held:
                    number, group = np.concatenate([*held[1], number]), np.concatenate([np.zeros(sum(map(len, held[1])), np.int64), group])
                done = group != last
                if done.any():
                    yield from counted(anchors, group[done], number[done], names)
                held = anchors[last], [number[~done]]
        yield from close()

    return run


def pairs(left: DataFrame, right: DataFrame, low: int = 1, high: int | None = None) -> DataFrame:
    """(anchor, partner, overlap): all pairs that share low to high nodes; left (anchor, x) and right (partner, x) are distinct edges."""
    spark = left.sparkSession
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    right = written(right, "right")
    names = written(numbered(right.select("partner").distinct(), "partner").select("partner", "number", F.floor(F.col("number") / RANGE).alias("range")), "partners")
    numbers = right.join(names, "partner").select("x", "range", (F.col("number") % RANGE).cast("int").alias("number"))
    lists = numbers.groupBy("x", "range").agg(F.array_sort(F.collect_list("number")).alias("m"))
    lists = lists.select("x", "range", F.zip_with("m", F.concat(F.array(F.lit(0)), F.slice("m", 1, F.size("m") - 1)), lambda n, before: n - before).alias("steps"))
    block = F.pmod(F.xxhash64("anchor"), F.lit(BLOCKS)).cast("long")
    asked = left.join(lists, "x").select("range", block.alias("block"), "anchor", "steps", F.lit(None).cast("array<string>").alias("names"))
    ordered = names.groupBy("range").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "partner"))), lambda p: p["partner"]).alias("names"))
    titles = ordered.select("range", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long"))).alias("block"), F.lit(None).cast("string").alias("anchor"), F.lit(None).cast("array<int>").alias("steps"), "names")
    dealt = asked.unionByName(titles).repartition("range", "block").sortWithinPartitions("range", "block", F.col("anchor").asc_nulls_first())
    return dealt.mapInArrow(counter(low, high), FOUND)
