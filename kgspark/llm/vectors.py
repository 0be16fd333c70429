"""Vectors packed into blocks: a row holds the ids and the matrix of many vectors.

A vector takes part if it is not null and all of its components are finite
numbers; vectors of different lengths are never compared.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, dtype=np.float64) -> np.ndarray:
    """Rows of a column of lists of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(n, -1) if n else np.zeros((0, 0), dtype)


def block_count(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def packed(rows: DataFrame, keys: list[str], make: Callable[[pa.Table], dict], schema: str) -> DataFrame:
    """One row for each group of keys: make(table of the group) -> a dict of single values; keys come first in schema."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64()), "double": pa.float64()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(key: tuple, group: pa.Table) -> pa.Table:
        values = {k: v.as_py() for k, v in zip(keys, key, strict=True)} | make(group)
        return pa.table([pa.array([values[n]], t) for n, t in zip(names, types, strict=True)], names)

    return rows.groupBy(*keys).applyInArrow(run, schema)

