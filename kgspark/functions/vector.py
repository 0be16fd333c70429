"""Vectors as column expressions, and exact cosine search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import vector_index


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Scaled to length 1; a zero vector is null."""
    own = norm(a)
    return F.when(own > 0, F.transform(a, lambda x: x.cast("double") / own))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, distance) of the k nearest vectors of each query (query_id, query); ties to the smaller id.

    Exact, by inverted lists (``vector_index``).  Vectors and queries that are null, empty or zero, or hold null or
    non-finite components, take no part; nor do pairs of different lengths.  Query ids are distinct.
    """
    return vector_index.search(vector_index.build(vectors, id_col, vector_col), queries, k)[0]


def context_block(rows: DataFrame, label: str = "label", entity: str = "entity", pmid: str = "pmid", document: str = "document") -> DataFrame:
    """(query_id, rank, distance, ...) -> one context for each query: '[label — PMID x] text' blocks by rank."""
    head = F.concat(F.lit("["), F.coalesce(F.when(F.col(label) != "", F.col(label)), F.col(entity)), F.lit(" — PMID "), F.col(pmid), F.lit("] "), F.col(document))
    ordered = F.array_sort(F.collect_list(F.struct("rank", head.alias("block"), F.round("distance", 4).alias("distance"))))
    return rows.groupBy("query_id").agg(ordered.alias("b")).select("query_id", F.array_join("b.block", "\n\n").alias("context"), F.col("b.distance").alias("distances"))
