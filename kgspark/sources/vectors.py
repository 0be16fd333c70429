"""A collection of chunks with their vectors, replaced as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.vector import normalised


def create(chunks: DataFrame, path: str, vector: str = "embedding") -> None:
    """Drop and create; vectors are scaled to length 1, zero vectors left out."""
    chunks.withColumn(vector, normalised(F.col(vector))).where(F.col(vector).isNotNull()).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
