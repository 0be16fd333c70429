"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import contextvars
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

MOST_HOT = 1024  # a key of more than one in so many rows is hot; fewer keys than that can be

#: Texts are long: batches between the JVM and Python are kept small, whatever a row holds.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def small_batches(spark: SparkSession) -> None:
    for key, value in BATCHES.items():
        spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="kgspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kgspark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kgspark_path = path
    if (made := _made.get()) is not None:
        made.append(out)
    return out


_made: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("tables written on the way", default=None)


def only(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The result of ``make`` as a written table; all tables that it wrote on the way are deleted."""
    made: list[DataFrame] = []
    outer = _made.set(made)
    try:
        out = written(make(), name)
    finally:
        _made.reset(outer)
    for table in made:
        if table is not out:
            drop(table)
    if (around := _made.get()) is not None:
        around.append(out)
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    path = getattr(df, "_kgspark_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def matched(rows: DataFrame, table: DataFrame, keys: list[str], values: list[str], spread: list[str]) -> DataFrame:
    """rows with the values that table holds for their keys, else null.

    table has one row for each key and ``n``, the number of rows with it.  Rows of hot keys meet their values by a
    broadcast of fewer than MOST_HOT rows, and are dealt by ``spread`` in the shuffle in which the others meet theirs.
    Rows with a null key match nothing.
    """
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    table = table.select(*keys, F.struct(*values).alias("_values"), (F.col("n") > total // MOST_HOT).alias("_hot"))
    hot = table.where("_hot").select(*keys, F.col("_values").alias("_hot_values"))
    cold = table.where("not _hot").select(*keys, "_values", F.lit(0).alias("_salt"))
    own = F.when(F.col("_hot_values").isNotNull(), F.pmod(F.xxhash64(*spread), F.lit(1 << 20)).cast("int") + 1).otherwise(0)
    out = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", own).join(cold, [*keys, "_salt"], "left")
    got = F.coalesce("_hot_values", "_values")
    return out.withColumns({v: got[v] for v in values}).drop("_hot_values", "_values", "_salt")
