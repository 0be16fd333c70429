"""Structured Streaming over trial events: extras of this engine.

``latest`` is the streaming form of latest-wins; windows carry a watermark, so
state is dropped once late data are out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources import append, scratch


def windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and mean values by tumbling window and type."""
    own = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return own.select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """A user's runs of events without a longer gap."""
    own = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return own.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first of events with one id, in the watermark's reach."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def latest(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The newest value of each key so far (complete mode)."""
    return events.withWatermark("ts", late).groupBy(*keys).agg(F.max(F.struct("ts", "event_id", "value")).alias("m")).select(*keys, "m.ts", "m.event_id", "m.value")


def run_to_end(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Process all that is available, and the result as a table: the last one in complete mode, else all rows, each batch once."""
    spark = stream.sparkSession
    path = scratch.new_folder(spark, name)
    if mode != "complete":
        append.start(stream, path, f"{path}/checkpoint").awaitTermination()
        return append.read(spark, path, stream.schema)
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
