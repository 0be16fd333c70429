"""An append sink of JSON lines: finished rows are on disk at once, and a batch counts once.

Every task writes a file of its own and flushes each row, so a crash loses no
finished row.  A batch is committed by one log file, named by its number and
made in one step, that lists the batch's files; readers take the files that
logs list.  A batch that is written again, after a restart or a lost executor,
finds its log and takes back its files, so its rows appear once.  Rows of a
batch that never was committed stay readable with ``uncommitted``.

Files are reached by pyarrow's file systems, as local paths or URIs; the folder
must be one that the driver and all executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "kgspark_append"


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class Writer(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Row]) -> Written:
        system, path = place(self.path)
        out, rows, name = None, 0, f"{uuid.uuid4().hex}.jsonl"
        for row in iterator:
            if out is None:
                system.create_dir(f"{path}/rows", recursive=True)
                out = system.open_output_stream(f"{path}/rows/{name}", compression=None)
            out.write((json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False) + "\n").encode())
            out.flush()
            rows += 1
        if out is not None:
            out.close()
        return Written(name if rows else None, rows)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        system, path = place(self.path)
        done = [m for m in messages if m is not None and m.file]
        log = f"{path}/log/{batchId:012d}.json"
        if system.get_file_info(log).type != fs.FileType.NotFound:
            for m in done:  # the batch is there already
                system.delete_file(f"{path}/rows/{m.file}")
            return
        system.create_dir(f"{path}/log", recursive=True)
        part = f"{path}/.{uuid.uuid4().hex}"
        with system.open_output_stream(part, compression=None) as out:
            for m in done:
                out.write((json.dumps({"batch": batchId, "file": m.file, "rows": m.rows}) + "\n").encode())
        system.move(part, log)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        """Finished rows stay; no log lists them."""


class Append(DataSource):
    """options: path."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamWriter(self, schema: StructType, overwrite: bool) -> Writer:  # noqa: N802
        return Writer(self.options["path"])


def start(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """The running query that appends a stream to the folder; trigger as of ``DataStreamWriter.trigger``."""
    stream.sparkSession.dataSource.register(Append)
    return stream.writeStream.format(FORMAT).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(batch, file, rows) of all committed batches."""
    system, local = place(path)
    schema = "batch long, file string, rows long"
    if system.get_file_info(f"{local}/log").type == fs.FileType.NotFound:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{path}/log")


def read(spark: SparkSession, path: str, schema: StructType | str, uncommitted: bool = False) -> DataFrame:
    """Rows of committed batches; with ``uncommitted``, those of tasks that finished or not in batches that did not."""
    system, local = place(path)
    if system.get_file_info(f"{local}/rows").type == fs.FileType.NotFound:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).json(f"{path}/rows").withColumn("_of", F.col("_metadata.file_name"))
    known = committed(spark, path).select(F.col("file").alias("_of"))
    return rows.join(known, "_of", "left_anti" if uncommitted else "left_semi").drop("_of")
