"""The append sink: rows of finished tasks survive, batches count once."""

import json
import os

import pytest
from pyspark.sql import Row, functions as F

from kgspark.sources import append

SCHEMA = "id long, text string, parts array<string>, at struct<x:double>"


def source(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_restart_appends_only_what_is_new(spark, tmp_path):
    first = [Row(id=i, text=f"é\n{i}" if i % 2 else None, parts=["a", None] if i % 3 else None, at=Row(x=i / 7)) for i in range(20)]
    source(spark, tmp_path / "in", first, "a")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):  # the second run finds nothing new
        append.start(stream(spark, tmp_path / "in"), out, check).awaitTermination()
        assert sorted(append.read(spark, out, SCHEMA).collect()) == sorted(first)
    source(spark, tmp_path / "in", [Row(id=99, text="later", parts=[], at=None)], "b")
    append.start(stream(spark, tmp_path / "in"), out, check).awaitTermination()
    assert append.read(spark, out, SCHEMA).count() == 21 and append.committed(spark, out).agg(F.sum("rows")).first()[0] == 21


def test_a_replayed_batch_appears_once(spark, tmp_path):
    """The commit log of the engine is lost after the batch's own commit: the batch runs again under its number."""
    rows = [Row(id=i, text="t", parts=None, at=None) for i in range(10)]
    source(spark, tmp_path / "in", rows, "a")
    out, check = str(tmp_path / "out"), tmp_path / "check"
    append.start(stream(spark, tmp_path / "in"), out, str(check)).awaitTermination()
    for name in os.listdir(check / "commits"):
        os.remove(check / "commits" / name)
    append.start(stream(spark, tmp_path / "in"), out, str(check)).awaitTermination()
    assert sorted(r.id for r in append.read(spark, out, SCHEMA).collect()) == list(range(10))
    assert append.read(spark, out, SCHEMA, uncommitted=True).count() == 0


def test_finished_rows_of_a_failed_batch_are_kept_apart(spark, tmp_path):
    writer = append.Writer(str(tmp_path))
    done = writer.write(iter([Row(id=1, text="x", parts=None, at=None)]))

    def fails():
        yield Row(id=2, text="finished", parts=None, at=None)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(fails())
    writer.abort([done, None], 0)
    path = str(tmp_path)
    assert append.read(spark, path, SCHEMA).count() == 0
    assert sorted(r.id for r in append.read(spark, path, SCHEMA, uncommitted=True).collect()) == [1, 2]
    writer.commit([writer.write(iter([Row(id=1, text="x", parts=None, at=None)])), writer.write(iter([]))], 0)
    assert [r.id for r in append.read(spark, path, SCHEMA).collect()] == [1]
    assert [json.loads(line)["rows"] for line in open(tmp_path / "log" / "000000000000.json")] == [1]
    assert append.read(spark, str(tmp_path / "nothing"), SCHEMA).count() == 0
