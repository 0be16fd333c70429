"""Rows of hot keys meet their values as others do, and are dealt over several tasks."""

from pyspark.sql import functions as F

from kgspark.llm import shared


def test_matched_gives_each_row_its_value(spark):
    """Hot keys, rare keys, keys that the table does not have, and null keys."""
    rows = [(1 if i % 3 == 0 else i % 5000, i) for i in range(9000)] + [(None, 9000), (-7, 9001)]
    df = spark.createDataFrame(rows, "key long, row long")
    table = df.where("key >= 0").groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("least")).where("n > 1")
    got = shared.matched(df, table, ["key"], ["least"], ["row"])
    least, count = {}, {}
    for key, row in rows:
        least[key], count[key] = min(row, least.get(key, row)), count.get(key, 0) + 1
    want = sorted((row, least[key] if key is not None and count[key] > 1 else None) for key, row in rows)
    assert sorted((r["row"], r["least"]) for r in got.collect()) == want
    assert got.columns == ["key", "row", "least"]


def test_matched_of_empty_tables(spark):
    none = spark.createDataFrame([], "key long, row long")
    table = none.groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("least"))
    assert shared.matched(none, table, ["key"], ["least"], ["row"]).collect() == []
    one = spark.createDataFrame([(1, 1)], "key long, row long")
    assert shared.matched(one, table, ["key"], ["least"], ["row"]).first()["least"] is None
