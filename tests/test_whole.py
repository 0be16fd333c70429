"""Operators on inputs beyond the sizes at which they once stopped."""

from pyspark.sql import functions as F

from kgspark import registry
from kgspark.functions import text, vector
from kgspark.operators import harness, validate


def test_nearest_answers_every_query(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "id int, embedding array<double>")
    queries = spark.range(10_050).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, F.array(F.lit(1.0), F.lit(0.1))).otherwise(F.array(F.lit(0.1), F.lit(1.0))).alias("query"))
    got = vector.nearest(rows, queries, 2).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("r")).collect()
    assert {r.query_id: [x.id for x in r.r] for r in got} == {i: [i % 2, 2] for i in range(10_050)}


def test_rules_of_every_template_hold(spark):
    ids = spark.range(10_050).select(F.col("id").cast("string").alias("template_id"))
    meta = ids.select("template_id", F.lit(1).alias("count"), F.lit(2).alias("min_answer"), F.lit(5).alias("max_answer"))
    text = {c: F.lit("x") for c in validate.REQUIRED} | {"question_id": F.col("template_id"), "template_id": F.col("template_id"), "scoring": F.lit("set_match")}
    records = ids.select(*[v.alias(k) for k, v in text.items()], F.lit(None).cast("string").alias("gt_scalar"), F.array(F.lit("one")).alias("gt_set"))
    found = validate.problems(records, meta)
    assert found.where("rule = 'below the least answer'").count() == found.count() == 10_050


def test_report_has_every_verdict(spark):
    rows = spark.range(500).select(F.format_string("q%03d", "id").alias("question_id"), F.lit("01").alias("type_id"), F.lit(True).alias("passed"), F.lit(1.0).alias("score"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("judged"), F.lit(1).alias("input_tokens"))
    out = harness.report(rows, {"run_id": "r1"})
    assert all(f"| q{i:03d} | 01 | true | 1.0 |" in out for i in range(500)) and out.index("q000") < out.index("q499") < out.index("| 01 | 500 | 500 |")


def test_short_passages_are_found(spark, tmp_path):
    spark.createDataFrame([(1, "see foo bar here now"), (2, "foo"), (3, "barfoo bar x"), (4, "a b c d e f"), (5, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "foo bar"), (2, "foo"), (3, "b c d e f"), (4, "b c d e g"), (5, "!"), (6, "see foo bar")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    registry.load()
    assert sorted(map(tuple, registry.QUERIES["jd01_contains_run"](spark, str(tmp_path)).collect())) == [(1, 1), (1, 2), (1, 6), (2, 2), (4, 3)]


def test_chunks_of_a_very_long_text(spark):
    words = [f"w{i}" for i in range(200_000)]
    out = spark.createDataFrame([(" ".join(words),)], "a string").select(text.chunk_windows(F.col("a")).alias("c")).first().c
    assert out == [" ".join(words[i : i + 180]) for i in range(0, 200_000, 150)]


def test_hop_keeps_all_edges_of_a_hub(spark, sf, tmp_path):
    """rt04_hop: a nation with more customers than a retriever fetches."""
    import os

    for name in os.listdir(sf):
        if name != "customer.parquet":
            os.symlink(f"{sf}/{name}", tmp_path / name)
    spark.range(5_200).select(F.col("id").alias("c_custkey"), F.lit(3).alias("c_nationkey"), F.format_string("c%d", "id").alias("c_name"), F.lit("x").alias("c_mktsegment")).write.parquet(str(tmp_path / "customer.parquet"))
    registry.load()
    found = registry.QUERIES["rt04_hop"](spark, str(tmp_path)).where("question_id like '%Nation/3' and s like '%Customer/%'")
    assert found.count() == found.distinct().count() == 5_200
