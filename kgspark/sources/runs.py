"""Run files: rows as JSON lines, a manifest beside them, and corpus profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ROWS = "question_id string, type_id string, scoring string, retriever string, input_tokens long, output_tokens long, judged boolean, passed boolean, score double, judge_details string, traversal_info string, error string, predicted string"
MANIFEST = "run_id string, timestamp string, retriever string, generator_provider string, generator_model string, judge string, harness_version string, corpus_build_id string"
PROFILE = "corpus_build_id string, scale string, graph struct<triples:long,nodes:long,edges:long,ttl_bytes:long>, vector struct<chunks:long,abstracts:long,words:long,store_bytes:long>"


def _stem(suffix: str):
    return F.regexp_replace(F.col("_metadata.file_path"), suffix + "$", "")


def read_rows(spark: SparkSession, path: str, schema: str = ROWS) -> DataFrame:
    """Rows of all run files of a folder (blank lines are skipped), with the stem of their file."""
    return spark.read.schema(schema).option("pathGlobFilter", "*.jsonl").json(path).select("*", _stem(r"\.jsonl").alias("_stem"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    own = spark.read.schema(MANIFEST).option("multiLine", True).option("pathGlobFilter", "*.manifest.json").json(path)
    return own.select("*", F.to_timestamp("timestamp", "yyyy-MM-dd'T'HH:mm:ssZ").alias("run_ts"), _stem(r"\.manifest\.json").alias("_stem")).drop("timestamp")


def discover(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows with run_id, manifests) of runs that have both files; rows without a manifest are skipped."""
    manifests = read_manifests(spark, path)
    return read_rows(spark, path).join(manifests.select("_stem", "run_id"), "_stem").drop("_stem"), manifests.drop("_stem")


def full_runs(rows: DataFrame, n: int = 58) -> DataFrame:
    """Rows of runs with exactly n rows."""
    return rows.join(rows.groupBy("run_id").count().where(F.col("count") == n).select("run_id"), "run_id", "left_semi")


def write_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """Corpus profiles with fixed columns, however few files there are."""
    own = spark.read.schema(PROFILE).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return own.select("corpus_build_id", F.col("scale").alias("corpus_scale"), F.col("graph.triples").alias("corpus_triples"), F.col("graph.nodes").alias("corpus_nodes"), F.col("graph.edges").alias("corpus_edges"), F.col("vector.chunks").alias("corpus_chunks"), F.col("vector.abstracts").alias("corpus_abstracts"), F.col("vector.words").alias("corpus_words"))
