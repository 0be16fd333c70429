"""Evaluation runs to one tidy frame: stamped, deduplicated, exploded and enriched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import model_family

JUDGE = {"recall": "double", "precision": "double", "f1": "double", "expected_count": "double", "found_count": "double", "judge_input_tokens": "long", "judge_output_tokens": "long", "judge_model": "string"}
TRAVERSAL = {"mechanism": "string", "writer_input_tokens": "long", "writer_output_tokens": "long", "sparql_valid": "string", "num_rows": "long", "num_linked": "long", "num_triples": "long", "top_k": "long", "hops": "double"}
GUARANTEED = {"generator_model_resolved": "string", "cache_read_input_tokens": "long", "cache_creation_input_tokens": "long", "error": "string", "generator_temperature": "double"}
KEY = ["retriever", "generator_model_family", "writer_model_family", "question_id"]
BASELINE = "closed_book"


def nested(column: str, key: str, kind: str) -> Column:
    """A key of a JSON column; missing, or not of the kind: null."""
    return F.get_json_object(column, f"$.{key}").try_cast(kind)


def stamped(rows: DataFrame, manifests: DataFrame) -> DataFrame:
    """Rows with their run's factors; where both have a column the manifest's counts. Rows without a manifest go."""
    own = [c for c in rows.columns if c == "run_id" or c not in manifests.columns]
    return rows.select(*own).join(manifests, "run_id")


def united(runs: list[DataFrame]) -> DataFrame:
    """Runs of unlike columns as one frame; what a run lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)


def with_families(rows: DataFrame) -> DataFrame:
    writer = F.get_json_object("traversal_info", "$.writer_model")
    return rows.withColumns({"writer_model": writer, "writer_model_family": model_family(writer), "generator_model_family": model_family(F.col("generator_model"))})


def canonical(rows: DataFrame) -> DataFrame:
    """The latest row of each condition and question (ties: the greater run id); no writer is a value of its own."""
    newest = Window.partitionBy(*KEY).orderBy(F.desc("run_ts"), F.desc("run_id"))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def exploded(rows: DataFrame, column: str, keys: dict[str, str]) -> DataFrame:
    return rows.withColumns({k: nested(column, k, kind) for k, kind in keys.items()})


def hops(retriever: Column, logged: Column) -> Column:
    """The logged value, else what the retriever's name says."""
    return F.coalesce(logged, F.nullif(F.regexp_extract(retriever, r"_(\d+)hop", 1), F.lit("")).try_cast("double"))


def context_tokens(rows: DataFrame) -> DataFrame:
    """retrieval_context_input_tokens: above the closed-book row of the same question and generator (after ``canonical``)."""
    base = rows.where(F.col("retriever") == BASELINE).groupBy("question_id", "generator_model_family").agg(F.max("input_tokens").alias("_base"))
    return rows.join(base, ["question_id", "generator_model_family"], "left").withColumn("retrieval_context_input_tokens", F.col("input_tokens") - F.col("_base")).drop("_base")


def guaranteed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.lit(None).cast(kind) for c, kind in GUARANTEED.items() if c not in rows.columns})


def tidy(rows: DataFrame) -> DataFrame:
    rows = exploded(exploded(rows, "judge_details", JUDGE), "traversal_info", TRAVERSAL)
    rows = rows.withColumns({
        "passed": F.col("passed").cast("double"),
        "hops": hops(F.col("retriever"), F.col("hops")),
        "num_extra": F.coalesce(F.json_array_length(F.get_json_object("judge_details", "$.extra")), F.lit(0)),
    })
    return guaranteed(context_tokens(rows))


def load(rows: DataFrame, manifests: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """stamped -> canonical -> tidy -> corpus profiles by corpus_build_id."""
    out = tidy(canonical(with_families(stamped(rows, manifests))))
    return out.join(profiles, "corpus_build_id", "left") if profiles is not None else out


def audit(rows: DataFrame) -> DataFrame:
    """Of each retriever and families: questions, judged, passed, last run."""
    return rows.groupBy("retriever", "generator_model_family", "writer_model_family").agg(F.count_distinct("question_id").alias("questions"), F.sum(F.col("judged").cast("long")).alias("judged"), F.sum(F.col("passed").cast("long")).alias("passed"), F.max("run_id").alias("last_run"))


def coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(name, filled, total, pct): how much of each column is there; one pass."""
    counts = rows.agg(F.count("*").alias("_total"), *[F.count(c).alias(c) for c in columns])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("filled"), F.col("_total").alias("total")) for c in columns]))).withColumn("pct", F.round(100 * F.try_divide("filled", "total"), 1))


def grain_violations(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def distinct_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    counts = rows.agg(*[F.count_distinct(c).alias(c) for c in columns])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("values")) for c in columns])))
