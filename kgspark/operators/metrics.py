"""Accuracy, cost and agreement of evaluation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def crosstab(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return rows.groupBy(row).pivot(column, values).count().na.fill(0)


def accuracy(rows: DataFrame) -> DataFrame:
    """Mean of passed by retriever and type."""
    return rows.groupBy("retriever", "type_id").agg(F.round(F.avg(F.col("passed").cast("double")), 6).alias("accuracy"), F.count("passed").alias("judged"))


def accuracy_pivot(rows: DataFrame, types: list[str]) -> DataFrame:
    return rows.groupBy("retriever").pivot("type_id", types).agg(F.round(F.avg(F.col("passed").cast("double")), 6))


def writer_pivot(rows: DataFrame, writers: list[str]) -> DataFrame:
    """Accuracy by type and writer; types that no writer has go."""
    return rows.groupBy("type_id").pivot("writer_model_family", writers).agg(F.round(F.avg(F.col("passed").cast("double")), 6)).na.drop("all", subset=writers)


def reconciled(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """expected (run_id, passes) against the rows: found and whether equal."""
    found = rows.groupBy("run_id").agg(F.sum(F.col("passed").cast("long")).alias("found"))
    return expected.join(found, "run_id", "left").select("run_id", "passes", F.coalesce("found", F.lit(0)).alias("found"), (F.coalesce("found", F.lit(0)) == F.col("passes")).alias("equal"))


def integrity(rows: DataFrame) -> DataFrame:
    """Rows with an error, unjudged ones that aren't semantic, and the most generators of one run."""
    by_run = rows.groupBy("run_id").agg(F.count_if(F.col("error").isNotNull()).alias("e"), F.count_if(~F.col("judged") & (F.col("scoring") != "semantic")).alias("u"), F.count_distinct("generator_model").alias("g"))
    return by_run.agg(F.sum("e").alias("errors"), F.sum("u").alias("unjudged"), F.max("g").alias("generators"))


def recall_table(rows: DataFrame) -> DataFrame:
    own = rows.where("scoring = 'set_match'")
    return own.groupBy("retriever").agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("passed"), 6).alias("exact"), F.count("*").alias("n"))


def leak_table(rows: DataFrame) -> DataFrame:
    own = rows.where("scoring = 'set_match'")
    return own.groupBy("retriever").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1", "num_extra")])


def cost_table(rows: DataFrame) -> DataFrame:
    """Mean context and writer tokens, never added to one another."""
    return rows.groupBy("retriever").agg(F.round(F.avg("retrieval_context_input_tokens"), 6).alias("context_in"), F.round(F.avg("writer_input_tokens"), 6).alias("writer_in"))


def dollars(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """rows (model, day, input_tokens, output_tokens) with dollars by the latest price (model, since, input_rate, output_rate) of that day.

    An as-of join: prices become ranges of days, which an equi-join on the model with two comparisons reads.
    """
    until = F.lead("since").over(Window.partitionBy("model").orderBy("since"))
    ranges = prices.withColumn("until", until).withColumnRenamed("model", "_model")
    at = (F.col("model") == F.col("_model")) & (F.col("day") >= F.col("since")) & (F.col("until").isNull() | (F.col("day") < F.col("until")))
    cost = (F.col("input_tokens") * F.col("input_rate") + F.col("output_tokens") * F.col("output_rate")) / 1e6
    return rows.join(ranges, at, "left").withColumn("dollars", cost).drop("_model", "since", "until")


def sensitivity(rows: DataFrame, positive: Column, flagged: Column) -> DataFrame:
    """Sensitivity and specificity of flagged against positive; null where there is nothing to divide by."""
    counts = rows.agg(*[F.count_if(c).alias(n) for n, c in (("tp", positive & flagged), ("fn", positive & ~flagged), ("tn", ~positive & ~flagged), ("fp", ~positive & flagged))])
    return counts.select(F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("sensitivity"), F.round(F.try_divide("tn", F.col("tn") + F.col("fp")), 6).alias("specificity"))


def kappa(rows: DataFrame, a: Column, b: Column, trust: float = 0.7) -> DataFrame:
    """Cohen's kappa of two 0/1 raters, and whether it is above ``trust``."""
    own = rows.select(a.cast("double").alias("a"), b.cast("double").alias("b")).agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("o"), F.avg("a").alias("a"), F.avg("b").alias("b"))
    chance = F.col("a") * F.col("b") + (1 - F.col("a")) * (1 - F.col("b"))
    value = F.try_divide(F.col("o") - chance, 1 - chance)
    return own.select(F.round("o", 6).alias("observed"), F.round(value, 6).alias("kappa"), (value > trust).alias("trusted"))


def recall_curve(rows: DataFrame) -> DataFrame:
    return rows.groupBy("hops", "type_id").agg(F.round(F.avg("recall"), 6).alias("recall"))


def failure_locus(passed: Column, valid: Column, found: Column, expected: Column) -> Column:
    """Where a query-writing row failed: its query, its rows, or the answer made of them."""
    return F.when(~valid, "INVALID").when(passed, F.when((found == 0) & (expected == 0), "EMPTY_CORRECT").otherwise("PASS")).when(found > 0, "ROWS_GEN_FAIL").when(expected == 0, "EMPTY_CORRECT").otherwise("EMPTY_MISS")


def tokens_per_correct(rows: DataFrame) -> DataFrame:
    own = rows.groupBy("retriever").agg(F.sum("input_tokens").alias("tokens"), F.sum(F.col("passed").cast("long")).alias("correct"))
    return own.withColumn("per_correct", F.round(F.try_divide("tokens", "correct"), 6))


def same_results(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_a, only_b, equal) of two result sets with the same columns, as multisets."""
    only_a, only_b = a.exceptAll(b).agg(F.count("*").alias("only_a")), b.exceptAll(a).agg(F.count("*").alias("only_b"))
    return only_a.crossJoin(only_b).withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))
