"""Selecting questions, building prompts, and assembling trial rows and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import judges
from ..functions.text import markdown_cell


def prompt(question: Column, context: Column) -> Column:
    """The user's message: a context block only when there is a context."""
    ask = F.concat(F.lit("Question: "), question)
    return F.when(F.length(F.coalesce(context, F.lit(""))) > 0, F.concat(F.lit("Context:\n"), context, F.lit("\n\n"), ask)).otherwise(ask)


def select_questions(questions: DataFrame, limit: int, include_semantic: bool = False, types: list[str] | None = None, position: str = "pos") -> DataFrame:
    """Up to ``limit`` questions, round robin over types in order of ``position``; type prefixes override the rule on semantic ones."""
    if types is not None:
        keep = F.lit(False)
        for prefix in types:
            keep = keep | F.startswith("type_id", F.lit(prefix))
        questions = questions.where(keep)
    elif not include_semantic:
        questions = questions.where(F.coalesce(F.col("scoring") != "semantic", F.lit(True)))
    turn = F.row_number().over(Window.partitionBy("type_id").orderBy(position))
    return questions.withColumn("_turn", turn).orderBy("_turn", "type_id").limit(limit).drop("_turn")


def trial_rows(questions: DataFrame, contexts: DataFrame, answers: DataFrame) -> DataFrame:
    """Judged rows of questions (question_id, type_id, scoring, question, gt_scalar, gt_set).

    contexts: (question_id, context, sources); answers: (question_id, predicted,
    input_tokens, output_tokens, error).  A question without an answer, or with an
    error, is an unjudged row with null passed and 0 tokens.
    """
    rows = questions.join(contexts, "question_id", "left").join(answers, "question_id", "left")
    failed = F.col("predicted").isNull() | F.col("error").isNotNull()
    verdict = F.when(~failed, judges.judge(F.col("scoring"), F.col("predicted"), F.col("gt_scalar"), F.col("gt_set")))
    return rows.withColumns({
        "prompt": prompt(F.col("question"), F.col("context")),
        "error": F.when(failed, F.coalesce("error", F.lit("no answer"))),
        "input_tokens": F.when(failed, 0).otherwise(F.col("input_tokens")),
        "output_tokens": F.when(failed, 0).otherwise(F.col("output_tokens")),
        "judged": verdict.isNotNull(), "passed": verdict["passed"], "score": verdict["score"], "judge": judges.judge_id(F.col("scoring")),
    })


def manifest(questions: DataFrame, **factors: str) -> DataFrame:
    """One row: a run's factors, how many questions it has, and a fingerprint of their ids."""
    sha = F.lower(F.hex(F.expr("coalesce(bit_xor(xxhash64(cast(question_id as string))), 0)")))
    return questions.agg(F.count("*").alias("questions"), sha.alias("questions_fingerprint")).select(*[F.lit(v).alias(k) for k, v in factors.items()], "questions", "questions_fingerprint")


def active_corpus(profiles: DataFrame, asked: str | None, pointer: str | None) -> DataFrame:
    """The build id asked for, else the pointer's, else null; one that has no profile is an error when the row is read."""
    chosen = asked or pointer
    own = profiles.sparkSession.createDataFrame([(chosen,)], "corpus_build_id string")
    if chosen is None:
        return own
    known = own.join(profiles.select(F.col("corpus_build_id").alias("_known")).distinct(), F.col("corpus_build_id") == F.col("_known"), "left")
    return known.select(F.when(F.col("_known").isNotNull(), F.col("corpus_build_id")).otherwise(F.raise_error(F.lit(f"no profile of corpus {chosen}"))).alias("corpus_build_id"))


def summary(rows: DataFrame) -> DataFrame:
    """By type: passed, judged, tokens; rows with errors only count as errors."""
    fine = F.col("error").isNull()
    return rows.groupBy("type_id").agg(F.count_if(fine & F.col("passed")).alias("passed"), F.count_if(fine & F.col("judged")).alias("judged"), F.sum(F.when(fine, F.col("input_tokens"))).alias("input_tokens"), F.count_if(~fine).alias("errors"))


def first_resolved(rows: DataFrame, order: str, column: str) -> DataFrame:
    """The first value in order that isn't null."""
    return rows.where(F.col(column).isNotNull()).agg(F.min_by(column, order).alias(column))


def provider_model(spec: Column, default: str) -> Column:
    """(provider, model) of 'provider:model'; without a colon the default provider."""
    at = F.instr(spec, ":")
    return F.struct(F.when(at > 0, F.substring_index(spec, ":", 1)).otherwise(F.lit(default)).alias("provider"), F.when(at > 0, F.substring(spec, at + 1, F.length(spec))).otherwise(spec).alias("model"))


def report_lines(rows: DataFrame, manifest: dict) -> DataFrame:
    """(part, key, line) of a Markdown report, in the order of part and key: the run's factors (1), all verdicts (2, 3), results by type (4, 5)."""
    line = lambda values: F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(v.cast("string")) for v in values]), F.lit(" |"))
    heads = [(1, ["# Run " + str(manifest.get("run_id", "")), "", "| factor | value |", "| - | - |"]), (2, ["", "| question | type | passed | score |", "| - | - | - | - |"]), (4, ["", "| type | passed | judged |", "| - | - | - |"])]
    fixed = rows.sparkSession.createDataFrame([(part, f"{i:02d}", text) for part, texts in heads for i, text in enumerate(texts)], "part int, key string, line string")
    factors = rows.sparkSession.createDataFrame([("key " + str(k), str(k), "" if v is None else str(v)) for k, v in manifest.items()], "key string, k string, v string")
    of = lambda df, part, key, *names: df.select(F.lit(part).alias("part"), F.col(key).alias("key"), line([F.col(n) for n in names]).alias("line"))
    verdicts, types = of(rows, 3, "question_id", "question_id", "type_id", "passed", "score"), of(summary(rows), 5, "type_id", "type_id", "passed", "judged")
    return fixed.unionByName(of(factors, 1, "key", "k", "v")).unionByName(verdicts).unionByName(types)


def report(rows: DataFrame, manifest: dict) -> str:
    """The report as one text, for runs that a person reads; larger ones are written as ``report_lines``."""
    return "\n".join(r.line for r in report_lines(rows, manifest).orderBy("part", "key").toLocalIterator()) + "\n"
