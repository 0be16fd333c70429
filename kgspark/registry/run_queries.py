"""Queries of telemetry, metrics and harness operators over trials made of the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import harness, metrics, telemetry
from . import query

# Trials: an event is the trial of a question (its user) by a condition (its type).
TRIALS = """t AS (SELECT event_id, 'run-' || lpad('' || event_id, 9, '0') AS run_id, ts AS run_ts, 'q' || user_id AS question_id, lpad('' || (user_id % 10 + 1), 2, '0') AS type_id,
  CASE user_id % 10 WHEN 0 THEN 'string_match' WHEN 4 THEN 'numerical' WHEN 7 THEN 'binary' WHEN 8 THEN 'boolean' WHEN 9 THEN 'semantic' ELSE 'set_match' END AS scoring,
  CASE event_type WHEN 'view' THEN 'closed_book' WHEN 'click' THEN 'graph_1hop' WHEN 'purchase' THEN 'graph_2hop' WHEN 'signup' THEN 'vector' ELSE 'graph_query' END AS retriever,
  'gen' || user_id % 2 || CASE WHEN event_id % 3 = 0 THEN '-20250101' ELSE '' END AS generator_model,
  CASE WHEN event_type = 'error' THEN 'w' || user_id % 3 || CASE WHEN event_id % 2 = 0 THEN '-20241231' ELSE '' END END AS writer_model,
  CAST(floor(value * 10) AS BIGINT) AS input_tokens, CAST({k} AS BIGINT) AS k FROM events),
trials AS (SELECT *, k % 20 <> 7 AND scoring <> 'semantic' AS judged, CASE WHEN k % 20 <> 7 AND scoring <> 'semantic' THEN k % 2 = 0 END AS passed,
  CASE WHEN k % 20 = 7 THEN 'timeout' END AS error, k / 100.0 AS recall, CASE WHEN k % 5 > 0 THEN (k % 5) / 4.0 END AS precision, k % 4 AS n_extra, CASE WHEN retriever = 'vector' THEN 0 END AS logged_hops FROM t)"""
SQL_TRIALS = TRIALS.replace("{k}", "json_extract(props, '$.k')")
FAMILY = "regexp_replace({0}, '-[0-9]{{8}}$', '')"
CANON = SQL_TRIALS + f""", f AS (SELECT *, {FAMILY.format('generator_model')} AS gf, {FAMILY.format('writer_model')} AS wf FROM trials),
canon AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY retriever, gf, wf, question_id ORDER BY run_ts DESC, run_id DESC) AS n FROM f) WHERE n = 1),
base AS (SELECT question_id, gf, max(input_tokens) AS b FROM canon WHERE retriever = 'closed_book' GROUP BY 1, 2),
tidy AS (SELECT canon.*, coalesce(CAST(logged_hops AS DOUBLE), TRY_CAST(nullif(regexp_extract(retriever, '_([0-9]+)hop', 1), '') AS DOUBLE)) AS hops, canon.input_tokens - b AS context_in
  FROM canon LEFT JOIN base USING (question_id, gf))"""


def raw(spark, sf_dir):
    """(rows, manifests) as run files hold them: rows with nested JSON, a manifest for each run."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.createOrReplaceTempView("_kg_events")
    own = TRIALS.replace("{k}", "get_json_object(props, '$.k')").replace("FROM events", "FROM _kg_events")
    trials = spark.sql(f"WITH {own} SELECT * FROM trials")
    extra = F.expr("concat('[', array_join(if(n_extra > 0, transform(sequence(1, n_extra), i -> concat('\"x', i, '\"')), array()), ','), ']')")
    judge = F.to_json(F.struct("recall", "precision"))
    judge = F.concat(F.lit('{"extra":'), extra, F.lit(","), F.substring(judge, 2, 1_000_000))
    traversal = F.to_json(F.struct("writer_model", F.col("logged_hops").alias("hops"), F.when(F.col("writer_model").isNotNull(), F.col("k")).alias("writer_input_tokens")))
    rows = trials.select("run_id", "question_id", "type_id", "scoring", F.lit("from the row").alias("retriever"), "input_tokens", "judged", "passed", "error", judge.alias("judge_details"), traversal.alias("traversal_info"))
    manifests = trials.select("run_id", "run_ts", "retriever", "generator_model", F.concat(F.lit("build"), F.expr("event_id % 3")).alias("corpus_build_id"))
    return rows, manifests


def canon(spark, sf_dir):
    return telemetry.canonical(telemetry.with_families(telemetry.stamped(*raw(spark, sf_dir))))


def tidy(spark, sf_dir):
    return telemetry.tidy(canon(spark, sf_dir))


def q(name, body, base=CANON):
    return query(name, f"WITH {base}\n{body}" if body else None)


@q("an01_stamped", "SELECT run_id, retriever, generator_model, question_id FROM trials", SQL_TRIALS)
def an01(spark, sf_dir):
    return telemetry.stamped(*raw(spark, sf_dir)).select("run_id", "retriever", "generator_model", "question_id")


@q("an02_union_of_runs", "SELECT run_id, CASE WHEN k % 2 = 0 THEN input_tokens END AS input_tokens, CASE WHEN k % 2 = 1 THEN question_id END AS question_id FROM trials", SQL_TRIALS)
def an02(spark, sf_dir):
    rows = telemetry.stamped(*raw(spark, sf_dir)).withColumn("even", F.get_json_object("judge_details", "$.recall").cast("decimal(6,2)") * 100 % 2 == 0)
    return telemetry.united([rows.where("even").select("run_id", "input_tokens"), rows.where("not even").select("run_id", "question_id")])


@q("an03_families", "SELECT run_id, gf AS generator_model_family, wf AS writer_model_family FROM f")
def an03(spark, sf_dir):
    return telemetry.with_families(telemetry.stamped(*raw(spark, sf_dir))).select("run_id", "generator_model_family", "writer_model_family")


@q("an04_canonical", "SELECT run_id, retriever, question_id, gf, wf FROM canon")
def an04(spark, sf_dir):
    return canon(spark, sf_dir).select("run_id", "retriever", "question_id", F.col("generator_model_family").alias("gf"), F.col("writer_model_family").alias("wf"))


@q("an05_exploded", "SELECT run_id, round(recall, 6) AS recall, round(precision, 6) AS precision FROM canon")
def an05(spark, sf_dir):
    return telemetry.exploded(canon(spark, sf_dir), "judge_details", telemetry.JUDGE).select("run_id", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@q("an06_passed_as_double", "SELECT run_id, CAST(passed AS DOUBLE) AS passed FROM tidy")
def an06(spark, sf_dir):
    return tidy(spark, sf_dir).select("run_id", "passed")


@q("an07_hops", "SELECT run_id, hops FROM tidy")
def an07(spark, sf_dir):
    return tidy(spark, sf_dir).select("run_id", "hops")


@q("an08_num_extra", "SELECT run_id, n_extra AS num_extra FROM tidy")
def an08(spark, sf_dir):
    return tidy(spark, sf_dir).select("run_id", F.col("num_extra").cast("long").alias("num_extra"))


@q("an09_context_tokens", "SELECT run_id, context_in FROM tidy")
def an09(spark, sf_dir):
    return tidy(spark, sf_dir).select("run_id", F.col("retrieval_context_input_tokens").alias("context_in"))


@q("an10_guaranteed_columns", "SELECT run_id, error, CAST(NULL AS BIGINT) AS cache_read_input_tokens, CAST(NULL AS DOUBLE) AS generator_temperature FROM tidy")
def an10(spark, sf_dir):
    return tidy(spark, sf_dir).select("run_id", "error", "cache_read_input_tokens", "generator_temperature")


@q("an11_with_profiles", "SELECT run_id, CASE event_id % 3 WHEN 0 THEN 100 WHEN 1 THEN 200 END AS corpus_triples FROM tidy")
def an11(spark, sf_dir):
    profiles = spark.createDataFrame([("build0", 100), ("build1", 200)], "corpus_build_id string, corpus_triples long")
    return telemetry.load(*raw(spark, sf_dir), profiles).select("run_id", "corpus_triples")


@q("an12_audit", "SELECT retriever, gf, wf, count(DISTINCT question_id) AS questions, CAST(sum(CAST(judged AS INT)) AS BIGINT) AS judged, CAST(sum(CAST(passed AS INT)) AS BIGINT) AS passed, max(run_id) AS last_run FROM tidy GROUP BY 1, 2, 3")
def an12(spark, sf_dir):
    return telemetry.audit(tidy(spark, sf_dir)).withColumnsRenamed({"generator_model_family": "gf", "writer_model_family": "wf"})


@q("an13_coverage", "SELECT 'recall' AS name, count(recall) AS filled, count(*) AS total, round(100.0 * count(recall) / count(*), 1) AS pct FROM tidy UNION ALL SELECT 'hops', count(hops), count(*), round(100.0 * count(hops) / count(*), 1) FROM tidy UNION ALL SELECT 'passed', count(passed), count(*), round(100.0 * count(passed) / count(*), 1) FROM tidy")
def an13(spark, sf_dir):
    return telemetry.coverage(tidy(spark, sf_dir), ["recall", "hops", "passed"])


@q("an14_grain", "SELECT retriever, question_id, count(*) AS n FROM canon GROUP BY 1, 2 HAVING count(*) > 1")
def an14(spark, sf_dir):
    return telemetry.grain_violations(canon(spark, sf_dir), ["retriever", "question_id"])


@q("an15_distinct_counts", "SELECT 'retriever' AS name, count(DISTINCT retriever) AS \"values\" FROM canon UNION ALL SELECT 'question_id', count(DISTINCT question_id) FROM canon UNION ALL SELECT 'type_id', count(DISTINCT type_id) FROM canon")
def an15(spark, sf_dir):
    return telemetry.distinct_counts(canon(spark, sf_dir), ["retriever", "question_id", "type_id"])


@q("an16_dimension_tuples", "SELECT DISTINCT retriever, gf, wf FROM canon")
def an16(spark, sf_dir):
    return canon(spark, sf_dir).select("retriever", F.col("generator_model_family").alias("gf"), F.col("writer_model_family").alias("wf")).distinct()


RETRIEVERS = ["closed_book", "graph_1hop", "graph_2hop", "graph_query", "vector"]


@q("an17_crosstab", "SELECT type_id, " + ", ".join(f"count(*) FILTER (retriever = '{r}') AS {r}" for r in RETRIEVERS) + " FROM canon GROUP BY 1")
def an17(spark, sf_dir):
    return metrics.crosstab(canon(spark, sf_dir), "type_id", "retriever", RETRIEVERS)


@q("an18_reconciled", "SELECT e.run_id, CAST(e.passes AS BIGINT) AS passes, CAST(coalesce(sum(CAST(t.passed AS INT)), 0) AS BIGINT) AS found, coalesce(sum(CAST(t.passed AS INT)), 0) = e.passes AS equal FROM (VALUES ('run-000000001', 1), ('run-000000002', 0), ('none', 3)) e(run_id, passes) LEFT JOIN trials t ON t.run_id = e.run_id GROUP BY e.run_id, e.passes", SQL_TRIALS)
def an18(spark, sf_dir):
    expected = spark.createDataFrame([("run-000000001", 1), ("run-000000002", 0), ("none", 3)], "run_id string, passes long")
    return metrics.reconciled(telemetry.stamped(*raw(spark, sf_dir)), expected)


@q("an19_integrity", "SELECT CAST(count(error) AS BIGINT) AS errors, CAST(count(*) FILTER (NOT judged AND scoring <> 'semantic') AS BIGINT) AS unjudged, 1 AS generators FROM trials", SQL_TRIALS)
def an19(spark, sf_dir):
    return metrics.integrity(telemetry.stamped(*raw(spark, sf_dir)))


@q("an20_accuracy_pivot", "SELECT retriever, " + ", ".join(f"round(avg(CAST(passed AS DOUBLE)) FILTER (type_id = '{t:02d}'), 6) AS \"{t:02d}\"" for t in range(1, 11)) + " FROM tidy GROUP BY 1")
def an20(spark, sf_dir):
    return metrics.accuracy_pivot(tidy(spark, sf_dir), [f"{t:02d}" for t in range(1, 11)])


@q("an21_writer_pivot", "SELECT * FROM (SELECT type_id, " + ", ".join(f"round(avg(CAST(passed AS DOUBLE)) FILTER (wf = '{w}'), 6) AS {w}" for w in ("w0", "w1", "w2")) + " FROM tidy GROUP BY 1) WHERE coalesce(w0, w1, w2) IS NOT NULL")
def an21(spark, sf_dir):
    return metrics.writer_pivot(tidy(spark, sf_dir), ["w0", "w1", "w2"])


@q("an22_recall_table", "SELECT retriever, round(avg(recall), 6) AS recall, round(avg(CAST(passed AS DOUBLE)), 6) AS exact, count(*) AS n FROM tidy WHERE scoring = 'set_match' GROUP BY 1")
def an22(spark, sf_dir):
    return metrics.recall_table(tidy(spark, sf_dir))


@q("an23_leak_table", "SELECT retriever, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, CAST(NULL AS DOUBLE) AS f1, round(avg(n_extra), 6) AS num_extra FROM tidy WHERE scoring = 'set_match' GROUP BY 1")
def an23(spark, sf_dir):
    return metrics.leak_table(tidy(spark, sf_dir))


@q("an24_cost_table", "SELECT retriever, round(avg(context_in), 6) AS context_in, round(avg(CASE WHEN writer_model IS NOT NULL THEN k END), 6) AS writer_in FROM tidy GROUP BY 1")
def an24(spark, sf_dir):
    return metrics.cost_table(tidy(spark, sf_dir))


PRICES = [("gen0", "2024-01-01", 1.0, 5.0), ("gen0", "2024-01-10", 0.8, 4.0), ("gen1", "2024-01-01", 3.0, 15.0), ("gen1", "2024-01-20", 2.5, 12.0)]


@q("an25_dollars", f"""SELECT t.run_id, round((t.input_tokens * p.i + t.k * p.o) / 1e6, 9) AS dollars FROM f t LEFT JOIN (SELECT m, CAST(s AS DATE) AS s, i, o, lead(CAST(s AS DATE)) OVER (PARTITION BY m ORDER BY s) AS u
FROM (VALUES {', '.join(map(str, PRICES))}) x(m, s, i, o)) p ON t.gf = p.m AND CAST(t.run_ts AS DATE) >= p.s AND (p.u IS NULL OR CAST(t.run_ts AS DATE) < p.u)""")
def an25(spark, sf_dir):
    rows = telemetry.exploded(telemetry.with_families(telemetry.stamped(*raw(spark, sf_dir))), "judge_details", {"recall": "decimal(6,2)"})
    rows = rows.select("run_id", F.col("generator_model_family").alias("model"), F.to_date("run_ts").alias("day"), "input_tokens", (F.col("recall") * 100).cast("long").alias("output_tokens"))
    prices = spark.createDataFrame(PRICES, "model string, since string, input_rate double, output_rate double").withColumn("since", F.to_date("since"))
    return metrics.dollars(rows, prices).select("run_id", F.round("dollars", 9).alias("dollars"))


@q("an26_accuracy", "SELECT retriever, type_id, round(avg(CAST(passed AS DOUBLE)), 6) AS accuracy, count(passed) AS judged FROM tidy GROUP BY 1, 2")
def an26(spark, sf_dir):
    return metrics.accuracy(tidy(spark, sf_dir))


@query("an27_sensitivity", "SELECT round(count(*) FILTER (quality = 0 AND toxic = 1) / CAST(count(*) FILTER (quality = 0) AS DOUBLE), 6) AS sensitivity, round(count(*) FILTER (quality = 1 AND toxic = 0) / CAST(count(*) FILTER (quality = 1) AS DOUBLE), 6) AS specificity FROM labels")
def an27(spark, sf_dir):
    return metrics.sensitivity(spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("quality") == 0, F.col("toxic") == 1)


@query("an28_kappa", "SELECT round(o, 6) AS observed, round((o - c) / (1 - c), 6) AS kappa, (o - c) / (1 - c) > 0.7 AS trusted FROM (SELECT o, a * b + (1 - a) * (1 - b) AS c FROM (SELECT avg(CAST(quality = 1 - toxic AS DOUBLE)) AS o, avg(CAST(quality AS DOUBLE)) AS a, avg(1.0 - toxic) AS b FROM labels))")
def an28(spark, sf_dir):
    return metrics.kappa(spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("quality"), 1 - F.col("toxic"))


@q("an29_recall_curve", "SELECT hops, type_id, round(avg(recall), 6) AS recall FROM tidy GROUP BY 1, 2")
def an29(spark, sf_dir):
    return metrics.recall_curve(tidy(spark, sf_dir))


@q("an30_failure_locus", """SELECT locus, count(*) AS n FROM (SELECT CASE WHEN k % 11 = 0 THEN 'INVALID' WHEN k % 2 = 0 THEN CASE WHEN k % 3 = 0 AND k % 7 = 0 THEN 'EMPTY_CORRECT' ELSE 'PASS' END
WHEN k % 3 > 0 THEN 'ROWS_GEN_FAIL' WHEN k % 7 = 0 THEN 'EMPTY_CORRECT' ELSE 'EMPTY_MISS' END AS locus FROM trials) GROUP BY 1""", SQL_TRIALS)
def an30(spark, sf_dir):
    rows = telemetry.exploded(telemetry.stamped(*raw(spark, sf_dir)), "judge_details", {"recall": "decimal(6,2)"}).withColumn("k", (F.col("recall") * 100).cast("long"))
    locus = metrics.failure_locus(F.col("k") % 2 == 0, F.col("k") % 11 != 0, F.col("k") % 3, F.col("k") % 7)
    return rows.groupBy(locus.alias("locus")).agg(F.count("*").alias("n"))


@q("an31_tokens_per_correct", "SELECT retriever, CAST(sum(input_tokens) AS BIGINT) AS tokens, CAST(sum(CAST(passed AS INT)) AS BIGINT) AS correct, round(sum(input_tokens) / CAST(nullif(sum(CAST(passed AS INT)), 0) AS DOUBLE), 6) AS per_correct FROM tidy GROUP BY 1")
def an31(spark, sf_dir):
    return metrics.tokens_per_correct(tidy(spark, sf_dir))


@query("an32_same_results", "SELECT CAST(0 AS BIGINT) AS only_a, CAST(0 AS BIGINT) AS only_b, true AS equal")
def an32(spark, sf_dir):
    """A query and another way of writing it, by their results."""
    from ..plans.compiler import execute
    from ..sources.graph import from_tables

    graph = from_tables(spark, sf_dir)
    return metrics.same_results(execute(graph, "SELECT DISTINCT ?s WHERE { ?o kg:contains / kg:supplied_by ?s }"), execute(graph, "SELECT DISTINCT ?s WHERE { ?s ^kg:supplied_by ?p . ?p ^kg:contains ?o }"))


@q("an33_rollup", "SELECT retriever, type_id, count(*) AS n, round(avg(CAST(passed AS DOUBLE)), 6) AS accuracy FROM tidy GROUP BY CUBE (retriever, type_id)")
def an33(spark, sf_dir):
    """An extra: accuracy over all groupings of retriever and type."""
    return tidy(spark, sf_dir).cube("retriever", "type_id").agg(F.count("*").alias("n"), F.round(F.avg("passed"), 6).alias("accuracy"))


@q("hn01_prompt", "SELECT run_id, CASE WHEN retriever <> 'closed_book' THEN 'Context:' || chr(10) || retriever || chr(10) || chr(10) ELSE '' END || 'Question: ' || question_id AS prompt FROM trials", SQL_TRIALS)
def hn01(spark, sf_dir):
    context = F.when(F.col("retriever") != "closed_book", F.col("retriever")).otherwise("")
    return telemetry.stamped(*raw(spark, sf_dir)).select("run_id", harness.prompt(F.col("question_id"), context).alias("prompt"))


@q("hn02_selected", "SELECT question_id, type_id FROM (SELECT question_id, type_id, row_number() OVER (PARTITION BY type_id ORDER BY question_id) AS n FROM (SELECT DISTINCT question_id, type_id, scoring FROM trials) WHERE scoring <> 'semantic') ORDER BY n, type_id LIMIT 37", SQL_TRIALS)
def hn02(spark, sf_dir):
    questions = telemetry.stamped(*raw(spark, sf_dir)).select("question_id", "type_id", "scoring").distinct()
    return harness.select_questions(questions, 37, position="question_id").select("question_id", "type_id")


@q("hn03_trial_rows", """SELECT 'q' || doc_id AS question_id, CASE WHEN doc_id % 10 = 0 THEN false ELSE true END AS judged, CASE WHEN doc_id % 10 = 0 THEN NULL
ELSE contains(' ' || trim(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g')) || ' ', ' the ') END AS passed, CASE WHEN doc_id % 10 = 0 THEN 'no answer' END AS error, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE n_chars END AS input_tokens FROM documents""", "x AS (SELECT 1)")
def hn03(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("question_id", F.concat(F.lit("q"), "doc_id"))
    questions = docs.select("question_id", F.lit("01").alias("type_id"), F.lit("string_match").alias("scoring"), F.col("source").alias("question"), F.lit("the").alias("gt_scalar"), F.array().cast("array<string>").alias("gt_set"))
    contexts = docs.select("question_id", F.col("lang").alias("context"), F.array("source").alias("sources"))
    answers = docs.where("doc_id % 10 <> 0").select("question_id", F.col("text").alias("predicted"), F.col("n_chars").alias("input_tokens"), F.lit(1).alias("output_tokens"), F.lit(None).cast("string").alias("error"))
    return harness.trial_rows(questions, contexts, answers).select("question_id", "judged", "passed", "error", "input_tokens")


@q("hn05_summary", "SELECT type_id, count(*) FILTER (error IS NULL AND passed) AS passed, count(*) FILTER (error IS NULL AND judged) AS judged, CAST(sum(CASE WHEN error IS NULL THEN input_tokens END) AS BIGINT) AS input_tokens, count(error) AS errors FROM trials GROUP BY 1", SQL_TRIALS)
def hn05(spark, sf_dir):
    return harness.summary(telemetry.stamped(*raw(spark, sf_dir)))


@q("hn06_first_resolved", "SELECT min_by(error, run_id) AS error FROM trials WHERE error IS NOT NULL", SQL_TRIALS)
def hn06(spark, sf_dir):
    return harness.first_resolved(telemetry.stamped(*raw(spark, sf_dir)), "run_id", "error")


@q("hn08_spec", "SELECT run_id, CASE WHEN k % 2 = 0 THEN 'own' ELSE 'default' END AS provider, generator_model || ':x' AS model FROM trials WHERE k % 2 = 0 UNION ALL SELECT run_id, 'default', generator_model FROM trials WHERE k % 2 = 1", SQL_TRIALS)
def hn08(spark, sf_dir):
    rows = telemetry.exploded(telemetry.stamped(*raw(spark, sf_dir)), "judge_details", {"recall": "decimal(6,2)"})
    spec = F.when(F.col("recall") * 100 % 2 == 0, F.concat(F.lit("own:"), "generator_model", F.lit(":x"))).otherwise(F.col("generator_model"))
    own = harness.provider_model(spec, "default")
    return rows.select("run_id", own["provider"].alias("provider"), own["model"].alias("model"))
