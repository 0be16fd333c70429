"""Queries of text, vector and judge operators over documents, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import judges, text, vector
from ..operators import matching
from . import query


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NORM = "trim(regexp_replace(lower({0}), '[^0-9a-z]+', ' ', 'g'))"
WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"


@query("tx01_normalize", f"SELECT doc_id, {NORM.format('text')} AS norm FROM documents")
def tx01(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("norm"))


@query("tx02_count_tokens", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+')) AS INTEGER) AS n FROM documents")
def tx02(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.count_tokens(F.col("text")).alias("n"))


CHUNKS = f"""w AS (SELECT doc_id, source, {WORDS.format("text")} AS w FROM documents),
c AS (SELECT doc_id, source, CAST(i / 150 AS INTEGER) AS chunk_index, array_to_string(w[i + 1 : i + 180], ' ') AS document
  FROM (SELECT doc_id, source, w, unnest(CASE WHEN len(w) <= 180 THEN [0] ELSE range(0, len(w), 150) END) AS i FROM w WHERE len(w) > 0))"""


@query("tx03_chunks", f"WITH {CHUNKS} SELECT doc_id, chunk_index, document FROM c")
def tx03(spark, sf_dir):
    return text.chunks(table(spark, sf_dir, "documents"), "text").select("doc_id", "chunk_index", "document")


@query("tx04_chunk_ids", f"WITH {CHUNKS} SELECT source || ':' || doc_id || ':' || chunk_index AS id, source AS entity, document FROM c")
def tx04(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    records = docs.select(F.col("source").alias("entity"), F.col("source").alias("label"), F.col("lang").alias("kind"), F.col("doc_id").cast("string").alias("pmid"), F.lit("").alias("title"), F.col("text").alias("abstract"))
    return text.chunk_rows(records).select("id", "entity", "document")


@query("tx05_word_count", f"SELECT source, CAST(sum(len({WORDS.format('text')})) AS BIGINT) AS words, count(*) AS documents FROM documents GROUP BY 1")
def tx05(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(text.word_count(F.col("text"))).alias("words"), F.count("*").alias("documents"))


@query("tx06_l2_normalise", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT vec_id, round(sqrt(list_sum(list_transform(list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))), lambda z: z * z))), 6) AS length, round(e[1] / sqrt(list_sum(list_transform(e, lambda y: y * y))), 6) AS first FROM e")
def tx06(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").select("vec_id", vector.normalised(F.col("embedding")).alias("v"))
    return own.select("vec_id", F.round(vector.norm(F.col("v")), 6).alias("length"), F.round(F.col("v")[0], 6).alias("first"))


NEAREST = """e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(1 - list_cosine_similarity(v.e, q.e), 12) AS d FROM e q, e v WHERE q.vec_id % 100 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS r FROM p QUALIFY r <= 5)"""


def searched(spark, sf_dir):
    """Queries are the vectors whose id is divisible by 100, against all vectors."""
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return vector.nearest(rows, rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query")), 5)


@query("tx07_cosine_top_k", f"WITH {NEAREST} SELECT query_id, CAST(r AS INTEGER) AS rank, id FROM n")
def tx07(spark, sf_dir):
    return searched(spark, sf_dir).select("query_id", "rank", "id")


@query("tx08_context_block", f"WITH {NEAREST} SELECT query_id, string_agg('[' || source || ' — PMID ' || doc_id || '] ' || text, chr(10) || chr(10) ORDER BY r) AS context, string_agg(printf('%.4f', d + 1e-9), ' ' ORDER BY r) AS distances FROM n JOIN documents ON doc_id = id GROUP BY 1")
def tx08(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("label"), F.col("source").alias("entity"), F.col("doc_id").cast("string").alias("pmid"), F.col("text").alias("document"))
    own = vector.context_block(searched(spark, sf_dir).join(docs, "id"))
    return own.select("query_id", "context", F.array_join(F.transform("distances", lambda d: F.format_string("%.4f", d + 1e-9)), " ").alias("distances"))


@query("tx09_file_name", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g') AS file FROM pages")
def tx09(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.file_name(F.col("url")).alias("file"))


@query("tx10_fingerprint", "SELECT doc_id, substr(sha256(text), 1, 16) AS fp FROM documents")
def tx10(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("fp"))


@query("tx11_markdown_cell", r"SELECT conv_id, turn, substr(replace(regexp_replace(text, '[\r\n]+', ' ', 'g'), '|', '\|'), 1, 80) AS cell FROM conversations")
def tx11(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.markdown_cell(F.col("text")).alias("cell"))


@query("tx12_model_family", "SELECT event_id, regexp_replace('model-' || event_type || CASE WHEN event_id % 2 = 0 THEN '-20250101' ELSE '' END, '-[0-9]{8}$', '') AS family FROM events")
def tx12(spark, sf_dir):
    name = F.expr("'model-' || event_type || if(event_id % 2 = 0, '-20250101', '')")
    return table(spark, sf_dir, "events").select("event_id", text.model_family(name).alias("family"))


@query("src06_escape", r"""SELECT doc_id, replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') AS escaped, text AS back FROM documents""")
def src06(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", text.escape(F.col("text")).alias("escaped"))
    return own.select("doc_id", "escaped", text.unescape(F.col("escaped")).alias("back"))


@query("jd01_contains_run", f"SELECT doc_id, item_id FROM (SELECT doc_id, ' ' || {NORM.format('text')} || ' ' AS h FROM documents) JOIN (SELECT item_id, {NORM.format('text')} AS p FROM benchmark) ON len(p) > 0 AND contains(h, ' ' || p || ' ')")
def jd01(spark, sf_dir):
    """Passages of benchmark in documents: all texts go through an automaton of all passages."""
    own = matching.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return own.select("doc_id", "item_id").distinct()


ANSWERS = "SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'"
NEGATION = judges.NEGATION.replace("'", "''")


def answers(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")


@query("jd02_string_match", f"SELECT doc_id, CASE WHEN contains(' ' || {NORM.format('text')} || ' ', ' ' || lang || ' ') THEN 1.0 ELSE 0.0 END AS score FROM documents")
def jd02(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", judges.string_match(F.col("text"), F.col("lang"))["score"].alias("score"))


@query("jd03_list_shape", rf"SELECT conv_id, turn, len(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '')) >= 2 OR regexp_matches(text, '(^|\n)\s*([-*•]|[0-9]+[.)])\s+') AS listed FROM ({ANSWERS})")
def jd03(spark, sf_dir):
    return answers(spark, sf_dir).select("conv_id", "turn", judges.looks_like_list(F.col("text")).alias("listed"))


@query("jd04_items", rf"""WITH l AS (SELECT conv_id, turn, list_transform(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> ''), lambda s: trim(regexp_replace(s, '^\s*([-*•]|[0-9]+[.)])\s+', ''))) AS l FROM ({ANSWERS})),
k AS (SELECT conv_id, turn, list_filter(l, lambda s: s <> '' AND NOT starts_with(s, '#') AND NOT ends_with(s, ':')) AS l FROM l)
SELECT conv_id, turn, array_to_string(list_filter(list_transform(flatten(list_transform(l, lambda s: regexp_split_to_array(s, '[;,]'))), lambda s: trim(s)), lambda s: s <> ''), '~') AS items FROM k""")
def jd04(spark, sf_dir):
    return answers(spark, sf_dir).select("conv_id", "turn", F.array_join(judges.split_items(F.col("text")), "~").alias("items"))


TRUTH = "['the', 'that is', 'zzz', lang]"


def truth():
    return F.array(F.lit("the"), F.lit("that is"), F.lit("zzz"), F.col("lang"))


@query("jd05_set_recall", f"SELECT doc_id, round(len(list_filter({TRUTH}, lambda g: contains(' ' || {NORM.format('text')} || ' ', ' ' || g || ' '))) / 4.0, 4) AS recall FROM documents")
def jd05(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", judges.set_match(F.col("text"), truth())["recall"].alias("recall"))


# Precision, F1 and the two branches, over lists of two lines made from each answer.
LISTED = f"""a AS (SELECT doc_id, [substr({NORM.format('text')}, 1, 12), 'that is', lang] AS items, {TRUTH} AS g, '- ' || substr({NORM.format('text')}, 1, 12) || chr(10) || '- that is, ' || lang AS answer FROM documents),
i AS (SELECT *, list_filter(items, lambda x: trim(x) <> '') AS k FROM a),
m AS (SELECT doc_id, CAST(len(list_filter(g, lambda y: contains(' ' || trim(regexp_replace(lower(answer), '[^0-9a-z]+', ' ', 'g')) || ' ', ' ' || y || ' '))) AS DOUBLE) / 4 AS r,
  CASE WHEN len(k) = 0 THEN 1.0 ELSE CAST(len(list_filter(k, lambda x: len(list_filter(g, lambda y: contains(' ' || trim(x) || ' ', ' ' || y || ' '))) > 0)) AS DOUBLE) / len(k) END AS p FROM i)"""


def listed(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    head = F.substring(text.normalize(F.col("text")), 1, 12)
    own = rows.select("doc_id", F.concat(F.lit("- "), head, F.lit("\n- that is, "), F.col("lang")).alias("answer"), truth().alias("g"))
    return own.select("doc_id", judges.set_match(F.col("answer"), F.col("g")).alias("j"))


@query("jd06_set_precision", f"WITH {LISTED} SELECT doc_id, round(p, 4) AS precision FROM m")
def jd06(spark, sf_dir):
    return listed(spark, sf_dir).select("doc_id", F.col("j.precision").alias("precision"))


@query("jd07_set_f1", f"WITH {LISTED} SELECT doc_id, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 4) AS f1, r = 1 AND p = 1 AS passed FROM m")
def jd07(spark, sf_dir):
    return listed(spark, sf_dir).select("doc_id", F.col("j.score").alias("f1"), F.col("j.passed").alias("passed"))


@query("jd08_prose", f"SELECT doc_id, contains(' ' || {NORM.format('text')} || ' ', ' the ') AS passed, CAST(NULL AS DOUBLE) AS precision FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents) WHERE NOT regexp_matches(text, '^\\s*([-*•]|[0-9]+[.)])\\s+')")
def jd08(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    own = rows.select("doc_id", judges.set_match(F.col("text"), F.array(F.lit("the"))).alias("j"))
    return own.where("j.basis = 'recall_only'").select("doc_id", "j.passed", "j.precision")


@query("jd09_numerical", r"SELECT doc_id, len(list_filter(regexp_extract_all(text, '[0-9][0-9,]*'), lambda x: TRY_CAST(replace(x, ',', '') AS HUGEINT) = 555)) > 0 AS passed FROM documents")
def jd09(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", judges.numerical(F.col("text"), F.lit("555"))["passed"].alias("passed"))


FOLDED = "translate(lower(text), '’‘ʼ', '''''''')"


@query("jd10_negation", f"SELECT conv_id, turn, regexp_matches({FOLDED}, '{NEGATION}') AS negated FROM conversations")
def jd10(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", judges.has_negation(F.col("text")).alias("negated"))


@query("jd11_binary", f"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN regexp_matches({FOLDED}, '{NEGATION}') ELSE NOT regexp_matches({FOLDED}, '{NEGATION}') END AS passed FROM conversations")
def jd11(spark, sf_dir):
    labels = F.when(F.col("turn") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", judges.binary(F.col("text"), labels)["passed"].alias("passed"))


@query("jd12_boolean", f"""WITH a AS (SELECT conv_id, turn, ' ' || {NORM.format('text')} || ' ' AS n, text FROM conversations),
b AS (SELECT conv_id, turn, contains(n, ' yes ') OR contains(n, ' true ') OR contains(lower(text), 'there is a path') AS y, contains(n, ' no ') OR contains(n, ' false ') OR regexp_matches({FOLDED}, '{NEGATION}') AS f FROM a)
SELECT conv_id, turn, y = f AS ambiguous, y <> f AND NOT y AS passed FROM b""")
def jd12(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", judges.boolean(F.col("text"), F.lit("false")).alias("j"))
    return own.select("conv_id", "turn", "j.ambiguous", "j.passed")


@query("jd13_dispatch", f"""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN CASE WHEN contains(' ' || {NORM.format('text')} || ' ', ' the ') THEN 1.0 ELSE 0.0 END
WHEN 1 THEN CASE WHEN regexp_matches({FOLDED}, '{NEGATION}') THEN 1.0 ELSE 0.0 END END AS score FROM conversations""")
def jd13(spark, sf_dir):
    kind = F.when(F.col("turn") % 3 == 0, "string_match").when(F.col("turn") % 3 == 1, "binary").otherwise("unknown")
    own = judges.judge(kind, F.col("text"), F.lit("the"), F.array().cast("array<string>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", own["score"].alias("score"))


@query("jd14_semantic", "SELECT conv_id, turn, trim(text) <> '' AND turn % 3 = 0 AS passed FROM conversations")
def jd14(spark, sf_dir):
    verdict = F.when(F.col("turn") % 3 == 0, "EQUIVALENT\nsame").when(F.col("turn") % 3 == 1, "DIFFERENT\nother").otherwise("NOT EQUIVALENT / DIFFERENT")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", judges.semantic(F.col("text"), verdict)["passed"].alias("passed"))


@query("jd15_judge_id", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'binary-v1' ELSE 'set_match-v1' END AS judge_id FROM conversations")
def jd15(spark, sf_dir):
    kind = F.when(F.col("role") == "user", "binary").otherwise("set_match")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", judges.judge_id(kind).alias("judge_id"))
