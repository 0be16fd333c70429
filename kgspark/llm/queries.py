"""The thin registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import bpe, covertree, divergence, embedding_dedup, jaccard, mixing, mpegts, pseudonyms, quality, shared, substrings, toxicity, warc, whitening


PII_KEY = b"set a secret of your own"  # of op4 and of the pipeline where the session names none


def pii_key(spark: SparkSession) -> bytes:
    """The secret key of pseudonyms: the session's ``spark.kgspark.pii.key``, which a deployment sets."""
    own = spark.conf.get("spark.kgspark.pii.key", None)
    if not own:
        warnings.warn("spark.kgspark.pii.key is not set: pseudonyms are made with a key that is public", stacklevel=2)
    return own.encode() if own else PII_KEY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shared.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc(column: str = "doc_id") -> Column:
    """crc32 of an id as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def classified(scored: DataFrame, held_out: Column, least: float) -> DataFrame:
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", F.expr(f"int(score >= {least})").alias("predicted"))


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, p.vec_id, CAST(list_sum(list_transform(list_zip(q.e, p.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v p ON q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"), crc() % 5 != 0)
    return classified(toxicity.scored(documents.select("doc_id", "text"), model), crc() % 5 == 0, 0.5)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.with_shards(*mixing.drawn(table(spark, sf_dir, "documents").select("doc_id", "text", "source")), 64, 0)
    return rows.select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), mixing.taken().alias("taken"), F.col("_mix_shards").alias("shards"))


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(table(spark, sf_dir, "documents"), pii_key(spark))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encoded(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep_ids=False)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
c(vec_id, low) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.v, c.low FROM c JOIN l ON l.u = c.vec_id),
m AS (SELECT vec_id, min(low) AS component_id FROM c GROUP BY 1),
n AS (SELECT u, count(*) AS k FROM l GROUP BY 1)
SELECT m.vec_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_links, m.component_id, m.vec_id = m.component_id AS kept FROM m LEFT JOIN n ON n.u = m.vec_id
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.records(warc.read_chunks(spark, manifest, with_data=False)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN refers IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers AS refers_to
FROM (SELECT page_id, html, CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id IS DISTINCT FROM max(page_id) OVER (PARTITION BY html)
      THEN max(page_id) OVER (PARTITION BY html) END AS refers FROM pages)
"""


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents"), window=35, keep_text=False)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.fit(documents, table(spark, sf_dir, "labels"), crc() % 4 != 2)
    return classified(quality.scored(documents.select("doc_id", "text"), model), crc() % 4 == 2, 0.7)


def op11_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.read_back(mpegts.stored(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
w AS (SELECT lang, source, r, unnest(t) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang, count(k.term) AS v, coalesce(sum(k.n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN k USING (lang) GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN (SELECT lang, term FROM k) USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.total + 5 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (v.total + 5 * v.v) AS q
      FROM s JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM
(SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o) WHERE part = 'pair' OR rank <= 50
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is null where it has more than 63 bits, from about a million vectors on; the operator's own is exact."""
    return whitening.whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS long)"))


WORDS_SQL = r"""w AS (SELECT doc_id, u.i, u.word FROM (SELECT doc_id, list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents) d,
  LATERAL (SELECT unnest(l) AS word, generate_subscripts(l, 1) AS i) u)"""

OP5_SQL = f"""
WITH RECURSIVE {WORDS_SQL.replace("{text}", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
g AS (SELECT doc_id, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, g FROM g WHERE g IS NOT NULL UNION ALL SELECT doc_id, string_agg(word, ' ' ORDER BY i) FROM w JOIN n USING (doc_id) WHERE n < 3 GROUP BY 1),
k AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN k a ON a.doc_id = u JOIN k b ON b.doc_id = v WHERE 100 * shared >= 90 * (a.k + b.k - shared)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
c(doc_id, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.v, c.low FROM c JOIN e ON e.u = c.doc_id)
SELECT c.doc_id, CAST(coalesce(any_value(k.k), 0) AS BIGINT) AS n_shingles, min(low) AS component_id FROM c LEFT JOIN k USING (doc_id) GROUP BY 1
"""

OP9_SQL = f"""
WITH {WORDS_SQL.replace("{text}", "coalesce(text, '')")},
g AS (SELECT doc_id, i, string_agg(word, ' ') OVER o AS g, count(*) OVER o AS n FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
r AS (SELECT doc_id, i FROM g WHERE n = 35 QUALIFY count(*) OVER (PARTITION BY g) > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
k AS (SELECT w.doc_id, count(*) AS n_words, count(x.i) AS n_removed, coalesce(string_agg(w.word, ' ' ORDER BY w.i) FILTER (x.i IS NULL), '') AS kept FROM w LEFT JOIN x ON x.doc_id = w.doc_id AND x.i = w.i GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN k USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cover_tree": op1_cover_tree,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_pseudonyms": op4_pseudonyms,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_warc": op8_warc,
    "op9_substrings": op9_substrings,
    "op10_quality": op10_quality,
    "op11_mpegts": op11_mpegts,
    "op12_divergence": op12_divergence,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op1_cover_tree": OP1_SQL,
    "op5_ngram_jaccard": OP5_SQL,
    "op7_embedding_dedup": OP7_SQL,
    "op8_warc": OP8_SQL,
    "op9_substrings": OP9_SQL,
    "op12_divergence": OP12_SQL,
}
