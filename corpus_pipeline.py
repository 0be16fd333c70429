"""Corpus pipeline: stages that each apply one operator to all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return the
columns of ``documents``, and those further ones that docs have: a stage sees
them as one column, so their names clash with nothing.

Odd inputs: null and empty texts, and labels of other ids, are scored and mixed
like others (a null text has no words: it is no copy of another and is taken 0
words, so the mix leaves it out); null ids, repeated ids and repeated rows are
told apart by the whole row; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kgspark.llm import bpe, jaccard, mixing, pseudonyms, quality, shared
from kgspark.llm.queries import pii_key

LEAST_QUALITY = 0.5


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents whose score is under LEAST_QUALITY go; null and empty texts have a score like others."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return quality.scored(docs, model, score_col="score").where(F.col("score") >= LEAST_QUALITY).drop("score")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near duplicates (5 words, 0.8) one row stays, all texts without words stay.

    It is the row of the least id (null ids come last), of rows that share it the
    one of the least hash of all columns.  Rows are told apart by id and hash, so
    neither null nor repeated ids cost a text that is no near copy.
    """
    # (nulls are marked: the hash passes over them)
    content = F.xxhash64(*[F.col(c) for c in docs.columns], *[F.col(c).isNull() for c in docs.columns])
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), content.alias("hash"), "text")
    rows = own.select(F.struct(F.col("id").isNull().alias("no_id"), "id", "hash").alias("key"), "text")
    classes = shared.only(lambda: jaccard.near_duplicates(rows, id_col="key", n=5, num=80, den=100), "near")
    kept = classes.where(F.col("key") == F.col("component_id")).groupBy(F.col("key.id").alias("kept_id"), F.col("key.hash").alias("kept_hash"))
    kept = kept.agg((F.count_if(F.col("n_shingles") > 0) > 1).alias("copies"))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash"))
    copies = kept.where("copies")
    if copies.isEmpty():
        out = own.join(kept, same, "left_semi").select("row.*")
    else:  # whole rows repeat: one of each stays
        once = own.join(kept.where("not copies"), same, "left_semi")
        out = once.union(own.join(copies, same, "left_semi").dropDuplicates(["id", "hash"])).select("row.*")
    out._kgspark_until_written = [classes]
    return out


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: personal values become format-preserving pseudonyms."""
    out = pseudonyms.pseudonymised(docs, pii_key(spark), counts_col=None)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: a row for each time that the mix takes a document."""
    return mixing.mixed(docs).drop("shard").withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: the ids of every document, checked by decoding them."""
    import public_tokenizers

    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage(function: Callable) -> Callable:
    """The stage in a session whose batches suit long texts, docs' further columns being one (``rest``) within it."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shared.small_batches(spark)
        more = [c for c in docs.columns if c not in COLUMNS]
        if not more:
            return function(spark, docs, sf_dir)
        out = function(spark, docs.select(*[c for c in docs.columns if c in COLUMNS], F.struct(*[F.col(f"`{c}`") for c in more]).alias("rest")), sf_dir)
        if "rest" not in out.columns:
            return out
        back = out.select(*[F.col(f"rest.`{c}`" if c in more else c).alias(c) for c in docs.columns])
        back._kgspark_until_written = getattr(out, "_kgspark_until_written", [])
        return back

    return run


STAGES = [
    ("quality classifier", stage(good)),
    ("n-gram Jaccard join", stage(distinct)),
    ("PII", stage(private)),
    ("mixing sources to target weights", stage(mixture)),
    ("byte-level BPE encoding and decoding", stage(tokens)),
]

ORACLE_SQL = None  # the trained classifier, the keyed permutation and the encoder are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, function) in enumerate(STAGES):
        before, docs = docs, function(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            done = [before, *getattr(docs, "_kgspark_until_written", [])]
            docs = shared.written(docs, "stage")
            for table in done:  # (the documents themselves are no table of ours)
                shared.drop(table)
    return docs
