"""Nulls, empty and very long texts, ties and repeated rows, empty tables, and clashing columns."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from kgspark.llm import bpe, covertree, embedding_dedup, jaccard, mixing, pseudonyms, quality, substrings, toxicity, warc

LONG = "wort und " * 60_000
DOCS = [(1, "a b c d e f", "en"), (2, None, None), (3, "", "en"), (4, "   \n\t ", "de"), (1, "a b c d e f", "en"), (None, "x y z", "en"), (5, LONG, None), (6, "é" * 3000, "fr"), (6, "another text", "fr")]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with all that is odd, and columns whose names the operators use themselves."""
    rows = spark.createDataFrame([(*r, "x", 1.0, 7, "row", None) for r in DOCS], SCHEMA + ", id string, score double, size int, row string, tid string")
    return rows


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_bpe(docs, none):
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encoded(docs, path, P.PATTERN).collect()
    assert len(out) == len(DOCS)
    for r in out:
        assert r.n_tokens == len(r.ids)
    assert {r.n_tokens for r in out if r.doc_id in (2, 3)} == {0}
    back = bpe.decoded(bpe.encoded(docs, path, P.PATTERN), path, P.PATTERN)
    assert sorted(bytes(r.data) for r in back.collect()) == sorted((t or "").encode() for _, t, _ in DOCS)
    assert bpe.encoded(none, path, P.PATTERN).count() == 0


def test_substrings(docs, none):
    out = substrings.deduplicated(docs, window=4).collect()
    assert len(out) == len(DOCS)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.n_removed for r in by[1]] == [6, 6]
    assert (by[2][0].n_words, by[3][0].n_words, by[4][0].n_words) == (0, 0, 0)
    assert by[None][0].kept == "x y z"
    assert by[5][0].n_words == by[5][0].n_removed == 120_000
    assert {r.kept for r in by[6]} == {"é" * 3000, "another text"}
    assert substrings.deduplicated(none).count() == 0


def test_jaccard(docs, none):
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, n=3).collect()), key=str)
    assert len(out) == len(DOCS)
    assert (1, 4, 1) in out and (2, 0, 2) in out and (3, 0, 3) in out and (4, 0, 4) in out
    assert (None, 1, None) in out and (5, 2, 5) in out
    assert jaccard.near_duplicates(none).count() == 0


def test_mixing(docs, none):
    rows, sources = mixing.drawn(docs)
    assert rows.count() == len(DOCS)
    assert [s.name for s in sources] == ["de", "en", "fr", None]
    assert math.isclose(sum(s.target for s in sources), sum(s.size for s in sources))
    for r in rows.collect():
        assert r._mix_copies <= 3 and (r.text is not None or r._mix_size == 0)
    mix = mixing.mixed(docs, n_shards=3)
    assert mix.columns == [*docs.columns, "shard"]
    assert mix.count() == sum(r._mix_copies for r in rows.collect())
    assert mixing.mixed(none).count() == 0


def test_pseudonyms(spark, none):
    rows = [(1, None), (2, ""), (3, "no values here"), (4, "id 4111 1111 1111 1111"), (5, "pay 4111 1111 1111 1111 now"), (6, "x " * 200_000 + "a@b.org")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("n", F.lit("n"))
    out = {r.doc_id: r for r in pseudonyms.pseudonymised(df, b"k").collect()}
    assert out[1].text is None and out[2].text == "" and out[3].text == "no values here" and out[3].pii == {}
    assert out[4].text[3:] == out[5].text[4:-4] != "4111 1111 1111 1111"
    assert out[6].pii == {"email": 1} and not out[6].text.endswith("a@b.org")
    back = pseudonyms.pseudonymised(pseudonyms.pseudonymised(df, b"k"), b"k", back=True)
    assert sorted(map(str, (r.text for r in back.collect()))) == sorted(str(t) for _, t in rows)
    assert pseudonyms.pseudonymised(none, b"k").count() == 0


@pytest.mark.parametrize("module, features", [(quality, 1), (toxicity, 1)])
def test_classifiers_take_anything(spark, docs, none, module, features):
    for known in (labels(spark), labels(spark, [(1, 1, 0), (3, 0, 1), (5, None, None), (None, 1, 1), (6, 1, 1)])):
        model = module.fit(docs, known, F.lit(True))
        out = module.scored(docs, model).collect()
        assert len(out) == len(DOCS) and all(0 <= r.score <= 1 for r in out)
        assert module.scored(none, model).count() == 0
    assert module.scored(docs, model, score_col="own").columns == [*docs.columns, "own"]


def test_warc(spark):
    big = "x" * 200_000
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", "a" * 1500), (2, None, "a" * 1500), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", big), (8, "é ü", "ü" * 700), (None, "u", big)], "page_id long, url string, html string").withColumn("digest", F.lit(1))
    manifest = warc.write_archives(pages, file_bytes=1000)
    assert manifest.count() > 1
    chunks = warc.read_chunks(spark, manifest, chunk_bytes=4096)
    out = {r.page_id: r for r in warc.records(chunks).collect()}
    assert len(out) == 9
    assert (out[1].record_type, out[1].refers_to, out[2].record_type) == ("revisit", 2, "response")
    assert (out[None].record_type, out[None].refers_to, out[None].payload_bytes) == ("revisit", 7, 200_000)
    assert out[3].payload_bytes == out[4].payload_bytes == 0
    assert out[5].record_type == out[6].record_type == "response"
    assert out[8].payload_bytes == 1400 and out[8].payload_digest == hashlib.sha1(("ü" * 700).encode()).hexdigest()
    parts = [bytes(r.data) for r in chunks.where("page_id = 7").orderBy("chunk").collect()]
    assert b"".join(parts) == big.encode() and max(map(len, parts)) == 4096
    assert warc.read_chunks(spark, warc.write_archives(pages.limit(0))).count() == 0


VECTORS = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [1.0, 0.001]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [0.0, 0.0]), (6, [0.0, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0, 2.0, 3.0]), (9, []), (10, [float("inf"), 0.0])]


def test_cover_tree(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("q", F.lit(0))
    out = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in covertree.top_k(df, F.col("vec_id") % 50 == 0, k=3).collect())
    assert out == [(0, 1, 1, 65536), (0, 2, 7, 65536), (0, 3, 50, 65536), (50, 1, 0, 65536), (50, 2, 1, 65536), (50, 3, 7, 65536)]
    assert covertree.top_k(df.limit(0), F.lit(True)).count() == 0


def test_embedding_dedup(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>").withColumn("name", F.lit("x"))
    out = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect())
    assert out == [(0, 4, 0, True), (1, 4, 0, False), *[(i, 0, i, True) for i in (2, 3, 4, 5, 6)], (7, 4, 0, False), (7, 4, 0, False), (8, 0, 8, True), (9, 0, 9, True), (10, 0, 10, True), (50, 4, 0, False)]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
