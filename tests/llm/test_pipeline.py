"""The pipeline's stages, each on what the stage before kept."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from kgspark.llm import bpe, pseudonyms
from kgspark.llm.queries import PII_KEY

from .test_brute_force import WORD, brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows after each stage, beginning with documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, docs, SF)
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        df.write.parquet(path)
        docs = spark.read.parquet(path)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        out.append(docs.collect())
    return out


def test_quality_keeps_good_documents(spark, steps):
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[1]}
    assert all((i in kept) == bool(q) for i, q in known.items()) and len(kept) < len(steps[0])
    assert {r for r in steps[1]} <= {r for r in steps[0]}


def test_one_of_each_group_of_near_copies_stays(steps):
    low = {i: c for i, _, c in brute_components([(r.doc_id, r.text) for r in steps[1]], 5, 80, 100)}
    assert sorted(r.doc_id for r in steps[2]) == sorted(i for i, c in low.items() if i == c)


def test_personal_values_are_replaced(steps):
    own = pseudonyms.Pseudonyms(PII_KEY)
    before = {r.doc_id: r for r in steps[2]}
    assert {r.doc_id: r.text for r in steps[3]} == {i: own.replace(r.text)[0] for i, r in before.items()}
    assert all(r.n_chars == len(r.text) for r in steps[3])


def test_mix_repeats_documents_by_source(steps):
    texts, sizes, taken = {r.doc_id: r.text for r in steps[3]}, Counter(), Counter()
    for r in steps[3]:
        sizes[r.source] += len(WORD.findall(r.text.encode()))
    for r in steps[4]:
        words = WORD.findall(r.text.encode())
        assert words == WORD.findall(texts[r.doc_id].encode())[: len(words)]
        taken[r.source] += len(words)
    assert max(Counter(r.doc_id for r in steps[4]).values()) <= 3
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    free = [s for s in sizes if taken[s] < 3 * sizes[s] - 1]
    shares = [taken[s] / weights[s] for s in free]
    assert max(shares) - min(shares) <= 2 and abs(sum(taken.values()) - sum(sizes.values())) <= len(sizes)


def test_tokens_decode_to_the_texts(steps):
    import public_tokenizers as P

    coder = bpe.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    got = sorted((r.doc_id, coder.decode(np.array(r.ids)).decode()) for r in steps[5])
    assert got == sorted((r.doc_id, r.text) for r in steps[4])


def test_run_gives_the_last_stage(spark, steps):
    assert corpus_pipeline.run(spark, SF).count() == len(steps[5])


def test_null_and_repeated_ids_cost_no_other_text(spark):
    words = lambda k, n=40: " ".join(f"{k}{i}" for i in range(n))
    rows = [
        (3, words("a"), "x"), (7, words("b"), "x"), (7, words("a") + " end", "x"),  # id 7: a text of its own, and a near copy of 3
        (None, words("c"), "x"), (None, words("d"), "x"), (None, words("d"), "x"), (None, words("a") + " stop", "x"),  # null ids
        (8, words("e"), "x"), (8, words("e"), "x"), (8, words("e"), None), (9, words("f"), "x"), (9, words("g"), "x"),
        (None, None, "x"), (None, None, "x"), (10, "", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.distinct(spark, docs, SF)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got == Counter([(3, words("a")), (7, words("b")), (None, words("c")), (None, words("d")), (8, words("e")), (9, words("f")), (9, words("g")), (None, None), (None, None), (10, "")])
    assert corpus_pipeline.distinct(spark, docs.limit(0), SF).count() == 0
