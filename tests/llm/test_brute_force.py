"""Operators against brute force, round trips, or held-out accuracy."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm import bpe, jaccard, mixing, pseudonyms, queries, quality, substrings, toxicity
from kgspark.llm.components import components
from kgspark.llm.embedding_dedup import Tile
from kgspark.llm.kernels import Words

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


def near_copies(spark, seed, n=60):
    """Random texts and copies with some words changed, so that similarities lie around the thresholds."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.7:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, max(1, len(words) // 30) + 1)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(999)}"
        else:
            words = [f"w{rng.randrange(40)}" for _ in range(rng.choice([1, 2, 3, 8, 30, 120, 300]))]
        rows.append((i, " ".join(words)))
    return rows


def brute_components(rows, n, num, den):
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").encode().translate(LOWER))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    low = {i: i for i in sets}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = list(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                p, q = root(i), root(j)
                low[max(p, q)] = min(p, q)
    return sorted((i, len(sets[i]), root(i)) for i in ids)


@pytest.mark.parametrize("n, num, block, common", [(3, 90, 512, 16), (5, 80, 512, 16), (2, 60, 4, 2)])
def test_jaccard(spark, n, num, block, common):
    for seed in (1, 2):
        rows = near_copies(spark, seed)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, jaccard.near_duplicates(df, n=n, num=num, den=100, block=block, common=common).collect())) == brute_components(rows, n, num, 100)


def test_jaccard_on_documents(spark, texts):
    got = sorted(map(tuple, queries.op5_ngram_jaccard(spark, SF).collect()))
    assert got == brute_components(list(texts.items()), 3, 90, 100)


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(5)
    for num in (60, 80, 90):
        for size in (1, 2, 5, 20, 57, 200, 1000):
            for _ in range(5):
                a = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
                drop = int(size * (100 - num) / 100 * rng.random())
                b = np.sort(np.concatenate((a[drop:], rng.integers(0, 1 << 64, int(drop * rng.random()), dtype=np.uint64))))
                both = len(np.intersect1d(a, b))
                if len(b) and 100 * both >= num * (len(a) + len(b) - both):
                    keys = [np.concatenate([k for _, k in jaccard.keys_of(x, num, 100)]) for x in (a, b)]
                    assert len(np.intersect1d(*keys))


def brute_repeats(rows, window):
    seen, words = Counter(), [(i, WORD.findall((t or "").encode())) for i, t in rows]
    for _, w in words:
        seen.update(tuple(w[s : s + window]) for s in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] > 1:
                gone[s : s + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window, shard", [(35, 200_000), (35, 200), (6, 100), (1, 1000)])
def test_substrings(documents, texts, window, shard):
    got = sorted(map(tuple, substrings.deduplicated(documents, window=window, shard_words=shard, keep_text=False).collect()))
    assert got == brute_repeats(texts.items(), window)


def test_substrings_within_a_text(spark):
    rows = [(1, "a b " * 30), (2, "x y z " + "p q r s " * 3 + "x y z t"), (3, "p q r s p q u x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (2, 3, 4, 7):
        got = sorted(map(tuple, substrings.deduplicated(df, window=window, shard_words=12, keep_text=False).collect()))
        assert got == brute_repeats(rows, window)


def test_bpe_as_the_library_does(texts):
    import public_tokenizers as P
    import tiktoken

    coder = bpe.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    odd = ["", " ", "  a\n\n b\t", "日本語 ไทย 😀", "a" * 3000, "abcxyz" * 500, "I'm we'll 'tis", "<|endoftext|>", " 　x", "\x00\x01"]
    for text in [*texts.values(), *odd]:
        ids = np.frombuffer(coder.encode(text), "<u4")
        assert ids.tolist() == own.encode_ordinary(text)
        assert coder.decode(ids).decode() == text
    assert all(coder.hash.find(t) == i for i, t in enumerate(coder.tokens)) and coder.hash.find(b"not a token at all") == -1


def test_feistel_is_a_permutation():
    own = pseudonyms.Feistel(b"key")
    for n in (1, 2, 3, 10, 1000):
        assert sorted(own.forward(i, n, b"t") for i in range(n)) == list(range(n))
        assert all(own.back(own.forward(i, n, b"t"), n, b"t") == i for i in range(n))


@pytest.mark.parametrize("text", ["+1 (017) 555-7713", "und.34@mail7.example.com", "97.51.17.173", "9807915762804490", "4111-1111-1111-1111", "2021-03-04", "31/12/1999", "12/31/1999", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce", "DE89 3704 0044 0532 0130 00", "123-45-6789"])
def test_formats_are_kept_and_restored(text):
    there, back = pseudonyms.Pseudonyms(b"k"), pseudonyms.Pseudonyms(b"k", True)
    out, counts = there.replace(f"see {text}, ok")
    shape = lambda s: re.sub("[a-f0-9]" if len(text) == 40 else "[0-9]", "9", re.sub("(?<![0-9a-f])[a-z]", "a", s) if "@" in s else s)
    assert out != f"see {text}, ok" and sum(counts.values()) == 1
    if "." not in text:
        assert shape(out) == shape(f"see {text}, ok")
    assert pseudonyms.Pseudonyms(b"k").replace(out)[1] == counts
    assert back.replace(out)[0] == f"see {text}, ok"


def test_clean_text_stays():
    for text in ("Version 2.0 of 2019", "31/02/2020 and 999.1.1.1", "CC BY-NC 4.0", "12345678", "a @ b", "1,000,000.50"):
        assert pseudonyms.Pseudonyms(b"k").replace(text) == (text, {})


CARD, IBAN = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"


@pytest.mark.parametrize("value", [CARD, "4111-1111-1111-1111", "4111111111111111", "3782 822463 10005", IBAN, IBAN.replace(" ", ""), "+44 20 7946 0958", "123-45-6789", "97.51.17.173", "2021-03-04", "und.34@mail7.example.com", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"])
@pytest.mark.parametrize("beside", ["{} 2027", "{} 123", "{} BIC", "{} BIC CODE 2027", "NR12 {}", "1234 5678 9012 {}", "{} 2027-01-01", "{} " + CARD])
def test_values_beside_digits_and_capitals(value, beside):
    there = pseudonyms.Pseudonyms(b"k")
    alone, text = there.replace(value)[0], beside.format(value)
    if value.startswith("+") and beside == "{} 123":
        return  # that is a longer telephone number
    out = there.replace(text)[0]
    assert alone != value and alone in out and value not in out
    assert CARD not in out and "2027-01-01" not in out
    if "1234" not in beside and "NR12" not in beside:
        assert pseudonyms.Pseudonyms(b"k", True).replace(out)[0] == text


def test_values_behind_what_is_not_valid():
    there = pseudonyms.Pseudonyms(b"k")
    secret = "AB12CDEF0123456789ABCDEF01234567"
    assert secret not in there.replace(secret)[0]  # not an IBAN, but hex
    assert "123-45-6789" not in there.replace("1234 5678 9012 123-45-6789")[0] and "-6789" not in there.replace("1234 5678 9012 123-45-6789")[0]
    assert ".0.0.1" not in there.replace("+1 555 123 4567 10.0.0.1")[0]
    long = "1234 5678 9012 3456 789"  # a number of 19 digits
    out, counts = there.replace(long)
    assert counts == {"number": 1} and pseudonyms.Pseudonyms(b"k", True).replace(out)[0] == long


def test_pii_of_documents_goes(spark, texts):
    find = re.compile(r"\b\d{16}\b|[\w.]+@[\w.]+\.\w+|\+\d \(\d{3}\) \d{3}-\d{4}|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b[0-9a-f]{40}\b")
    for r in queries.op4_pseudonyms(spark, SF).collect():
        before, after = find.findall(texts[r.doc_id]), find.findall(r.text)
        assert len(before) == len(after) and not set(before) & set(after)
        assert (r.text == texts[r.doc_id]) == (not r.pii)


def test_mix_meets_its_targets(spark, documents):
    rows = queries.op3_mixing(spark, SF).join(documents.select("doc_id", "source"), "doc_id").collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.size * (len(r.shards) - 1) <= r.taken <= r.size * len(r.shards) <= 3 * r.size
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    for s in sizes:
        assert target[s] <= 3 * sizes[s] + 1e-9 and 0 <= target[s] - taken[s] < 1
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    free = [s for s in sizes if target[s] < 3 * sizes[s] - 1e-9]
    assert len({round(target[s] / weights[s], 6) for s in free}) <= 1
    mix = mixing.mixed(documents, n_shards=5)
    words = Counter()
    for r in mix.collect():
        words[r.source] += len(WORD.findall(r.text.encode()))
    assert words == +taken
    again = queries.op3_mixing(spark, SF).collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in queries.op3_mixing(spark, SF).collect())


def test_quotas_split_exactly():
    quotas = [7, 0, 100, 31]
    for shards in (1, 3, 8):
        split = mixing.split_quotas(quotas, shards, 4)
        assert split.sum(0).tolist() == quotas and split.min() >= 0 and np.ptp(split.sum(1)) <= shards
    assert mixing.fill_targets([10, 10, 1000], [1, 2, 3], 3.0) == [30.0, 30.0, 960.0]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(70)]
    low = {x: x for e in edges for x in e}
    for _ in range(300):
        for u, v in edges:
            low[u] = low[v] = min(low[u], low[v])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert all(got.get(x, x) == c for x, c in low.items())


def test_tile_links_are_those_of_brute_force():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 20))
    x[50:] = x[rng.integers(0, 50, 100)] + rng.normal(size=(100, 20)) * 0.25
    names, weights = np.arange(150), rng.integers(1, 4, 150)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    want = ((cos >= 0.9) & ~np.eye(150, dtype=bool)) @ weights
    tile = Tile((names, weights, x), (names, weights, x), np.linalg.qr(rng.normal(size=(20, 20)))[0], 0.9, True)
    tile.run()
    assert (tile.count_a == want).all()
    left, right = (names[:70], weights[:70], x[:70]), (names[70:], weights[70:], x[70:])
    tile = Tile(left, right, np.eye(20), 0.9, False)
    tile.run()
    assert (tile.count_a == (cos[:70, 70:] >= 0.9) @ weights[70:]).all()


def test_words_are_those_of_the_contract():
    for text in (b"", b" ", b"a", b" a\tb\n\x0bc\x0c\rd ", "é x 　y".encode()):
        own = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert [text[s:e] for s, e in zip(own.starts, own.ends)] == WORD.findall(text)


@pytest.mark.parametrize("module, label, least, query", [(toxicity, "toxic", 0.5, queries.op2_toxicity), (quality, "quality", 0.7, queries.op10_quality)])
def test_held_out_accuracy(spark, module, label, least, query):
    sf = "/root/testdata/sf0.1"
    known = spark.read.parquet(f"{sf}/labels.parquet")
    rows = query(spark, sf).where("held_out").join(known, "doc_id").select("score", "predicted", F.col(label).alias("label")).collect()
    assert sum(r.predicted == r.label for r in rows) / len(rows) > 0.97
    assert all((r.score >= least) == bool(r.predicted) for r in rows)
