"""Transport streams, divergence of sources, and whitening, against plain versions and damaged or odd inputs."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm import divergence, mpegts, queries, whitening

SF = "/root/testdata/sf0.001"


# --- MPEG transport streams


def plain_reader(media):
    """The payload of pid 256, packet by packet."""
    out, unit = [], b""
    for at in range(0, len(media), 188):
        p = media[at : at + 188]
        assert p[0] == 0x47
        if (p[1] & 31) << 8 | p[2] != 256:
            continue
        start = 4 + (1 + p[4] if p[3] & 32 else 0)
        if p[1] & 64 and unit:
            out.append(unit)
            unit = b""
        unit += p[start:]
    out.append(unit)
    for u in out:
        assert u[:4] == b"\0\0\1\xbd" and int.from_bytes(u[4:6], "big") == len(u) - 6
    return b"".join(u[9 + u[8] :] for u in out)


@pytest.mark.parametrize("size", [1, 2, 150, 161, 162, 163, 169, 170, 171, 183, 184, 185, 192, 3071, 3072, 3073, 3090, 200_001])
def test_streams_keep_every_byte(size):
    data = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes()
    media = mpegts.mux(data)
    assert len(media) % 188 == 0 and plain_reader(media) == data
    got = mpegts.demux(media)
    (stream,) = got.streams
    assert stream.payload == data and (got.lost_bytes, got.bad_tables, stream.gaps, stream.repeated) == (0, 0, 0, 0)
    units = -(-size // 3072)
    assert [u.pts for u in stream.units] == [126_000 + 3600 * i for i in range(units)] == [u.dts for u in stream.units]
    assert [u.random_access for u in stream.units] == [i % 8 == 0 for i in range(units)] and stream.clocks == -(-units // 8)
    assert [u.offset for u in stream.units] == list(range(0, size, 3072)) and not any(u.broken for u in stream.units)


def as_packets(media):
    return [media[i : i + 188] for i in range(0, len(media), 188)]


def test_damaged_streams():
    data = bytes(range(256)) * 120
    whole = as_packets(mpegts.mux(data))
    read = lambda parts: mpegts.demux(b"".join(parts))
    # a lost packet ends its unit; the others are whole
    lost = read(whole[:30] + whole[31:]).streams[0]
    assert lost.gaps == 1 and [u.broken for u in lost.units].count(True) == 1
    kept = [lost.payload[u.offset : u.offset + u.bytes] for u in lost.units if not u.broken]
    assert all(k in data and len(k) == 3072 for k in kept) and len(kept) == len(lost.units) - 1
    # a packet sent twice
    twice = read(whole[:30] + whole[29:]).streams[0]
    assert (twice.repeated, twice.gaps, twice.payload) == (1, 0, data)
    # bytes between packets, at the beginning, and a cut end
    noise = read([b"\x01\x02\x47", *whole[:9], b"noise", *whole[9:], whole[0][:50]])
    assert noise.lost_bytes == 3 + 5 + 50 and noise.streams[0].payload == data
    # a table with a wrong checksum is passed over, a later one counts
    bad = [whole[0][:20] + bytes([whole[0][20] ^ 1]) + whole[0][21:], *whole[1:]]
    assert read(bad).bad_tables == 1 and read(bad).streams[0].payload == data
    none = [bytes([*p[:7], p[7] ^ 255, *p[8:]]) if p[1:3] == b"\x40\x00" else p for p in whole]
    assert read(none).streams == [] and read(none).bad_tables > 0
    # packets without payload don't count, their counter stands
    empty = bytes([0x47, whole[29][1] & 0x1F, whole[29][2], 0x20 | whole[29][3] & 15, 183, 0]) + b"\xff" * 182
    assert read(whole[:30] + [empty] + whole[30:]).streams[0].payload == data
    # a marked discontinuity is no gap
    jump = bytes([0x47, 1, 0, 0x20 | 9, 183, 0x80]) + b"\xff" * 182
    assert read(whole[:30] + [jump] + [bytes([*p[:3], p[3] & 0xF0 | (p[3] + 9 - (whole[29][3] & 15)) & 15, *p[4:]]) if p[1:3] != b"\x40\x00" and p[2] == 0 and p[1] & 0x1F == 1 else p for p in whole[30:]]).streams[0].gaps == 0
    assert mpegts.demux(b"").streams == [] and mpegts.demux(b"no stream at all" * 40).lost_bytes == 640


def test_programs_unbounded_units_and_decoding_times():
    """Two programs; a video stream whose elementary packets have no length, one time stamp that wraps, and tables over two packets."""
    tick = lambda t, mark: mpegts.tick_bytes(t, mark)
    video = b"\0\0\1\xe0\0\0\x80\xc0\x0a" + tick((1 << 33) + 5, 3) + tick((1 << 33) - 7, 1) + b"V" * 500
    audio = b"\0\0\1\xc0" + (8 + 40).to_bytes(2, "big") + b"\x80\x80\x05" + tick(99, 2) + b"A" * 40
    info = b"\x05" + bytes([200]) + b"x" * 200  # a long descriptor
    entry = lambda kind, pid, more=b"": bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + (0xF000 | len(more)).to_bytes(2, "big") + more
    head = (0xE000 | 0x50).to_bytes(2, "big") + b"\xf0\x00"
    tables = {0: mpegts.section(0, 1, b"\0\0\xe0\x10" + b"\0\1" + (0xE000 | 0x30).to_bytes(2, "big") + b"\0\2" + (0xE000 | 0x31).to_bytes(2, "big")), 0x30: mpegts.section(2, 1, head + entry(0x1B, 0x50, info)), 0x31: mpegts.section(2, 2, head + entry(0x0F, 0x60))}

    def sent(pid, data, pointer):
        out, data = [], (b"\0" if pointer else b"") + data
        for n, at in enumerate(range(0, len(data), 184)):
            part, spare = data[at : at + 184], 184 - len(data[at : at + 184])
            fill = b"" if not spare else bytes([spare - 1]) + (b"\0" + b"\xff" * (spare - 2) if spare > 1 else b"")
            out.append(bytes([0x47, (0x40 if n == 0 else 0) | pid >> 8, pid & 255, (0x30 if spare else 0x10) | n & 15]) + fill + part)
        return b"".join(out)

    media = b"".join(sent(p, t, True) for p, t in tables.items()) + sent(0x50, video, False) + sent(0x60, audio, False) + sent(0x1FFF, b"null", False)
    got = mpegts.demux(media)
    assert [(s.program, s.pid, s.stream_type, s.payload) for s in got.streams] == [(1, 0x50, 0x1B, b"V" * 500), (2, 0x60, 0x0F, b"A" * 40)]
    assert (got.streams[0].units[0].pts, got.streams[0].units[0].dts) == (5, (1 << 33) - 7) and got.streams[1].units[0].pts == 99
    assert got.bad_tables == 0 and mpegts.feature(got).count("program") == 2


def test_media_columns(spark, tmp_path):
    rows = [(1, "a b"), (2, None), (3, ""), (4, "x" * 192), (5, "é" * 300_000), (5, "a b"), (None, "ü")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("z"), "media": F.lit(1), "n_bytes": F.lit("q")})
    table = mpegts.stored(docs)
    got = mpegts.read_back(table, units=True, payload=True).collect()
    assert len(got) == len(rows)
    want = collections.Counter((i, (t or "").encode()) for i, t in rows)
    assert collections.Counter((r.id, bytes(r.payload)[: r.n_bytes]) for r in got) == want
    for r in got:
        data = bytes(r.payload)
        assert len(data) == r.payload_bytes and r.payload_bytes % 192 == 0 < r.payload_bytes and not data[r.n_bytes :].strip(b" ")
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest() and r.tail_crc32 == zlib.crc32(data[-16:])
        assert sum(u.bytes for u in r.units) == len(data) and r.media_bytes % 188 == 0
    same = [r[2:] for r in got if bytes(r.payload).strip() == b"a b"]
    assert len(same) == 2 and same[0] == same[1]
    assert mpegts.read_back(mpegts.stored(docs.limit(0))).count() == 0
    (tmp_path / "a.ts").write_bytes(mpegts.mux(b"film" * 5000))
    assert mpegts.read_back(mpegts.files(spark, str(tmp_path)), payload=True).first().payload == b"film" * 5000


def test_query_of_streams_on_documents(spark):
    texts = collections.Counter((r.doc_id, hashlib.sha256(mpegts.padded(r.text.encode())).hexdigest()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = queries.op11_mpegts(spark, SF)
    assert got.columns[:8] == ["doc_id", *[c.split()[0] for c in mpegts.DIGESTS.split(", ")]]
    assert collections.Counter((r.doc_id, r.payload_sha256) for r in got.collect()) == texts


# --- divergence of sources

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_audit(rows, least, ranks):
    group, df = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOW))
        group[lang or "", source or ""].update(terms)
        df.update((lang or "", t) for t in set(terms))
    out = []
    for lang in {g for g, _ in group}:
        kept = sorted(t for l, t in df if l == lang and df[l, t] >= least)
        counts = {s: [group[g, s][t] for t in kept] for g, s in group if g == lang}
        share = lambda c: [1 + 10**9 * (n + 5) // (sum(c) + 5 * len(kept)) for n in c]
        p = {s: share(c) for s, c in counts.items()}
        q = share([sum(x) for x in zip(*counts.values())] if kept else [])
        for s in p:
            pairs = sorted((-sum(abs(a - b) for a, b in zip(p[s], p[o])), o.encode(), o) for o in p if o != s)
            terms = sorted((q_ - p_, t.encode(), t) for t, p_, q_, n in zip(kept, p[s], q, counts[s]) if n > 0 and p_ > q_)[:ranks]
            out += [(lang, s, part, x, -v, i + 1) for part, own in (("pair", pairs), ("term", terms)) for i, (v, _, x) in enumerate(own)]
    return sorted(out)


@pytest.mark.parametrize("bucket, tile", [(4096, 64), (3, 2), (1, 1)])
def test_divergence(spark, bucket, tile):
    rng = np.random.default_rng(bucket)
    rows = [(" ".join(f"{'Wort' if k % 3 else 'é'}{'abcdefghij'[k]}" for k in rng.zipf(1.5, rng.integers(0, 40)) % 10) + " 12,x_y", ["en", "de", None][i % 3], ["s", "t", None, "ü", "z", "S"][int(rng.integers(0, 6))]) for i in range(300)]
    rows += [(None, "en", "only empty"), ("", "alone", "one"), ("", "two", "a"), ("7 8 9", "two", "b"), ("a a a b", "few", "x"), ("a c", "few", "y"), ("b " * 50_000, "en", "s")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "n": F.lit("x"), "rank": F.lit(0), "item": F.lit("i")})
    for least, ranks in ((3, 4), (30, 50)):
        got = sorted(map(tuple, divergence.audit(df, least=least, ranks=ranks, bucket=bucket, tile=tile).collect()))
        assert got == plain_audit(rows, least, ranks)
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, kept = 123_456_789_012_345_678, 9_000_000_000_000_000_001, 3_000_000_007
    row = spark.createDataFrame([(n, total, kept)], "n long, total long, kept long").select(divergence.share(F.col("n"), F.col("total"), F.col("kept"))).first()
    assert row[0] == 1 + 10**9 * (n + 5) // (total + 5 * kept)


def test_divergence_on_documents_is_its_twin(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.op12_divergence(spark, SF)
    twin = duck.sql(queries.OP12_SQL)
    assert got.columns == twin.columns and sorted(map(tuple, got.collect())) == sorted(twin.fetchall())


# --- whitening


def plain_whitening(rows, components=8):
    usable = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024.0 * c)) + 100_000 for c in v] for _, v in usable], object)
    n, sums = len(x), x.sum(0)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(r, sums))) for r in x]
    centred = (x - np.array([s / n for s in sums], object)).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    return usable, n, deviation, centred @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening(spark):
    rng = np.random.default_rng(5)
    rows = [(i, list(map(float, v))) for i, v in enumerate(rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)) * 0.1)]
    odd = [(900, None), (901, [None] * 12), (902, [float("nan")] + [0.0] * 11), (903, [float("-inf")] + [0.0] * 11), (904, [])]
    df = spark.createDataFrame(rows + rows[:3] + odd, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "component": F.lit("c"), "v": F.lit(0)})
    got = whitening.whitened(df).collect()
    usable, n, deviation, want, share = plain_whitening(rows + rows[:3] + odd)
    assert n == 403 and len(got) == 403 * 8 and {r.n for r in got} == {403} and {r.vec_id for r in got} == {i for i, _ in usable}
    by = {(r.vec_id, r.component): r for r in got}
    assert {r.vec_id: int(r.deviation) for r in got} == {i: d for (i, _), d in zip(usable, deviation)}
    for k in range(8):
        own = np.array([by[i, k + 1].whitened for i, _ in rows])
        assert min(np.abs(own - want[:400, k]).max(), np.abs(own + want[:400, k]).max()) < 1e-6
        assert abs(by[0, k + 1].explained - share[k]) <= 1e-4 * share[k]
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_of_little(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    assert [(r.component, r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in whitening.whitened(one).orderBy("component").collect()] == [(k, 0.0, 0.0, 0.0, 0) for k in (1, 2, 3)]
    assert whitening.whitened(one.limit(0)).count() == 0 and whitening.whitened(one.limit(0)).columns == whitening.whitened(one).columns
    # lengths are fitted apart; the second has no variance but in one direction
    mixed = spark.createDataFrame([(i, [float(i), float(-i)]) for i in range(10)] + [(None, [0.5]), (99, [1.5]), (99, [1.5])], "vec_id long, embedding array<float>")
    out = whitening.whitened(mixed).collect()
    assert {(r.n, r.component) for r in out} == {(10, 1), (10, 2), (3, 1)} and sum(r.vec_id is None for r in out) == 1
    assert all(r.whitened == 0.0 for r in out if r.n == 10 and r.component == 2) and all(r.identity_error < 1e-9 for r in out)


def test_sums_of_pairs_may_take_several_aggregations(spark, monkeypatch):
    monkeypatch.setattr(whitening, "PAIRS_AT_ONCE", 5)
    x = np.random.default_rng(1).integers(-50, 50, (40, 6))
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>")
    assert np.allclose(whitening.covariance(rows, 6, 40, x.sum(0).tolist()), np.cov(x.T, bias=True))


def test_whitening_on_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    usable, n, deviation, want, share = plain_whitening(rows)
    got = queries.op13_whitening(spark, SF).toPandas()
    assert len(got) == 8 * n and dict(zip(got.vec_id, got.deviation)) == {i: d for (i, _), d in zip(usable, deviation)}
    for k in range(8):
        own = got[got.component == k + 1].set_index("vec_id").loc[[i for i, _ in usable]]
        assert min(np.abs(own.whitened - want[:, k]).max(), np.abs(own.whitened + want[:, k]).max()) < 1e-6
        assert np.allclose(own.explained, share[k], rtol=1e-6)
    assert got.identity_error.max() < 1e-9


# --- bounds and clashing names of earlier operators


def test_training_is_bounded_by_rows(spark):
    from kgspark.llm import features as ft, quality

    texts = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("word w"), F.col("id"), F.lit(" and more v"), F.col("id")).alias("text"), F.lit("x").alias("_label"), F.lit("y").alias("label"))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    rows = ft.training_rows(texts, labels, "doc_id", "text", "quality", F.lit(True), 100)
    x, y = ft.sampled_features(rows, quality.quality_features, 100)
    assert x.shape == (100, len(quality.FEATURES)) and y.tolist() == [1.0] * 100
    model = quality.fit(texts, labels, F.lit(True), most=100)
    assert quality.scored(texts.limit(3), model).columns == ["doc_id", "text", "_label", "label", "score"]


def test_pipeline_keeps_columns_of_any_name(spark):
    import corpus_pipeline

    words = lambda k: " ".join(f"{k}{i}" for i in range(40))
    names = ["_id", "_hash", "_copies", "_row", "_score", "score", "pii", "shard", "rest", "row", "id", "hash", "key", "_mix_size", "_mix_source", "a.b"]
    rows = [(1, words("a"), "en", "s", 9), (2, words("a"), "en", "s", 9), (3, words("b") + " call +1 212 555 0100", "en", None, None), (None, None, None, "t", 1), (4, "", "", "", 0)]
    docs = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names], name
        assert all(tuple(r)[5:] == tuple(names) for r in docs.collect())
        if name == "quality classifier":
            docs = spark.createDataFrame([(*r, *names) for r in rows], docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_tables_on_the_way_are_deleted(spark):
    import os

    from kgspark.llm import shared

    kept = []

    def make():
        kept.append(shared.written(spark.range(10), "inner"))
        return kept[0].where("id > 3")

    out = shared.only(make, "outer")
    there = lambda df: os.path.exists(df._kgspark_path.removeprefix("file:"))
    assert out.count() == 6 and there(out) and not there(kept[0])


def test_mix_of_more_sources_than_buckets(spark):
    from kgspark.llm import mixing

    docs = spark.range(100_001).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"), F.when(F.col("id") > 0, F.format_string("s%06d", F.col("id"))).alias("source"))
    rows, sources = mixing.drawn(docs)
    names = sorted(f"s{i:06d}" for i in range(1, 100_001))
    sizes = [int(n[1:]) % 7 for n in names] + [0]
    want = mixing.fill_targets(sizes, [i % 3 + 1 for i in range(100_001)], 3.0)
    plan = [(s.name, s.size, s.target) for s in sources]
    assert [p[0] for p in plan] == [*names, None] and [p[1] for p in plan] == sizes
    assert np.allclose([p[2] for p in plan], want, rtol=1e-9)
    out = mixing.with_shards(rows, sources, 8, 0).select("_mix_size", "_mix_target", "_mix_copies", mixing.taken().alias("taken"), "_mix_shards").collect()
    assert all(0 <= r._mix_target - r.taken < 1 + 1e-9 and len(r._mix_shards) == r._mix_copies for r in out)
    load = np.bincount([s for r in out for s in r._mix_shards], minlength=8)
    assert load.max() - load.min() <= 0.02 * load.mean() + 8
