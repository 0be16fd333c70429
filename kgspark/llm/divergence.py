"""Source divergence audit: how far the term shares of a language's sources lie from each other and from the language.

Terms are runs of letters (ASCII letters, and everything beyond ASCII) with only
A-Z lower-cased; a language keeps those in at least ``least`` of its documents.
A group (language, source) gives a kept term the share
p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)), exact at every size.

For each pair of groups the cells of a joint count histogram are tallied: how
many kept terms have ``a`` occurrences in the one and ``b`` in the other.
|p - q| is evaluated once for each cell, times its number of terms.  Terms fall
into buckets and sources into tiles, so that a task meets a bounded matrix of
counts; it sends on only cells.  The implied cell (0, 0) is what is missing to V.

Defined cases: null text, language and source are ''; every row is a document
of its own, repeated ones too; a group without kept terms, and a language
without any (V = 0, all values 0), still has its pairs; an empty table gives no
rows; the largest values tie by UTF-8 order of the items; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import prepare
from . import shared
from .kernels import LOWER, Words, column_buffer, released

LEAST = 30  # documents of a kept term
SMOOTH, UNIT = 5, 1_000_000_000
RANKS = 50  # terms of a group that are reported
BUCKET = 4096  # kept terms of a bucket
TILE = 64  # sources of a tile
PIECE = 1 << 22  # bytes of text whose terms are counted at once

NOT_TERM = np.ones(256, bool)
NOT_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def tallied(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of a run of rows: occurrences of each term and the documents that have it, by group."""
    data = LOWER[data]
    words = Words(data, offsets, gaps=NOT_TERM)
    lengths = words.ends - words.starts
    tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(lengths)))), pa.py_buffer(data[~NOT_TERM[data]])])
    coded = tokens.dictionary_encode()
    n_terms = max(1, len(coded.dictionary))
    known: dict[tuple, int] = {}
    pairs = zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist(), strict=True)
    group = np.array([known.setdefault(p, len(known)) for p in pairs], np.int64)
    # of each document once, then the documents of a group together
    own, n = np.unique(np.repeat(np.arange(len(words)), np.diff(words.first)) * n_terms + coded.indices.to_numpy(), return_counts=True)
    cell, at = np.unique(group[own // n_terms] * n_terms + own % n_terms, return_inverse=True)
    named = [pa.array([g[i] for g in known], pa.string()).take(pa.array(cell // n_terms)) for i in (0, 1)]
    terms = coded.dictionary.take(pa.array(cell % n_terms)).cast(pa.binary()).cast(pa.string())
    sums = [np.bincount(at, n, len(cell)).astype(np.int64), np.bincount(at, minlength=len(cell)).astype(np.int64)]
    return pa.RecordBatch.from_arrays([*named, terms, *map(pa.array, sums)], ["lang", "source", "term", "n", "docs"])


@released
def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = column_buffer(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
            own = offsets[at : to + 1]
            yield tallied(batch.slice(at, to - at), data[own[0] : own[-1]], own - own[0])
            at = to


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """((lang, source, term, n, docs) of terms that occur, (lang, source) of all groups), both written tables."""
    plain = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).alias("text"))
    each = rows.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    table = each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return shared.written(table, "terms"), shared.written(rows.select("lang", "source").distinct(), "groups")


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of a count, from the group's sum of counts and the number of kept terms; exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(24,0)")
    return F.lit(1).cast("long") + F.call_function("div", (wide(count) + SMOOTH) * F.lit(UNIT).cast("decimal(10,0)"), wide(total) + wide(kept) * SMOOTH)


def vocabulary(terms: DataFrame, least: int = LEAST) -> DataFrame:
    """Kept terms (lang, term, lang_n), lang_n the language's occurrences; a written table."""
    known = terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("in_docs"))
    return shared.written(known.where(F.col("in_docs") >= least).drop("in_docs"), "vocabulary")


def tile_cells(group: pa.Table) -> pa.Table:
    """Cells (lang, a, b, count_a < or > count_b, terms) of all pairs of sources that a tile pair compares, (0, 0) left out.

    Two tiles are compared source by source across; a tile with itself, each pair once.
    """
    lang, left, right = group.column("lang")[0].as_py(), group.column("left")[0].as_py(), group.column("right")[0].as_py()
    names = group.column("source").combine_chunks().dictionary_encode()
    terms = group.column("term").combine_chunks().dictionary_encode()
    matrix = np.zeros((len(names.dictionary), len(terms.dictionary)), np.int64)
    source, known = names.indices.to_numpy(), terms.is_valid().to_numpy(zero_copy_only=False)
    matrix[source[known], terms.indices.drop_null().to_numpy()] = group.column("n").to_numpy()[known]
    tile = np.zeros(len(matrix), np.int64)
    tile[source] = group.column("tile").to_numpy()
    values, codes = np.unique(matrix, return_inverse=True)
    codes = codes.reshape(matrix.shape)
    first, second = (np.flatnonzero(tile == t) for t in (left, right))
    out: list[tuple[np.ndarray, ...]] = []
    for i, a in enumerate(first.tolist()):
        for b in (second[i + 1 :] if left == right else second).tolist():
            cell, times = np.unique(codes[a] * len(values) + codes[b], return_counts=True)
            x, y = values[cell // len(values)], values[cell % len(values)]
            some = (x > 0) | (y > 0)
            out.append((np.full(some.sum(), a), np.full(some.sum(), b), x[some], y[some], times[some]))
    a, b, x, y, times = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(5))
    name = names.dictionary.cast(pa.string())
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": name.take(pa.array(a)), "b": name.take(pa.array(b)), "count_a": x.astype(np.int64), "count_b": y.astype(np.int64), "terms": times.astype(np.int64)})


def histograms(kept: DataFrame, groups: DataFrame, sizes: DataFrame, bucket: int = BUCKET, tile: int = TILE) -> DataFrame:
    """(lang, a, b, count_a, count_b, terms) of each unordered pair of sources; sizes has (lang, kept, sources).

    Cells (0, 0) are left out: their terms are the rest to the language's kept terms.
    """
    buckets, tiles = F.ceil(F.col("kept") / bucket), F.ceil(F.col("sources") / tile)
    place = F.pmod(F.xxhash64("source"), tiles).alias("tile"), F.sequence(F.lit(0).cast("long"), tiles - 1).alias("tiles")
    dealt = kept.join(sizes, "lang").select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), buckets).alias("bucket"), *place)
    # every source is in every bucket, also where it has none of its terms
    every = groups.join(sizes, "lang").where("kept > 0").select("lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), buckets - 1)).alias("bucket"), *place)
    dealt = dealt.unionByName(every)
    meets = dealt.select("*", F.explode("tiles").alias("other")).drop("tiles")
    keyed = meets.select("lang", "bucket", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"), "source", "tile", "term", "n")
    cells = keyed.groupBy("lang", "bucket", "left", "right").applyInArrow(tile_cells, "lang string, a string, b string, count_a long, count_b long, terms long")
    # a pair's sides may come either way round in different buckets
    turned = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    cells = cells.select("lang", pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("count_a", "count_b").alias("count_a"), pick("count_b", "count_a").alias("count_b"), "terms")
    return cells.groupBy("lang", "a", "b", "count_a", "count_b").agg(F.sum("terms").alias("terms"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, ranks: int = RANKS, bucket: int = BUCKET, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has each other source of the language by distance,
    part ``term`` the ``ranks`` terms that a group uses most above its language."""
    prepare(docs.sparkSession)  # (there is a union below a group)
    terms, groups = counts(docs, text_col, lang_col, source_col)
    known = vocabulary(terms, least)
    kept = shared.written(terms.drop("docs").join(known, ["lang", "term"]), "kept")
    shared.drop(terms)
    by_lang = known.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    sizes = shared.written(groups.groupBy("lang").agg(F.count("*").alias("sources")).join(by_lang, "lang", "left").select("lang", "sources", none("kept"), none("lang_total")), "sizes")
    totals = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").select("lang", "source", none("total"))
    totals = shared.written(totals.join(sizes.select("lang", "kept"), "lang"), "totals")
    # pairs: a cell's terms times the distance of its shares, and the terms that no cell has
    side = lambda s: totals.select("lang", F.col("source").alias(s), F.col("total").alias(f"total_{s}"), *(["kept"] if s == "a" else []))
    pairs = side("a").join(side("b"), "lang").where("a < b")
    cells = histograms(kept, groups, sizes.select("lang", "kept", "sources"), bucket, tile)
    apart = lambda x, y: F.abs(share(x, F.col("total_a"), F.col("kept")) - share(y, F.col("total_b"), F.col("kept")))
    sums = cells.join(pairs, ["lang", "a", "b"]).groupBy("lang", "a", "b").agg(F.sum(F.col("terms") * apart(F.col("count_a"), F.col("count_b"))).alias("value"), F.sum("terms").alias("seen"))
    rest = F.col("kept") - F.coalesce("seen", F.lit(0))
    whole = pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "a", "b", F.when(F.col("kept") == 0, 0).otherwise(F.coalesce("value", F.lit(0)) + F.when(rest > 0, rest * apart(F.lit(0), F.lit(0))).otherwise(0)).cast("long").alias("value"))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pair_rows = whole.select("lang", "value", F.inline(both)).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    over = kept.join(totals, ["lang", "source"]).join(sizes.select("lang", "lang_total"), "lang")
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    term_rows = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pair_rows).unionByName(ranked(term_rows).where(F.col("rank") <= ranks))
