"""Mixing sources to target weights.

Documents fall into blocks of their source by a keyed hash of their content.
Every source gets a quota of block draws: whole epochs of all its blocks, then
one partial epoch of blocks in permuted order, whose last block is cut at a
document, and this document at a word, so that the target is met to the word.  A multivariate-hypergeometric splitting tree divides these exact
quotas among the output shards: at each node the left half of the shards draws
its number of block draws without replacement, and the rest goes right.  Each
shard takes disjoint runs of its sources' permuted draws and shuffles locally.

Sources and blocks are tables, however many there are.  Targets are filled by an
iterated aggregate over the table of sources, of which each round sends one row
to the driver.  The tree runs over at most BUCKETS buckets of sources, whose
quotas the driver holds; within a bucket, a task divides the bucket's draws in a
shard among its sources by the same law.  All work on documents is DataFrame
expressions.

Defined cases: a null text has size 0 and is taken 0 words; a null source is a
source of its own, last in order; a source of size 0 has target 0; repeated rows
are drawn each for itself; an empty table gives an empty mix; columns named like
the working columns (all begin with ``_mix_``) are the only names not allowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import shared

BUCKETS = 4096  # of sources, in the splitting tree; up to so many, a source is a bucket of its own
MAX_BLOCKS = 20_000  # blocks get larger instead of more numerous
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill_targets(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Shares of sum(sizes) by weight, none above cap * its size; what is cut off is shared anew by weight."""
    target, rest, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in sorted(open_))
        over = [i for i in sorted(open_) if rest * weights[i] / weight >= cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = rest * weights[i] / weight
            break
        for i in over:
            target[i] = float(cap * sizes[i])
            open_.discard(i)
        rest = float(sum(sizes)) - sum(t for i, t in enumerate(target) if i not in open_)
    return target


def split_quotas(quotas: list[int], n_shards: int, seed: int) -> np.ndarray:
    """(n_shards x sources) block draws: a binary tree of multivariate hypergeometric draws with exact sums."""
    out = np.zeros((n_shards, len(quotas)), np.int64)

    def halve(low: int, high: int, own: np.ndarray) -> None:
        if high - low == 1:
            out[low] = own
            return
        mid = (low + high) // 2
        rng = np.random.Generator(np.random.PCG64([seed, low, high]))
        left, need, rest = np.zeros_like(own), int(own.sum()) * (mid - low) // (high - low), int(own.sum())
        for i, q in enumerate(own.tolist()):
            left[i] = rng.hypergeometric(q, rest - q, need) if need and q else 0
            need, rest = need - int(left[i]), rest - q
        halve(low, mid, left)
        halve(mid, high, own - left)

    halve(0, n_shards, np.array(quotas, np.int64))
    return out


@dataclass
class Sources:
    """The plan: a written table with a row for each source.

    name, none (whether it is null), number (in order), n (rows), size, target, blocks, epochs (whole passes), whole
    (blocks of the last, partial pass that are taken whole), rest (words still wanted from block number ``whole``), and
    there, the document at which they end: last_key, last_size, and the words before it.
    """

    table: DataFrame

    def __iter__(self) -> Iterator:
        """Rows in order, with the name as it was."""
        own = self.table.withColumn("name", F.when(~F.col("none"), F.col("name")))
        return iter(own.orderBy("number").toLocalIterator())


def numbered(totals: DataFrame) -> DataFrame:
    """Adds number, the position from 0 in order of code point, null last; without a task that has all rows."""
    order = [F.col("none"), F.col("name")]
    sorted_ = shared.written(totals.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "sorted")
    counts = sorted(map(tuple, sorted_.groupBy(F.shiftright("at", 33).alias("part")).count().collect()))  # one row for each partition
    starts = [(part, sum(n for _, n in counts[:i])) for i, (part, _) in enumerate(counts)]
    first = sorted_.sparkSession.createDataFrame(starts, "part long, first long")
    own = sorted_.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(first), "part")
    return own.withColumn("number", F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "first", "at")


def with_targets(sources: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Adds target: shares of all sizes by weight as ``fill_targets`` has them, by an aggregate in each round."""
    turn = F.pmod("number", F.lit(len(weights)))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int"))
    total = int(sources.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    full = F.lit(float(cap)) * F.col("size")
    rest, open_weight, shut = 0.0, 1.0, -1
    while True:
        share = F.lit(rest) * weight / F.lit(open_weight)
        over = share >= full if shut >= 0 else F.lit(False)
        row = sources.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("size"))), F.lit(0)), *[F.count_if(~over & (turn == i)) for i in range(len(weights))]).first()
        left = sum(float(w) * n for w, n in zip(weights, row[2:], strict=True))
        if row[0] == shut or not left:
            return sources.withColumn("target", F.when(share >= full, full).otherwise(share))
        shut, rest, open_weight = row[0], float(total) - float(cap * row[1]), left


def block_of(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_mix_block", F.pmod("_mix_key", F.col("_mix_blocks").cast("long")).cast("int"))


KEYS = ["_mix_source", "_mix_none"]


def placed(rows: DataFrame, table: DataFrame, *values: str) -> DataFrame:
    """rows with figures of their source, as _mix_<figure>; sources of very many rows are dealt over all tasks."""
    own = table.select(F.col("name").alias("_mix_source"), F.col("none").alias("_mix_none"), "n", *[F.col(v).alias(f"_mix_{v}") for v in values])
    return shared.matched(rows, own, KEYS, [f"_mix_{v}" for v in values], ["_mix_key"])


def plan(figures: DataFrame, weights: tuple[float, ...], cap: float, block_words: int) -> Sources:
    """Quotas of all sources from (_mix_source, _mix_none, _mix_size, _mix_key)."""
    totals = figures.groupBy(F.col("_mix_source").alias("name"), F.col("_mix_none").alias("none")).agg(F.count("*").alias("n"), F.sum("_mix_size").alias("size"))
    made = [sources := shared.written(numbered(totals), "sources")]
    words = int(sources.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    block = max(block_words, words // MAX_BLOCKS, 1)
    ratio = F.coalesce(F.try_divide("target", "size"), F.lit(0.0))
    epochs = F.when(F.abs(ratio - F.round(ratio)) < 1e-9, F.round(ratio)).otherwise(F.floor(ratio)).cast("int")
    sources = with_targets(sources, weights, cap).withColumns({"blocks": F.expr(f"int(greatest(1, (size + {block - 1}) div {block}))"), "epochs": epochs})
    made += [sources := shared.written(sources.withColumn("wanted", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("size"))), "sources")]
    made += [dealt := shared.written(block_of(placed(figures, sources, "number", "blocks")).select("_mix_number", "_mix_block", "_mix_key", "_mix_size"), "blocks")]
    # the blocks of the last pass, in order
    order = Window.partitionBy("number").orderBy("_mix_block").rowsBetween(Window.unboundedPreceding, 0)
    sums = dealt.groupBy(F.col("_mix_number").alias("number"), "_mix_block").agg(F.sum("_mix_size").alias("words")).withColumn("upto", F.sum("words").over(order))
    fits = sums.join(sources.select("number", "wanted"), "number").groupBy("number").agg(F.min(F.when(F.col("upto") > F.col("wanted"), F.col("_mix_block"))).alias("stop"), F.max(F.when(F.col("upto") <= F.col("wanted"), F.col("upto"))).alias("taken"))
    some = F.col("wanted") > 0
    sources = sources.join(fits, "number", "left").withColumns({"whole": F.when(some, F.coalesce("stop", "blocks")).otherwise(F.lit(0)).cast("int"), "rest": F.when(some, F.col("wanted") - F.coalesce("taken", F.lit(0))).otherwise(F.lit(0.0))})
    made += [sources := shared.written(sources.drop("stop", "taken", "wanted"), "sources")]
    # where the last pass of each source ends, from keys and sizes alone
    cut = dealt.join(sources.where("rest > 0").select(F.col("number").alias("_mix_number"), F.col("whole").alias("_mix_block"), "rest"), ["_mix_number", "_mix_block"])
    cut = cut.where("_mix_size > 0").groupBy(F.col("_mix_number").alias("number"), "rest", F.col("_mix_key").alias("last_key"), F.col("_mix_size").alias("last_size")).agg(F.sum("_mix_size").alias("words"))
    order = Window.partitionBy("number").orderBy("last_key", "last_size").rowsBetween(Window.unboundedPreceding, 0)
    ends = cut.withColumn("upto", F.sum("words").over(order)).where("upto >= floor(rest)").groupBy("number").agg(F.min(F.struct("last_key", "last_size", (F.col("upto") - F.col("words")).alias("before"))).alias("e"))
    out = shared.written(sources.join(ends.select("number", "e.*"), "number", "left"), "sources")
    for table in made:
        shared.drop(table)
    return Sources(out)


def drawn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, block_words: int = 100_000, n_shards: int = 64, seed: int = 0) -> tuple[DataFrame, Sources]:
    """docs with _mix_size, _mix_source_size, _mix_target, _mix_copies (times taken), _mix_part (words of its last copy
    in the partial pass) and the plan.

    Sources in order of code point, null last, get the weights in turn.  Every
    copy count is floor(target / size) or one more, so no document is taken
    more than ``cap`` times.
    """
    sized = docs.withColumns({
        "_mix_source": F.coalesce(F.col(source_col).cast("string"), F.lit("")),
        "_mix_none": F.col(source_col).isNull(),
        "_mix_size": word_count(F.col(text_col)),
        "_mix_key": F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)),
    })
    figures = shared.written(sized.select("_mix_source", "_mix_none", "_mix_size", "_mix_key"), "mix")
    sources = plan(figures, weights, cap, block_words)
    shared.drop(figures)
    rows = placed(sized, sources.table.withColumn("source_size", F.col("size")), "number", "source_size", "target", "blocks", "epochs", "whole", "rest", "last_key", "last_size", "before")
    rows = block_of(rows)
    # 1: taken whole in the last pass, -1: not taken, 0: the document at which the pass ends.  In the block of that
    # document whole documents in permuted order come first, and then a part of it.
    side = F.expr("""case when _mix_block < _mix_whole then 1 when _mix_block > _mix_whole or _mix_rest <= 0 then -1
        when _mix_last_key is null or struct(_mix_key, _mix_size) < struct(_mix_last_key, _mix_last_size) then 1
        when _mix_key = _mix_last_key and _mix_size = _mix_last_size then 0 else -1 end""")
    rows = rows.withColumn("_mix_side", side)
    apart = rows.where("_mix_side <> 0").withColumn("_mix_part", F.when(F.col("_mix_side") > 0, F.col("_mix_size")).otherwise(F.lit(0)).cast("long"))
    apart = apart.withColumn("_mix_last", F.expr("int(_mix_side > 0)"))
    # (several rows of a source only if whole rows repeat)
    nth = F.row_number().over(Window.partitionBy("_mix_number").orderBy("_mix_key")) - 1
    left = F.floor("_mix_rest") - F.col("_mix_before") - nth * F.col("_mix_size")
    last = rows.where("_mix_side = 0").withColumn("_mix_part", F.greatest(F.lit(0), F.least(F.col("_mix_size"), left)).cast("long"))
    last = last.withColumn("_mix_last", F.expr("int(_mix_part > 0)"))
    out = apart.unionByName(last).drop("_mix_side", "_mix_last_key", "_mix_last_size", "_mix_before")
    return out.withColumn("_mix_copies", F.col("_mix_epochs") + F.col("_mix_last")), sources


def taken() -> Column:
    """Words that the mix takes of a document of ``drawn``."""
    return F.col("_mix_size") * F.col("_mix_epochs") + F.col("_mix_part")


def shard_table(sources: Sources, n_shards: int, seed: int, buckets: int = BUCKETS) -> DataFrame:
    """(_mix_number, _mix_block, _mix_epoch) -> _mix_shard for every block draw."""
    partial = (F.col("rest") > 0) & (F.col("whole") < F.col("blocks"))
    own = sources.table.withColumns({"quota": F.col("blocks").cast("long") * F.col("epochs") + F.col("whole") + partial.cast("int"), "bucket": F.pmod("number", F.lit(buckets))})
    totals = sorted(map(tuple, own.groupBy("bucket").agg(F.sum("quota")).collect()))
    split = split_quotas([int(q) for _, q in totals], n_shards, seed)
    counts = own.sparkSession.createDataFrame([(bucket, split[:, i].tolist()) for i, (bucket, _) in enumerate(totals)], "bucket long, counts array<long>")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("number")
        left, out = group.column("quota").to_numpy().copy(), []
        counts = np.array(group.column("counts")[0].as_py(), np.int64)
        rng = np.random.Generator(np.random.PCG64([seed, int(group.column("bucket")[0].as_py()), 2]))
        shares = np.zeros((n_shards, len(left)), np.int64)
        for shard, n in enumerate(counts.tolist()):  # (the law of a bucket's draws, given how many of them a shard has)
            shares[shard] = rng.multivariate_hypergeometric(left, n, method="marginals") if len(left) > 1 else n
            left -= shares[shard]
        for i, (number, blocks, quota) in enumerate(zip(*(group.column(c).to_pylist() for c in ("number", "blocks", "quota")), strict=True)):
            order = np.random.Generator(np.random.PCG64([seed, number, 1])).permutation(quota)
            out.append(np.column_stack((np.full(quota, number), order % blocks, order // blocks, np.repeat(np.arange(n_shards), shares[:, i]))))
        rows = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
        return pa.table([pa.array(rows[:, k], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["_mix_number", "_mix_block", "_mix_epoch", "_mix_shard"])

    return own.where("quota > 0").select("bucket", "number", "blocks", "quota").join(F.broadcast(counts), "bucket").groupBy("bucket").applyInArrow(run, "_mix_number long, _mix_block int, _mix_epoch int, _mix_shard int")


def with_shards(rows: DataFrame, sources: Sources, n_shards: int, seed: int) -> DataFrame:
    """Rows of ``drawn`` with _mix_shards: the output shard of each copy, in order of the pass."""
    table = shard_table(sources, n_shards, seed).groupBy(F.col("_mix_number").alias("_mix_drawn"), "_mix_block").agg(F.array_sort(F.collect_list(F.struct("_mix_epoch", "_mix_shard"))).alias("_mix_draws"))
    # (rows that the mix leaves out meet nothing, wherever they are)
    rows = rows.withColumn("_mix_drawn", F.when(F.col("_mix_copies") > 0, F.col("_mix_number")).otherwise(-1 - F.pmod("_mix_key", F.lit(1 << 20))))
    rows = rows.join(shared.written(table, "shards"), ["_mix_drawn", "_mix_block"], "left")
    return rows.withColumn("_mix_shards", F.expr("coalesce(slice(_mix_draws._mix_shard, 1, _mix_copies), array())")).drop("_mix_draws", "_mix_drawn")


def mixed(docs: DataFrame, n_shards: int = 64, seed: int = 0, **options) -> DataFrame:
    """The mix itself: docs' columns and ``shard`` int, one row per copy, each shard in its own partition in shuffled order.

    Options are those of ``drawn``.  A column ``shard`` of docs is replaced.
    """
    rows, sources = drawn(docs, n_shards=n_shards, seed=seed, **options)
    rows = with_shards(rows, sources, n_shards, seed)
    rows = rows.select("*", F.posexplode("_mix_shards").alias("_mix_epoch", "_mix_shard"))
    # Of the document at which the last pass ends, the words that it still takes.
    text_col = options.get("text_col", "text")
    cut = (F.col("_mix_epoch") == F.col("_mix_epochs")) & (F.col("_mix_part") < F.col("_mix_size"))
    part = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), 1, F.col("_mix_part").cast("int")), " ")
    rows = rows.withColumn(text_col, F.when(cut, part).otherwise(F.col(text_col)))
    rows = rows.withColumn("_mix_order", F.xxhash64(F.lit(seed + 1), "_mix_shard", "_mix_epoch", "_mix_key"))
    rows = rows.repartition(n_shards, "_mix_shard").sortWithinPartitions("_mix_shard", "_mix_order")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c != "shard"], F.col("_mix_shard").alias("shard"))
