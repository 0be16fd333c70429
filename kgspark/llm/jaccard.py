"""N-gram Jaccard join of near-duplicate texts.

Nodes are the distinct sets of word shingles, named by a 64-bit hash of the set;
texts with one set are one node.

1. Candidates: linked sets of sizes x <= y differ in at most
   d = (1 - t) / (1 + t) * (x + y) shingles.  The hash space is cut into more
   than d parts, so linked sets agree in a whole part; every set gives the key
   of each well-filled part, for each size band in which it may have a partner.
   A set with more than d keys besides those that very many sets have leaves
   these out: its partners agree with it in one of the others.  The sets of a
   key are a group; keys whose sets have the same extremes share one.  Keys of
   a great share of all sets are found in a sample and dealt to several tasks.
2. Bitmaps: each set has a hashed bitmap; the bits that one has and the other
   lacks bound the overlap from above.  First every set meets the least one of
   each of its keys.  Groups that this does not connect throughout are compared
   in tiles.  Groups are never joined to larger classes before a comparison, so
   chance agreements do not chain the corpus together.
3. Exact: the pairs that the bitmaps let pass are decided by intersecting the
   sorted arrays.  Classes of such pairs that these links do not connect
   throughout are compared in tiles in the same way.
4. Components of the links are the result.

A tile compares two blocks of a group, dealt by hash.  What is known to be
connected is not compared again: a component that fills blocks of its own meets
only the blocks of others, and a tile gives a forest, never all its pairs.

Defined cases: null and empty texts, and texts without words, have empty sets
and link with nothing; a text with fewer words than a shingle is one shingle;
repeated rows are linked (their set is one node); rows with a null id stay and
get the least non-null id of their class, or null; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from . import shared
from .components import components
from .kernels import Words, chunks, grams, groups, mix, released, sequence_value

BLOCK, BLOCK_SHINGLES = 512, 200_000  # sets and shingles of a block of arrays, about; a tile compares two blocks
COARSE = 4  # blocks of bitmaps have so many times the sets, and 8 times that the shingles
COMMON = 16  # sets of a key before sets with enough other keys leave it out
FILTER_BITS = 1 << 25  # of the filter of wanted sets, broadcast to all tasks: 4 MB
PROBE = 64  # of one in so many sets the keys are counted, to find hot ones
HOT_KEYS = 20_000  # at most; a hot key has this fraction of all sampled keys, and 16 of them at least
SALTS = 64  # tasks that a hot key is dealt to
BAND = 1.4  # a size band reaches to this multiple of its least size
ONE = np.uint64(1)


@functools.cache
def bands(num: int, den: int, upto: int = 1 << 40) -> list[tuple[int, int, int, int, int]]:
    """(least size, largest partner, d, parts, least shingles of a key's part) of each band, for similarity num/den.

    Parts are so many that more than d of them probably hold enough shingles; the
    fuller a key's part, the fewer sets agree in it by chance.
    """
    out, low = [], 1
    while low < upto:
        high = max(low, int(low * BAND) - 1)
        partner = high * den // num
        differ = (high + partner) * (den - num) // (den + num)
        parts, filled = next(
            (parts, filled)
            for filled in (4, 3, 2, 1, 0)
            for parts in range(differ + 1, int(1.25 * (differ + 1)) + 3, max(1, differ // 50))
            if not filled or _well_filled(low, parts, filled) > differ
        )
        out.append((low, partner, differ, parts, filled))
        low = high + 1
    return out


def _well_filled(size: int, parts: int, filled: int) -> float:
    """A low estimate of the parts that hold at least ``filled`` of ``size`` shingles."""
    mean = size / parts
    less = sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(filled))
    return parts * (1 - less) - 1.5 * math.sqrt(parts * less * (1 - less))


def keys_of(values: np.ndarray, num: int, den: int) -> list[tuple[int, np.ndarray]]:
    """(keys beyond d + 1, keys) of a sorted array of distinct shingle values, for each of its bands."""
    size = len(values)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    high32 = values >> np.uint64(32)
    out = []
    for number, (low, partner, differ, parts, filled) in enumerate(bands(num, den)):
        if low > size:
            break
        if partner < size:
            continue
        edges = np.searchsorted(high32, ((np.arange(parts + 1, dtype=np.uint64) << np.uint64(32)) + np.uint64(parts - 1)) // np.uint64(parts))
        held = edges[1:] - edges[:-1] >= filled
        key = mix(mix(sums[edges[1:]] - sums[edges[:-1]] + np.arange(parts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(number))
        # Of more than d filled parts one agrees with a partner's.  A set with fewer gives all its parts; a partner
        # with fewer does so too, and one with more is found as above.
        spare = int(held.sum()) - differ - 1
        out.append((spare, key[held] if spare >= 0 else key))
    return out


def sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle values of each text."""
    hashes = words.hashes()
    value = grams(hashes, n)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(value[a : b - n + 1])
        elif b > a:
            yield np.array([sequence_value(hashes[a:b])])
        else:
            yield np.zeros(0, np.uint64)


def name_of(values: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(mix(np.array([np.add.reduce(mix(values + ONE), dtype=np.uint64) + np.uint64(len(values))]))[0].view(np.int64))


def signed(n: int, num: int, den: int) -> Callable:
    """(id, text) -> (id, size, set, bits, bands, probe): bitmap, and keys by band, only at the first text of the partition with that set."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part, words in chunks(batch, "text", lower=True):
                sizes, names, given, bits, probe = [], [], [], [], []
                for values in sets(words, n):
                    sizes.append(len(values))
                    name = name_of(values) if len(values) else None
                    names.append(name)
                    fresh = name is not None and name not in seen
                    if fresh:
                        seen.add(name)
                    bits.append(bitmap(values, width_of(len(values))).tobytes() if fresh else None)
                    own = keys_of(values, num, den) if fresh else []
                    given.append([{"spare": spare, "keys": key.view(np.int64)} for spare, key in own] if fresh else None)
                    probe.append(np.concatenate([key for _, key in own]).view(np.int64) if own and name % PROBE == 0 else None)
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "size": pa.array(sizes, pa.int64()), "set": pa.array(names, pa.int64()), "bits": pa.array(bits, pa.binary()), "bands": pa.array(given, pa.list_(pa.struct([("spare", pa.int32()), ("keys", pa.list_(pa.int64()))]))), "probe": pa.array(probe, pa.list_(pa.int64()))})

    return run


def arrays(n: int, wanted: Broadcast) -> Callable:
    """(text) -> (set, data): sorted arrays of the sets that the filter lets pass, each once in a partition."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        mask = wanted.value
        for batch in batches:
            for _, words in chunks(batch, "text", lower=True):
                names, data = [], []
                for values in sets(words, n):
                    name = name_of(values) if len(values) else None
                    at = (name or 0) & FILTER_BITS - 1
                    if name is not None and name not in seen and int(mask[at >> 6]) >> (at & 63) & 1:
                        seen.add(name)
                        names.append(name)
                        data.append(values.tobytes())
                if names:
                    yield pa.RecordBatch.from_pydict({"set": pa.array(names, pa.int64()), "data": pa.array(data, pa.binary())})

    return run


def filter_of(names: DataFrame) -> Broadcast:
    """A bit for each remainder of the names: FILTER_BITS bits, however many names there are."""
    at = F.col("set").bitwiseAND(FILTER_BITS - 1)
    bit = F.expr(f"shiftleft(1L, cast((set & {FILTER_BITS - 1}) & 63 as int))")
    words = names.select(F.shiftright(at, 6).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    mask = np.zeros(FILTER_BITS // 64, np.int64)
    mask[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return names.sparkSession.sparkContext.broadcast(mask.view(np.uint64))


def width_of(size: int) -> int:
    """Bits of a set's bitmap: a power of two, at least twice its size."""
    return 1 << max(6, int(2 * size).bit_length())


def bitmap(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` bits as 64-bit words."""
    out = np.zeros(width // 64, np.uint64)
    bits = values & np.uint64(width - 1)
    np.bitwise_or.at(out, (bits >> np.uint64(6)).astype(np.int64), ONE << (bits & np.uint64(63)))
    return out


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set with fewer words."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def needed(x, y, num: int, den: int):
    """Least overlap of sets of sizes x and y with den * overlap >= num * union."""
    return -(-num * (x + y) // (num + den))


def passing(bits: np.ndarray, others: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Numbers of the rows of ``others`` whose lack of the bits does not exceed ``spare``; a quarter of the words rejects most."""
    at, lead = np.arange(len(others)), max(1, len(bits) // 4)
    for a, b in ((0, lead), (lead, len(bits))):
        if len(at) and b > a:
            spare = spare - np.bitwise_count(bits[a:b] & ~others[at, a:b]).sum(1, dtype=np.int64)
            at, spare = at[spare >= 0], spare[spare >= 0]
    return at


def allowed(x: np.ndarray, y: np.ndarray, size_x: int, size_y: int, num: int, den: int) -> bool:
    """Whether the bitmaps of two sets allow a link."""
    if size_x > size_y:
        x, y, size_x, size_y = y, x, size_y, size_x
    spare = size_x - needed(size_x, size_y, num, den)
    words = min(len(x), len(y))
    return spare >= 0 and int(np.bitwise_count(folded(x, words) & ~folded(y, words)).sum(dtype=np.int64)) <= spare


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted arrays of distinct values are similar enough."""
    overlap = len(np.intersect1d(x, y, assume_unique=True))
    return den * overlap >= num * (len(x) + len(y) - overlap)


def tile_edges(bits: list[np.ndarray], size: np.ndarray, side: np.ndarray, group: np.ndarray, num: int, den: int, sets_: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """A forest of the pairs of a tile whose bitmaps allow a link; with sets_, of those that are linked.

    Sets of one ``group`` are connected already; sides 0 and 1: only pairs across, unless side is all 0.
    """
    order = np.argsort(size, kind="stable")
    size, side = size[order], side[order]
    group = np.unique(group[order], return_inverse=True)[1]
    words = np.array([len(bits[i]) for i in order])
    both, links = bool(side.any()), []
    # a set is compared in the width of the smaller one: wider rows of the others are folded
    rows: dict[int, np.ndarray] = {}
    for i in range(len(order) - 1):
        to = int(np.searchsorted(size, size[i] * den // num, "right"))
        other = np.arange(i + 1, to)
        other = other[group[other] != group[i]]
        if both:
            other = other[side[other] != side[i]]
        spare = size[i] - needed(size[i], size[other], num, den)
        other, spare = other[spare >= 0], spare[spare >= 0]
        if not len(other):
            continue
        w = int(words[i])
        if w not in rows:
            first = i  # of this width
            rows = {w: np.array([folded(bits[k], w) for k in order[first:]])}
        own = rows[w]
        for j in other[passing(own[i - first], own[other - first], spare)].tolist():
            if group[j] != group[i] and (sets_ is None or linked(sets_[order[i]], sets_[order[j]], num, den)):
                links.append((int(order[i]), int(order[j])))
                group[group == group[j]] = group[i]
    return links


def edge_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"u": pa.array([u for u, _ in pairs], pa.int64()), "v": pa.array([v for _, v in pairs], pa.int64())})


def compare(num: int, den: int, exact: bool) -> Callable:
    """Rows of tiles, sorted by tile -> edges (u, v): links by sorted arrays if exact, else pairs that bitmaps allow."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for tile in groups(batches, ["tile"]):
            values = [np.frombuffer(x, np.uint64) for x in tile.column("data").to_pylist()]
            names, size = tile.column("set").to_pylist(), tile.column("size").to_numpy()
            sets_ = values if exact else None
            bits = [bitmap(v, width_of(len(v))) for v in values] if exact else values
            found = tile_edges(bits, size, tile.column("side").to_numpy(), tile.column("part").to_numpy(), num, den, sets_)
            edges += [(names[i], names[j]) for i, j in found]
            if len(edges) > 20_000:
                yield edge_batch(edges)
                edges.clear()
        yield edge_batch(edges)

    return run


def paired(num: int, den: int, exact: bool) -> Callable:
    """(u, u_size, u_data, v, v_size, v_data) -> the pairs that are linked if exact, else those that bitmaps allow."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, x_size, y_size in zip(*[batch.column(c).to_pylist() for c in ("u_data", "v_data", "u_size", "v_size")], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(linked(x, y, num, den) if exact else allowed(x, y, x_size, y_size, num, den))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def passed(edges: DataFrame, data: DataFrame, num: int, den: int, exact: bool) -> DataFrame:
    """The edges (u, v) that data (set, size, data) lets pass."""
    side = lambda s: data.select(F.col("set").alias(s), F.col("size").alias(f"{s}_size"), F.col("data").alias(f"{s}_data"))
    return edges.join(side("u"), "u").join(side("v"), "v").mapInArrow(paired(num, den, exact), "u long, v long")


def compared(rows: DataFrame, data: DataFrame, num: int, den: int, block: int, shingles: int, exact: bool) -> DataFrame:
    """Edges among the sets of each group that has several parts: rows (group, set, size, part), data (set, data)."""
    fill = lambda: F.count("*") / block + F.sum("size") / shingles
    large = shared.written(rows.groupBy("group").agg(fill().alias("fill")).where("fill > 1.5"), "large")
    whole = F.xxhash64("group").alias("tile"), F.lit(0).alias("side")
    if large.isEmpty():
        tiles = rows.select("set", "size", "part", *whole)
    else:
        small = rows.join(large, "group", "left_anti").select("set", "size", "part", *whole)
        rows = rows.join(large.select("group"), "group")
        # Blocks: parts that fill one have blocks of their own, the others share blocks.
        fills = rows.groupBy("group", "part").agg(fill().alias("fill")).withColumn("own", F.when(F.col("fill") >= 1, F.col("part")))
        blocks = fills.groupBy("group", "own").agg(F.ceil(F.sum("fill")).cast("int").alias("n"))
        placed = rows.join(fills.select("group", "part", "own"), ["group", "part"])
        placed = placed.join(blocks.select("group", F.col("own").alias("_own"), "n"), "group").where(F.col("own").eqNullSafe(F.col("_own")))
        placed = placed.select("set", "size", "part", "group", F.struct(F.col("own").isNull().alias("mixed"), F.coalesce("own", F.lit(0)).alias("own"), F.pmod(F.xxhash64("set"), "n").cast("int").alias("nth")).alias("block"))
        numbers = blocks.select("group", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("nth"))
        numbers = numbers.select("group", F.struct(F.col("own").isNull().alias("mixed"), F.coalesce("own", F.lit(0)).alias("own"), "nth").alias("block"))
        pairs = numbers.withColumnRenamed("block", "a").join(numbers.withColumnRenamed("block", "b"), "group")
        pairs = pairs.where("a <= b and (a.mixed or b.mixed or a.own <> b.own)")
        sides = pairs.select("group", F.xxhash64("group", "a", "b").alias("tile"), F.explode(F.expr("if(a = b, array(struct(a as block, 0 as side)), array(struct(a as block, 0 as side), struct(b as block, 1 as side)))")).alias("s"))
        large_tiles = placed.join(sides.select("group", "tile", "s.block", "s.side"), ["group", "block"]).select("set", "size", "part", "tile", "side")
        tiles = small.unionByName(large_tiles)
    return data.select("set", "data").join(tiles, "set").repartition("tile").sortWithinPartitions("tile").mapInArrow(compare(num, den, exact), "u long, v long")


def parts_of(rows: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """rows (group, set, size, ...) of groups that the edges do not connect throughout, with ``part``: a set's component."""
    classes = components(edges, name)
    rows = rows.join(classes, F.col("set") == F.col("node"), "left").drop("node").withColumn("part", F.coalesce("component", "set")).drop("component")
    rows = shared.written(rows, "parts")
    open_ = rows.groupBy("group").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    return rows.join(open_.select("group"), "group")


def members(marked: DataFrame, common: int) -> DataFrame:
    """(set, size, group, least): the groups of each set, and the least set of one of the group's keys."""
    keys = marked.where("bands is not null").select("set", "size", F.posexplode("bands").alias("band", "b"))
    keys = keys.select("set", "size", "band", F.col("b.spare").alias("spare"), F.explode("b.keys").alias("key"))
    probe = marked.where("probe is not null").select(F.explode("probe").alias("key"))
    least = max(16, probe.count() // HOT_KEYS)
    hot = probe.groupBy("key").count().where(F.col("count") >= least).select("key", F.lit(True).alias("hot"))
    keys = keys.join(F.broadcast(hot), "key", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("set"), F.lit(SALTS)).cast("int")).otherwise(0))
    # (a set that several partitions have is several rows of its keys)
    own = Window.partitionBy("key", "salt")
    whole = own.orderBy("set").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = own.orderBy("set")
    keys = keys.withColumns({"nth": F.dense_rank().over(order), "before": F.lag("set").over(order), "after": F.lead("set").over(order)}).where("before is not null or after is not null or hot")
    other = F.xxhash64("set")
    keys = keys.select("set", "size", "band", "spare", "key", "hot", *[f.over(whole).alias(n) for n, f in (("n", F.max("nth")), ("least", F.min("set")), ("most", F.max("set")), ("low", F.min(other)), ("high", F.max(other)))])
    keys = keys.where("n > 1 or hot").withColumn("common", F.coalesce("hot", F.lit(False)) | (F.col("n") > common))
    group = F.when(F.col("common"), F.xxhash64("key")).otherwise(F.xxhash64("least", "most", "low", "high"))
    met = keys.select("set", "size", "band", "spare", "common", F.struct(group.alias("group"), "least").alias("g")).groupBy("set", "size", "band", "spare")
    met = met.agg(F.collect_set(F.when(~F.col("common"), F.col("g"))).alias("own"), F.collect_set(F.when(F.col("common"), F.col("g"))).alias("shared"))
    # Of each set and band, one row: its groups, and those of keys that very many sets have.
    met = met.select("set", "size", F.explode(F.when(F.size("shared") > F.col("spare"), F.array_union("own", "shared")).otherwise(F.col("own"))).alias("g"))
    return met.select("set", "size", "g.group", "g.least").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100, block: int = BLOCK, common: int = COMMON) -> DataFrame:
    """docs -> id_col, n_shingles long, component_id: texts link when den * overlap >= num * union of their n-word shingles."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    marked = shared.written(rows.mapInArrow(signed(n, num, den), f"id {id_type}, size long, set long, bits binary, bands array<struct<spare:int,keys:array<long>>>, probe array<long>"), "signed")

    met = shared.written(members(marked, common), "members")
    bits = marked.where("bits is not null").join(met.select("set").distinct(), "set", "left_semi")
    bits = shared.written(bits.groupBy("set").agg(F.first("size").alias("size"), F.first("bits").alias("data")), "bits")
    stars = met.where("set <> least").select(F.col("set").alias("u"), F.col("least").alias("v")).distinct()
    stars = shared.written(passed(stars, bits, num, den, exact=False), "stars")
    # (a group of two whose least is one of them has been compared)
    groups_ = met.groupBy("group").agg(F.countDistinct("set").alias("n"), F.min("set").alias("low"), F.min("least").alias("least")).where("n > 2 or n = 2 and low <> least")
    met_again = met.join(groups_.select("group"), "group").select("group", "set", "size").distinct()
    more = compared(parts_of(met_again, stars, "stars"), bits, num, den, COARSE * block, 8 * COARSE * BLOCK_SHINGLES, exact=False)
    maybe = shared.written(stars.union(more).distinct(), "maybe")

    # Arrays of the sets of these pairs, and of some others that the filter lets pass and the join drops.
    wanted = shared.written(maybe.select(F.explode(F.array("u", "v")).alias("set")).distinct(), "wanted")
    full = rows.select("text").mapInArrow(arrays(n, filter_of(wanted)), "set long, data binary").join(wanted, "set", "left_semi").dropDuplicates(["set"])
    full = shared.written(full.select("set", (F.octet_length("data") / 8).cast("long").alias("size"), "data"), "arrays")
    links = shared.written(passed(maybe, full, num, den, exact=True), "links")
    classes = components(maybe, "classes").select(F.explode(F.array("node", "component")).alias("set"), F.col("component").alias("group")).distinct()
    classes = full.select("set", "size").join(classes, "set").select("group", "set", "size")
    more = compared(parts_of(classes, links, "links"), full, num, den, block, BLOCK_SHINGLES, exact=True)
    result = components(links.union(more), "linked")
    for table in (met, bits, stars, maybe, wanted, full, links):
        shared.drop(table)

    names = marked.select("id", "size", "set").join(result, F.col("set") == F.col("node"), "left").withColumn("class", F.coalesce("component", "set"))
    least = names.where("class is not null").groupBy("class").agg(F.min("id").alias("least_id"))
    out = names.join(least, "class", "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("least_id", "id").alias("component_id"))
