"""Keyed draws of partners that share a node with an anchor, or that share none, without listing pairs.

A node that anchors and partners point at is a hub.  Its partners fall into slots
of about SLOT members by hash, and an anchor asks for some slots of each of its
hubs, in keyed order: so a pair is only made if it is drawn, no hub is ever read
or sorted whole, and the work grows with the number of edges times the number
of draws.  Anchors whose draws hold no partner within the bounds draw more, up
to all that there are; an anchor without a row has no such partner.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources import scratch
from .adjacency import among, beginning

SLOT = 8  # members of a slot, about
MORE = 16  # times as many draws in each further round
SETS = 256  # hubs of a node up to which they are compared as arrays
FRACTION = 1 << 20  # parts in which shares of a slot are counted
BLOCK = 1024  # partners that an anchor with few left goes through at once
REJECTIONS = 4  # draws from a complement, after one, before more are drawn at once
SENT = 100_000  # nodes that are sent to all tasks
NUMBER = 50  # bits of the number at the end of a node
STARTS = 1000  # beginnings of nodes that are held in an expression
TRIES = 12  # rounds in which a first candidate is looked up


def rank_key(seed: str, template: str, *parts: str) -> Column:
    """The order in which candidates are drawn: a hash of seed, template and candidate."""
    return F.sha2(F.concat_ws(":", F.lit(seed), F.lit(template), *[F.col(p) for p in parts]), 256)


def hashed(seed: str, *parts: str, first: int = 1, digits: int = 8) -> Column:
    """A whole number from hexadecimal digits of a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[F.col(p).cast("string") for p in parts])), first, digits), 16, 10).cast("long")


def written(df: DataFrame, name: str) -> DataFrame:
    path = scratch.new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, column: str) -> DataFrame:
    """df, a written table, with number: the position from 0 in order of a column without repeats; no task has all rows."""
    own = written(df.repartitionByRange(column).sortWithinPartitions(column).withColumn("at", F.monotonically_increasing_id()), "sorted")
    counts = sorted(map(tuple, own.groupBy(F.shiftright("at", 33).alias("part")).count().collect()))  # a row for each partition
    first, starts = 0, []
    for part, n in counts:
        starts.append((part, first))
        first += n
    table = own.sparkSession.createDataFrame(starts, "part long, first long")
    return own.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(table), "part").withColumn("number", F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "first", "at")


def with_sets(edges: DataFrame, key: str) -> DataFrame:
    """edges (key, hub, ...) with hubs: the array of all hubs of the key, null if these are more than SETS."""
    fans = edges.groupBy(key).agg(F.count("*").alias("fan")).where(F.col("fan") <= SETS)
    sets = edges.select(key, "hub").join(fans.select(key), key).groupBy(key).agg(F.collect_list("hub").alias("hubs"))
    return edges.join(sets, key, "left")


def sets(edges: DataFrame, key: str, every: DataFrame) -> DataFrame:
    """(key, hubs) of every key: the array of all its x, empty if it has none, null if these are more than SETS; an edge is sent once."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.col("x").asc_nulls_last()))
    rows = edges.select(key, "x", F.lit(False).alias("own")).unionByName(every.select(key, F.lit(None).cast(dict(edges.dtypes)["x"]).alias("x"), F.lit(True).alias("own")))
    cut = rows.select(key, "x", "own", nth.alias("nth")).groupBy(key).agg(F.bool_or("own").alias("own"), F.count("x").alias("fan"), F.collect_list(F.when(F.col("nth") <= SETS, F.col("x"))).alias("hubs"))
    return cut.where("own").select(key, F.when(F.col("fan") <= SETS, F.col("hubs")).alias("hubs"))


def only(edges: DataFrame, x: DataFrame) -> DataFrame:
    """edges with these x only, if they are so few that they are sent to all tasks; else all edges."""
    x = x.distinct()
    return edges.join(F.broadcast(x), "x", "left_semi") if x.limit(SENT + 1).count() <= SENT else edges


class Names:
    """Nodes as whole numbers while they travel, if all of them are one of few beginnings and a number; else as they are."""

    def __init__(self, columns: list[DataFrame]):
        nodes = reduce(DataFrame.union, [df.toDF("node") for df in columns])
        parts = nodes.select(beginning(F.col("node")).alias("start"), F.regexp_like(F.substring_index("node", "/", -1), F.lit("^(0|[1-9][0-9]{0,14})$")).alias("fits"))
        found = parts.groupBy("start").agg(F.bool_and(F.coalesce("fits", F.lit(False))).alias("fits")).limit(STARTS + 1).collect()
        whole = len(found) <= STARTS and all(r.fits and r.start for r in found)
        self.starts = sorted(r.start for r in found) if whole and found else None

    def code(self, name: str) -> Column:
        if self.starts is None:
            return F.col(name)
        start = F.array_position(F.array(*map(F.lit, self.starts)), beginning(F.col(name))) - 1
        return (F.shiftleft(start.cast("long"), NUMBER) + F.substring_index(name, "/", -1).cast("long")).alias(name)

    def text(self, name: str | Column) -> Column:
        own = F.col(name) if isinstance(name, str) else name
        if self.starts is None:
            return own
        return F.concat(F.get(F.array(*map(F.lit, self.starts)), F.shiftright(own, NUMBER).cast("int")), own.bitwiseAND((1 << NUMBER) - 1).cast("string"))

    def coded(self, df: DataFrame) -> DataFrame:
        return df.select(*map(self.code, df.columns))

    def texts(self, df: DataFrame) -> DataFrame:
        return df.select(*[self.text(c).alias(c) for c in df.columns])


def hashed_text(seed: str, *parts: Column, first: int = 1, digits: int = 8) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), first, digits), 16, 10).cast("long")


def one(left: DataFrame, right: DataFrame, template: str, draws: int, seed: str = "", names: Names | None = None) -> DataFrame:
    """(anchor, partner): what ``common`` gives for one attempt; left and right are written tables of distinct edges.

    Slots hold partners alone, not what these point at: an anchor's first candidate is looked up in the hubs of the
    anchor before its own, and if it is in one of them, the next is taken.  The few anchors left go to ``common``.
    """
    spark, names = left.sparkSession, names or Names([left.select("anchor"), left.select("x"), right.select("partner"), right.select("x")])
    theirs = names.coded(right)
    hubs = written(theirs.groupBy("x").agg(F.count("*").alias("degree")).withColumn("slots", F.expr(f"greatest(1, degree div {SLOT})")), "hubs")
    own = names.coded(left).where(among(spark, hubs.select(F.col("x").alias("node")))("x"))  # other edges are no common ones
    own = own.join(hubs, "x")
    text = {c: names.text(c) for c in ("anchor", "x", "partner")}
    slot = (hashed_text(seed, text["x"], text["partner"]) % F.col("slots")).cast("int")
    slots = written(theirs.join(hubs, "x").select("x", slot.alias("slot"), "partner").groupBy("x", "slot").agg(F.collect_list("partner").alias("members")), "slots")
    own = written(own.withColumn("all", F.sum("degree").over(Window.partitionBy("anchor"))).select("anchor", "x", F.col("slots").cast("int").alias("slots"), "all"), "anchors")
    start = (hashed_text(seed, text["anchor"], text["x"]) % F.col("slots")).alias("start")
    part = hashed_text(seed, text["anchor"], text["x"], first=9, digits=5).alias("part")
    count = F.expr(f"least(slots, floor(double(least({draws}, all)) * double(slots) / double(all) + double(part) / {FRACTION}D))")
    key = lambda partner: F.sha2(F.concat_ws(":", F.lit(seed), F.lit(template), text["anchor"], names.text(partner)), 256)
    nobody = F.array().cast(f"array<{dict(own.dtypes)['anchor']}>")
    open_, tried, found, rest = own.withColumn("tried", nobody), own.select("anchor").distinct(), [], []
    for _ in range(TRIES):
        asked = open_.select("anchor", "x", "slots", "tried", start, part, "all").withColumn("n", count).where("n > 0")
        asked = asked.select("anchor", "x", "tried", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda i: ((F.col("start") + i - 1) % F.col("slots")).cast("int"))).alias("slot"))
        free = F.filter("members", lambda m: (m != F.col("anchor")) & ~F.array_contains("tried", m))
        first = F.array_min(F.transform(free, lambda m: F.struct(key(m).alias("key"), names.text(m).alias("text"), m.alias("partner"))))["partner"]
        met = asked.join(slots, ["x", "slot"]).select("anchor", "x", "tried", first.alias("partner")).where("partner is not null").repartition("anchor")
        order = F.struct(key(F.col("partner")).alias("key"), text["partner"].alias("text"), text["x"].alias("hub"), "partner", "x", "tried")
        best = written(met.groupBy("anchor").agg(F.min(order).alias("m")).select("anchor", "m.partner", "m.x", "m.tried"), "best")
        rest.append(tried.join(best.select("anchor"), "anchor", "left_anti"))
        looked = best.select("anchor", "partner", "x").join(open_.select("anchor", F.col("x").alias("other")), "anchor").where(names.text("other") < names.text("x"))
        again = looked.join(theirs.select("partner", F.col("x").alias("other")), ["partner", "other"], "left_semi").select("anchor").distinct()
        again = written(best.join(again, "anchor", "left_semi").select("anchor", F.array_append("tried", F.col("partner")).alias("tried")), "again")
        found.append(best.select("anchor", "partner").join(again.select("anchor"), "anchor", "left_anti"))
        tried = again.select("anchor")
        if again.isEmpty():
            break
        open_ = written(open_.drop("tried").join(again, "anchor"), "open")
    out = names.texts(reduce(DataFrame.unionByName, found))
    more = written(names.texts(reduce(DataFrame.unionByName, [*rest, tried])), "rest")
    if not more.isEmpty():
        out = out.unionByName(common(left.join(more, "anchor", "left_semi"), right, template, 1, draws, seed=seed).select("anchor", "partner"))
    return out


def common(left: DataFrame, right: DataFrame, template: str, attempts: int, draws: int, low: int = 1, high: int | None = None, seed: str = "") -> DataFrame:
    """(anchor, partner, overlap): up to ``attempts`` drawn partners of each anchor, with the exact number of nodes that they share.

    left (anchor, x) and right (partner, x) are distinct edges; overlaps are within low and high.  About ``draws``
    candidates of an anchor are tried in the first round, all partners of its hubs being as likely: a partner counts
    only by the least node that the two share.  A slot's members travel as one row.
    """
    left = written(left, "left")
    right = written(only(right, left.select("x")), "edges")  # other edges are no common ones
    members = right.groupBy("x").agg(F.count("*").alias("degree")).withColumn("slots", F.expr(f"greatest(1, degree div {SLOT})"))
    hubs = written(numbered(members, "x").withColumnRenamed("number", "hub"), "hubs")
    if hubs.count() < 1 << 31:
        hubs = hubs.withColumn("hub", F.col("hub").cast("int"))
    theirs = with_sets(written(right.join(hubs, "x").select("partner", "hub", (hashed(seed, "x", "partner") % F.col("slots")).alias("slot")), "members"), "partner")
    theirs = theirs.groupBy("hub", "slot").agg(F.collect_list(F.struct("partner", F.col("hubs").alias("partner_hubs"))).alias("members"))
    theirs = written(theirs, "slots")
    own = left.join(hubs, "x").select("anchor", "hub", "degree", "slots", (hashed(seed, "anchor", "x") % F.col("slots")).alias("start"), hashed(seed, "anchor", "x", first=9, digits=5).alias("part"))
    own = written(with_sets(own.withColumn("all", F.sum("degree").over(Window.partitionBy("anchor"))), "anchor"), "anchors")
    many = not (theirs.where(F.exists("members", lambda m: m["partner_hubs"].isNull())).isEmpty() and own.where("hubs is null").isEmpty())
    fits = F.col("overlap") >= low if high is None else F.col("overlap").between(low, high)
    key = lambda partner: F.sha2(F.concat_ws(":", F.lit(seed), F.lit(template), F.col("anchor"), partner), 256)
    found, open_ = [], own
    while True:
        count = F.expr(f"least(slots, floor(double(least({draws}, all)) * double(slots) / double(all) + double(part) / {FRACTION}D))")
        asked = open_.select("anchor", "hubs", "hub", F.explode(F.transform(F.sequence(F.lit(1), count), lambda i: (F.col("start") + i - 1) % F.col("slots"))).alias("slot"), count.alias("n")).where("n > 0")
        met = asked.drop("n").join(theirs, ["hub", "slot"])

        def shared(m: Column) -> Column:
            both = F.array_intersect(F.col("hubs"), m["partner_hubs"])
            return F.when((m["partner"] != F.col("anchor")) & (F.array_min(both) == F.col("hub")), F.size(both))

        counted = F.filter(F.transform("members", lambda m: F.struct(m["partner"].alias("partner"), shared(m).alias("overlap"))), lambda m: (m["overlap"] >= low) & (F.lit(True) if high is None else m["overlap"] <= high))
        if attempts < SLOT:  # of a slot no more than the first of its members can count
            keyed = F.transform(counted, lambda m: F.struct(key(m["partner"]).alias("key"), m["partner"].alias("partner"), m["overlap"].alias("overlap")))
            counted = F.slice(F.array_sort(keyed), 1, attempts)
        near = met.where("hubs is not null").select("anchor", F.explode(counted).alias("m")).select("anchor", "m.partner", "m.overlap")
        if many:  # of nodes with very many hubs, each hub of the anchor is looked up
            pairs = met.select("anchor", "hub", F.col("hubs").isNull().alias("wide"), F.explode("members").alias("m")).where("wide or m.partner_hubs is null").select("anchor", "hub", "m.partner").where("anchor <> partner")
            far = pairs.join(own.select("anchor", F.col("hub").alias("other")), "anchor")
            edges = theirs.select(F.col("hub").alias("other"), F.explode("members.partner").alias("partner"))
            found_far = far.join(edges, ["partner", "other"]).groupBy("anchor", "partner", "hub").agg(F.count("*").cast("int").alias("overlap"), F.min("other").alias("least"))
            near = near.unionByName(found_far.where("hub = least").select("anchor", "partner", "overlap").where(fits))
        order = Window.partitionBy("anchor").orderBy(rank_key(seed, template, "anchor", "partner"), "partner")
        first = near.repartition("anchor").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= attempts).drop("nth")
        found.append(written(first, "drawn"))
        open_ = open_.where(F.col("all") > draws).join(found[-1].select("anchor").distinct(), "anchor", "left_anti")
        draws *= MORE
        open_ = written(open_, "open")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, found)


def apart(left: DataFrame, right: DataFrame, anchors: DataFrame, template: str, seed: str = "", names: Names | None = None) -> DataFrame:
    """(anchor, partner): for each anchor one partner of right with which it shares no node, all of them as likely.

    Partners are numbered; an anchor draws numbers by hash until one is no partner that it shares a node with.
    Anchors that have not met one after draws of a quarter of all partners get the first of those left in keyed order.
    Nodes of anchor and partner meet as arrays.
    """
    names = names or Names([left.select("anchor"), left.select("x"), right.select("partner"), right.select("x"), anchors.select("anchor")])
    theirs = numbered(right.select("partner").distinct(), "partner").withColumn("partner", names.code("partner"))
    left, right, anchors = names.coded(left), names.coded(right), names.coded(anchors.select("anchor"))
    left = left.where(among(left.sparkSession, right.select(F.col("x").alias("node")))("x"))  # other edges are no common ones
    open_ = written(sets(left, "anchor", anchors.distinct()), "anchors")
    near = only(right, open_.select(F.explode("hubs").alias("x"))) if open_.where("hubs is null").isEmpty() else right
    partners = written(theirs.join(sets(near, "partner", theirs).withColumnRenamed("hubs", "partner_hubs"), "partner"), "partners")
    total = partners.count()
    many = not (partners.where("partner_hubs is null").isEmpty() and open_.where("hubs is null").isEmpty())
    found, first, draws = [], 0, 1

    def free(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where("anchor <> partner")
        apart_ = pairs.where(~F.arrays_overlap("hubs", "partner_hubs"))
        if not many:
            return apart_
        far = pairs.where("hubs is null or partner_hubs is null")  # of nodes with very many hubs, each is looked up
        shared = far.select("anchor", "partner").join(left, "anchor").join(right, ["partner", "x"], "left_semi").select("anchor", "partner").distinct()
        return apart_.unionByName(far.join(shared, ["anchor", "partner"], "left_anti"))

    while total:
        if first >= REJECTIONS and draws > total // 4:  # few are left: their partners are gone through
            blocks = open_.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((total - 1) // BLOCK).cast("long"))))
            tried = blocks.join(partners.withColumn("block", F.expr(f"number div {BLOCK}")), "block")
            key = F.sha2(F.concat_ws(":", F.lit(seed), F.lit(template), names.text("anchor"), names.text("partner")), 256)
            order = F.struct(key.alias("key"), names.text("partner").alias("text"), "partner")
            found.append(written(free(tried).groupBy("anchor").agg(F.min(order).alias("m")).select("anchor", F.col("m.partner").alias("partner")), "apart"))
            break
        numbers = open_.select("anchor", "hubs", F.explode(F.sequence(F.lit(first), F.lit(draws - 1))).alias("i")).withColumn("number", hashed_text(f"{seed}:{template}", names.text("anchor"), F.col("i").cast("string"), digits=15) % total)
        met = free(numbers.join(partners, "number")).select("anchor", "partner", "i")
        found.append(written((met.groupBy("anchor").agg(F.min_by("partner", "i").alias("partner")) if draws - first > 1 else met.select("anchor", "partner")), "apart"))
        open_ = written(open_.join(found[-1], "anchor", "left_anti"), "open")
        if open_.isEmpty():
            break
        first, draws = draws, REJECTIONS if draws < REJECTIONS else draws * MORE
    if not found:
        return anchors.sparkSession.createDataFrame([], "anchor string, partner string")
    return names.texts(reduce(DataFrame.unionByName, found))
