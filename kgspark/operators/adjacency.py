"""Neighbourhoods as stored runs: of each node, predicate and direction the first edges in text order.

Contexts keep at most ``per_predicate`` edges of a predicate, in text order, so
of a run no more than these can be kept, and a run is cut there when it is
made.  Nodes reached from a node are cut at ``fetch`` in each direction, in the
same order.  Only edges at nodes that are met are made, told apart where they
are read; an edge goes to its far end for that end's name, to its node to be cut, and to the question, the kept
edges of a node as one row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources import scratch
from ..sources.graph import LABEL, PREDICATE, Graph

PER_PREDICATE, TOTAL, FETCH = 25, 200, 5000
TEXT = ["s_name", "p_name", "o_name", "other"]


SPACES = 1000  # beginnings of nodes that are sent to all tasks
BITS = 1 << 24  # of the filter of nodes that is sent to all tasks, however many there are


@dataclass
class Adjacency:
    """runs: (node, items: array of s_name, p_name, o_name, other), other the neighbour's IRI or null; reach: (node, other)."""

    runs: DataFrame
    reach: DataFrame | None


def local_name(iri: Column) -> Column:
    return F.when(F.startswith(iri, F.lit("http")), F.substring_index(iri, "/", -1)).otherwise(iri)


def beginning(iri: Column) -> Column:
    """An IRI up to its last slash."""
    return F.substring(iri, F.lit(1), F.length(iri) - F.length(F.substring_index(iri, "/", -1)))


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df, written once."""
    path = scratch.new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def among(spark: SparkSession, nodes: DataFrame) -> Callable[[str], Column]:
    """Whether a column may be one of the nodes (node): true of all of them and of few others, by a bit for each hash of a node."""
    own = F.pmod(F.xxhash64("node"), F.lit(BITS))
    words = nodes.select(own.alias("at")).groupBy(F.expr("at div 64").alias("id")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits"))
    every = spark.range(BITS // 64).join(words, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    bits = stored(spark, every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("bits")), "bits")

    def test(column: str) -> Column:
        at = F.pmod(F.xxhash64(column), F.lit(BITS))
        return F.getbit(F.get(bits.scalar(), F.floor(at / 64).cast("int")), at % 64) == 1

    return test


def named(graph: Graph, rows: DataFrame, column: str, name: str, some: Callable[[str], Column] | None = None) -> DataFrame:
    """rows with the name of a column: its label (of several the least), else its local name; literals as they are. some: a condition that all of the column meet."""
    labels = graph.scan(LABEL)
    labels = (labels if some is None else labels.where(some("s"))).groupBy("s").agg(F.min("o").alias("label")).withColumnRenamed("s", column)
    return rows.join(labels, column, "left").withColumn(name, F.coalesce("label", local_name(F.col(column)))).drop("label")


def both_ways(triples: DataFrame) -> DataFrame:
    """(node, outgoing, p_name, far, iri) of triples, seen from their ends; iri: whether far is one."""
    p_name = F.substring_index("p", "/", -1).alias("p_name")
    iri = F.col("o_kind") == "iri"
    out = triples.select(F.col("s").alias("node"), F.lit(True).alias("outgoing"), p_name, F.col("o").alias("far"), iri.alias("iri"))
    back = triples.where(iri).select(F.col("o").alias("node"), F.lit(False).alias("outgoing"), p_name, F.col("s").alias("far"), F.lit(True).alias("iri"))
    return out.unionByName(back)


def build(graph: Graph, per_predicate: int = PER_PREDICATE, fetch: int = FETCH, nodes: DataFrame | None = None, hops: int = 2) -> Adjacency:
    """Runs of all nodes, or of those given (iri) only; reach, and all of it written once, if there is more than one hop."""
    seen, some = both_ways(graph.scan().where(F.startswith("p", F.lit(PREDICATE)))), None
    if nodes is not None:
        nodes = nodes.select(F.col("iri").alias("node")).distinct()
        spaces = [r[0] for r in nodes.select(beginning(F.col("node"))).distinct().limit(SPACES + 1).collect()]
        if len(spaces) <= SPACES:  # most other edges go before they are sent anywhere
            seen = seen.where(beginning(F.col("node")).isin(spaces))
        some = among(graph.spark, nodes)
        seen = seen.where(some("node"))
    seen = named(graph, seen, "far", "far_name")
    if nodes is None:
        nodes = seen.select("node").distinct()
    names = named(graph, nodes, "node", "name", some)
    far_name, own_name, other = F.col("far_name"), F.col("name"), F.when(F.col("iri"), F.col("far"))
    s_name, o_name = F.when(F.col("outgoing"), own_name).otherwise(far_name), F.when(F.col("outgoing"), far_name).otherwise(own_name)
    # (what follows a node's edges is within its task)
    rows = seen.select("node", "outgoing", "p_name", "far_name", other.alias("other")).join(names.hint("shuffle_hash"), "node")
    rows = rows.select("node", "outgoing", s_name.alias("s_name"), "p_name", o_name.alias("o_name"), "other")

    def cut(partition: list[str], most: int, rows: DataFrame) -> DataFrame:
        order = Window.partitionBy(*partition).orderBy(*TEXT)  # (an edge that is there twice counts once)
        return rows.withColumn("nth", F.dense_rank().over(order)).where(F.col("nth") <= most).drop("nth")

    def written(df: DataFrame, name: str) -> DataFrame:
        return stored(graph.spark, df, name)

    if hops > 1:
        rows = written(rows, "seen")
    runs = cut(["node", "p_name", "outgoing"], per_predicate, rows).groupBy("node").agg(F.collect_list(F.struct(*TEXT)).alias("items"))
    if hops == 1:
        return Adjacency(runs, None)
    return Adjacency(written(runs, "runs"), written(cut(["node", "outgoing"], fetch, rows.where("other is not null")).select("node", "other").distinct(), "reach"))


def capped(rows: DataFrame, per_predicate: int = PER_PREDICATE, total: int = TOTAL, by: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """The first ``per_predicate`` of each predicate and ``total`` in all, in text order of subject, predicate, object, then by the other node; adds rank."""
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by, "p_name").orderBy(*TEXT))).where(F.col("nth") <= per_predicate).drop("nth")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*TEXT))).where(F.col("rank") <= total)


def around(graph: Graph, anchors: DataFrame, hops: int = 1, adjacency: Adjacency | None = None) -> DataFrame:
    """(question_id, s_name, p_name, o_name, other, rank): kept edges around anchors (question_id, iri), none of a node twice.

    Without stored runs those of the nodes that are met are made, hop by hop.
    """
    return reduce(DataFrame.unionByName, [rows.select("question_id", *TEXT, "rank") for rows, _ in kept(graph, anchors, hops, adjacency)])


def kept(graph: Graph, anchors: DataFrame, hops: int = 1, adjacency: Adjacency | None = None) -> list[tuple[DataFrame, tuple[str, ...]]]:
    """What ``around`` gives, in parts of different questions, each with the columns by which its tasks hold a question whole.

    Edges of a question that has one node are cut where the node is, and are not sent to the question.
    """

    def met(rows: DataFrame) -> DataFrame:
        return stored(graph.spark, rows, "frontier")

    if hops == 1:
        own = anchors.select("question_id", F.col("iri").alias("node")).repartition("question_id").distinct()
        frontier = met(own.withColumn("alone", F.count("*").over(Window.partitionBy("question_id")) == 1))
        out = []
        for part, by in ((frontier.where("alone"), ("node", "question_id")), (frontier.where("not alone"), ("question_id",))):
            if not part.isEmpty():
                runs = (adjacency or build(graph, nodes=part.select(F.col("node").alias("iri")), hops=1)).runs
                items = part.join(runs, "node").select(*by, "items")
                items = items if "node" in by else items.repartition("question_id")
                out.append((capped(items.select(*by, F.inline("items")).distinct(), by=by), by))
        return out or [(capped(frontier.select("question_id", *[F.lit(None).cast("string").alias(c) for c in TEXT]).limit(0)), ("question_id",))]
    frontier = met(anchors.select("question_id", F.col("iri").alias("node")).distinct())
    seen, parts = frontier, []
    for left in range(hops, 0, -1):
        own = adjacency or build(graph, nodes=frontier.select(F.col("node").alias("iri")), hops=min(left, 2))
        parts.append(frontier.join(own.runs, "node").select("question_id", "items"))
        if left > 1:
            frontier = met(frontier.join(own.reach, "node").select("question_id", F.col("other").alias("node")).distinct().join(seen, ["question_id", "node"], "left_anti"))
            seen = seen.unionByName(frontier)
    items = reduce(DataFrame.unionByName, parts).repartition("question_id")
    return [(capped(items.select("question_id", F.inline("items")).distinct()), ("question_id",))]
