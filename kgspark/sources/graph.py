"""The labelled property graph: triples by predicate, with annotations of edges.

Triples are a set.  A graph keeps a DataFrame for each predicate, so a pattern
with a constant predicate reads that one alone; a stored graph is partitioned by
predicate and prunes in the same way.
"""

from __future__ import annotations

import functools
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.sparql import RDF, RDFS
from ..session import prepare, sized

BASE = "https://example.org/kg/"
PREDICATE, CLASS = BASE + "p/", BASE + "class/"
TYPE, LABEL = RDF + "type", RDFS + "label"
PREFIXES = {"kg": PREDICATE, "c": CLASS, "n": BASE}


class Graph:
    """predicates: IRI -> (DataFrame of s and o, kind of its objects); parts: IRI -> the DataFrames whose union this is, each
    with what all its subjects, and all its objects, begin with (null: anything)."""

    def __init__(self, spark: SparkSession, predicates: dict[str, tuple[DataFrame, str]], edge_annotations: DataFrame | None = None, parts: dict[str, list[tuple[DataFrame, str | None, str | None]]] | None = None):
        self.spark = prepare(spark)
        self.predicates, self._annotations, self.prefixes, self.parts = predicates, edge_annotations, PREFIXES, parts or {}

    def object_kind(self, predicate: str) -> str | None:
        return self.predicates[predicate][1] if predicate in self.predicates else "iri"

    def spaces(self, predicate: str) -> list[tuple[str | None, str | None]]:
        """What subjects and objects begin with in each part of a predicate."""
        return [part[1:] for part in self.parts.get(predicate, [])] or [(None, None)]

    def scan(self, predicate: str | None = None, parts: list[int] | None = None) -> DataFrame:
        """(s, p, o, o_kind) of one predicate, or of some of its parts, or of all predicates."""
        if predicate is not None:
            if predicate not in self.predicates:
                return self.spark.createDataFrame([], "s string, p string, o string, o_kind string")
            df, kind = self.predicates[predicate]
            if parts is not None and len(parts) < len(self.spaces(predicate)):
                own = [self.parts[predicate][i][0] for i in parts]
                df = reduce(DataFrame.unionByName, own) if own else df.where(F.lit(False))
            return df.select("s", F.lit(predicate).alias("p"), "o", F.lit(kind).alias("o_kind"))
        return reduce(DataFrame.unionByName, [self.scan(p) for p in self.predicates])

    def annotations(self) -> DataFrame:
        """(s, p, o, key, value) of edges."""
        if self._annotations is None:
            return self.spark.createDataFrame([], "s string, p string, o string, key string, value string")
        return self._annotations

    def nodes(self) -> DataFrame:
        """(iri, kind, label); a node with several classes or labels has a row for each."""
        kinds = self.scan(TYPE).select(F.col("s").alias("iri"), F.substring_index("o", "/", -1).alias("kind"))
        return kinds.join(self.scan(LABEL).select(F.col("s").alias("iri"), F.col("o").alias("label")), "iri", "left")

    def save(self, path: str) -> None:
        """Replace the store at path: triples partitioned by predicate, and annotations."""
        self.scan().withColumn("predicate", F.regexp_replace("p", "[^A-Za-z0-9]+", "_")).write.mode("overwrite").option("compression", "zstd").partitionBy("predicate").parquet(f"{path}/triples")
        self.annotations().write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/annotations")

    @staticmethod
    def load(spark: SparkSession, path: str) -> StoredGraph:
        return StoredGraph(spark, path)


class StoredGraph(Graph):
    """A graph read from a store; a constant predicate prunes partitions."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, {})
        self.triples = spark.read.parquet(f"{path}/triples")
        self._annotations = spark.read.parquet(f"{path}/annotations")
        self.kinds = {r[0]: r[1][0] if len(r[1]) == 1 else None for r in self.triples.groupBy("p").agg(F.collect_set("o_kind")).collect()}

    def object_kind(self, predicate: str) -> str | None:
        return self.kinds.get(predicate, "iri")

    def scan(self, predicate: str | None = None, parts: list[int] | None = None) -> DataFrame:
        df = self.triples
        if predicate is not None:
            import re

            df = df.where((F.col("predicate") == re.sub("[^A-Za-z0-9]+", "_", predicate)) & (F.col("p") == predicate))
        return df.select("s", "p", "o", "o_kind")


def iri(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"{BASE}{kind}/"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def from_tables(spark: SparkSession, sf_dir: str) -> Graph:
    """The order tables as a graph: six node kinds, seven edges, attributes, and annotations of ``contains``."""
    read = functools.cache(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))  # the files' schema is read once
    sized(spark, [f"{sf_dir}/{name}.parquet" for name in ("customer", "supplier", "part", "orders", "lineitem")])
    kinds = {"Region": ("region", "r_regionkey", "r_name"), "Nation": ("nation", "n_nationkey", "n_name"), "Customer": ("customer", "c_custkey", "c_name"), "Supplier": ("supplier", "s_suppkey", "s_name"), "Part": ("part", "p_partkey", "p_name"), "Order": ("orders", "o_orderkey", None)}
    space = lambda kind: f"{BASE}{kind}/"
    types = [(read(t).select(iri(k, key).alias("s"), F.lit(CLASS + k).alias("o")), space(k), CLASS + k) for k, (t, key, _) in kinds.items()]
    labels = [(read(t).select(iri(k, key).alias("s"), (F.col(name) if name else F.concat(F.lit("Order#"), F.col(key))).alias("o")), space(k), None) for k, (t, key, name) in kinds.items()]
    edge = lambda table, s, o: (table.select(iri(*s).alias("s"), iri(*o).alias("o")), space(s[0]), space(o[0]))
    items = read("lineitem")
    distinct = lambda a, b, s, o: edge(items.select(a, b).distinct(), (s, a), (o, b))
    contains = distinct("l_orderkey", "l_partkey", "Order", "Part")
    attribute = lambda table, kind, key, column: [(read(table).select(iri(kind, key).alias("s"), F.col(column).cast("string").alias("o")), space(kind), None)]
    parts = {
        TYPE: types, LABEL: labels,
        PREDICATE + "within": [edge(read("nation"), ("Nation", "n_nationkey"), ("Region", "n_regionkey"))],
        PREDICATE + "based_in": [edge(read("customer"), ("Customer", "c_custkey"), ("Nation", "c_nationkey")), edge(read("supplier"), ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"))],
        PREDICATE + "places": [edge(read("orders"), ("Customer", "o_custkey"), ("Order", "o_orderkey"))],
        PREDICATE + "places_urgent": [edge(read("orders").where("o_orderpriority = '1-URGENT'"), ("Customer", "o_custkey"), ("Order", "o_orderkey"))],
        PREDICATE + "contains": [contains],
        PREDICATE + "supplied_by": [distinct("l_partkey", "l_suppkey", "Part", "Supplier")],
        PREDICATE + "involves": [contains, distinct("l_orderkey", "l_suppkey", "Order", "Supplier")],
        PREDICATE + "segment": attribute("customer", "Customer", "c_custkey", "c_mktsegment"),
        PREDICATE + "brand": attribute("part", "Part", "p_partkey", "p_brand"),
        PREDICATE + "size": attribute("part", "Part", "p_partkey", "p_size"),
        PREDICATE + "status": attribute("orders", "Order", "o_orderkey", "o_orderstatus"),
        PREDICATE + "priority": attribute("orders", "Order", "o_orderkey", "o_orderpriority"),
    }
    literals = {LABEL, *(PREDICATE + name for name in ("segment", "brand", "size", "status", "priority"))}
    predicates = {p: (reduce(DataFrame.unionByName, [df for df, _, _ in own]), "literal" if p in literals else "iri") for p, own in parts.items()}
    keys = ["quantity", "linenumber", "returnflag"]
    values = [F.col("l_quantity").cast("long"), F.col("l_linenumber"), F.col("l_returnflag")]
    each = F.array(*[F.struct(F.lit(i).alias("key"), v.cast("string").alias("value")) for i, v in enumerate(values)])
    # lines go once to their edge, as numbers; what follows is within its task
    told = items.repartition("l_orderkey", "l_partkey").select("l_orderkey", "l_partkey", F.inline(each)).distinct()
    key = F.element_at(F.array(*[F.lit(PREDICATE + k) for k in keys]), F.col("key") + 1)
    notes = told.select(iri("Order", "l_orderkey").alias("s"), F.lit(PREDICATE + "contains").alias("p"), iri("Part", "l_partkey").alias("o"), key.alias("key"), "value")
    return Graph(spark, predicates, notes, parts)
