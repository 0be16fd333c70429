"""Question production: candidate pools, keyed sampling, answers and their shape, for all seeds at once.

Instead of drawing a candidate and asking the store for its answer, a pool is
joined with all answers in one plan; then candidates are ranked by a keyed hash
and cut.  Pools and answers are DataFrames; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.graph import CLASS, LABEL, PREDICATE, TYPE, Graph
from . import draws, shares
from .adjacency import among
from .draws import rank_key

SEED = "20260605"
MAX_ATTEMPTS = 200  # partners of an anchor that are tried
PAIR_DRAWS, BRIDGE_DRAWS = 800, 32  # candidates of an anchor in the first round


def of_kind(graph: Graph, kind: str) -> DataFrame:
    return graph.scan(TYPE).where(F.col("o") == CLASS + kind).select(F.col("s").alias("e"))


def edges(graph: Graph, edge: str, target: str | None = None) -> DataFrame:
    """(e, x) of an edge or attribute, objects of a kind only if asked for."""
    out = graph.scan(PREDICATE + edge).select(F.col("s").alias("e"), F.col("o").alias("x"))
    return out.join(of_kind(graph, target).withColumnRenamed("e", "x"), "x", "left_semi") if target else out


def labelled(graph: Graph, entities: DataFrame) -> DataFrame:
    """(e, label): of several labels of an entity the least."""
    labels = graph.scan(LABEL).select(F.col("s").alias("e"), F.col("o").alias("label"))
    return entities.join(labels, "e").groupBy(*entities.columns).agg(F.min("label").alias("label"))


def has_edge(graph: Graph, kind: str, edge: str, target: str | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """Nodes of a kind with an edge, its number of distinct objects within bounds."""
    fans = edges(graph, edge, target).groupBy("e").agg(F.count_distinct("x").alias("fan"))
    if low is not None:
        fans = fans.where(F.col("fan") >= low)
    if high is not None:
        fans = fans.where(F.col("fan") <= high)
    return labelled(graph, fans.select("e").join(of_kind(graph, kind), "e", "left_semi"))


def lacks_edge(graph: Graph, kind: str, edge: str, presence: str, low: int | None = None) -> DataFrame:
    """Nodes of a kind without an edge that have another one (``presence``), at least ``low`` times."""
    if not presence:
        raise ValueError("a pool of absent edges needs an edge that is present")
    return has_edge(graph, kind, presence, low=low).join(edges(graph, edge).select("e").distinct(), "e", "left_anti")


def paired(graph: Graph, anchors: DataFrame, edge: str, partner_kind: str, target: str | None = None, low: int = 1, high: int | None = None, template: str = "pairs", seed: str = SEED) -> DataFrame:
    """(anchor, partner, overlap): drawn partners of each anchor, MAX_ATTEMPTS at most, that share low to high objects of an edge with it.

    Anchors' fan bounds hold before any pair is made; an anchor without a row has no such partner.
    """
    own = edges(graph, edge, target).distinct()
    left = own.join(anchors.select("e"), "e", "left_semi").withColumnRenamed("e", "anchor")
    right = own.join(of_kind(graph, partner_kind), "e", "left_semi").withColumnRenamed("e", "partner")
    return draws.common(left, right, template, MAX_ATTEMPTS, PAIR_DRAWS, low, high, seed)


def overlapping(graph: Graph, anchors: DataFrame, edge: str, partner_kind: str, target: str | None = None, low: int = 1, high: int | None = None) -> DataFrame:
    """(anchor, partner, overlap): all pairs that share low to high objects of an edge; anchors' fan bounds hold before any pair is made."""
    own = edges(graph, edge, target).distinct()
    left = own.join(anchors.select("e"), "e", "left_semi").withColumnRenamed("e", "anchor")
    right = own.join(of_kind(graph, partner_kind), "e", "left_semi").withColumnRenamed("e", "partner")
    return shares.pairs(left, right, low, high)


def bridges(graph: Graph, anchors: DataFrame, first: str, second: str, partner_kind: str) -> DataFrame:
    """(anchor, partner): all pairs with a common node, anchor first x, partner second x; ``^second`` is followed backwards."""
    return shares.pairs(*bridge_edges(graph, anchors, first, second, partner_kind)).select("anchor", "partner")


def bridge_edges(graph: Graph, anchors: DataFrame, first: str, second: str, partner_kind: str, met: Callable[[str], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(anchor, x) and (partner, x): edges of anchors, and of partners of a kind, into the nodes that may bridge them; met: a condition that all nodes of both sides meet."""
    ours = edges(graph, first)
    left = (ours if met is None else ours.where(met("x"))).join(anchors.select("e"), "e", "left_semi").withColumnRenamed("e", "anchor")
    theirs = edges(graph, second.removeprefix("^"))
    if second.startswith("^"):
        theirs = theirs.select(F.col("x").alias("e"), F.col("e").alias("x"))
    right = theirs.join(of_kind(graph, partner_kind), "e", "left_semi").withColumnRenamed("e", "partner")
    return left.distinct(), right.distinct()


def bridged(graph: Graph, anchors: DataFrame, first: str, second: str, partner_kind: str, attempts: int = 1, template: str = "bridge", seed: str = SEED) -> DataFrame:
    """(anchor, partner): drawn partners of a kind with a common node, anchor first x, partner second x.

    An anchor without a row has none.
    """
    left, right = bridge_edges(graph, anchors, first, second, partner_kind)
    if attempts == 1:
        return draws.one(draws.written(left, "left"), draws.written(right, "edges"), template, BRIDGE_DRAWS, seed)
    return draws.common(left, right, template, attempts, BRIDGE_DRAWS, seed=seed).select("anchor", "partner")


def unbridged(graph: Graph, anchors: DataFrame, first: str, second: str, partner_kind: str, template: str = "bridge", seed: str = SEED) -> DataFrame:
    """(anchor, partner): for each anchor one drawn partner of a kind that has the edge ``second`` itself and no common node with it.

    An anchor without a row has none.
    """
    left, right = bridge_edges(graph, anchors, first, second, partner_kind)
    return draws.apart(left, right, anchors.select(F.col("e").alias("anchor")), template, seed)


def bridged_or_not(graph: Graph, anchors: DataFrame, first: str, second: str, partner_kind: str, template: str = "bridge", seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """What ``bridged`` and ``unbridged`` give, of anchors and edges that are made once."""
    anchors = draws.written(anchors.select("e"), "pool")
    right = draws.written(bridge_edges(graph, anchors, first, second, partner_kind)[1], "edges")
    met = among(graph.spark, right.select(F.col("x").alias("node")))  # other edges are no common ones
    left = draws.written(bridge_edges(graph, anchors, first, second, partner_kind, met)[0], "left")
    own = anchors.select(F.col("e").alias("anchor"))
    names = draws.Names([own, left.select("x"), right.select("partner"), right.select("x")])
    return draws.one(left, right, template, BRIDGE_DRAWS, seed, names), draws.apart(left, right, own, template, seed, names)


def sample(pool: DataFrame, count: int, template: str, seed: str = SEED) -> DataFrame:
    """``count`` entities of a pool in drawing order."""
    return pool.withColumn("_key", rank_key(seed, template, "e")).orderBy("_key", "e").limit(count).drop("_key")


def sample_answered(pool: DataFrame, answers: DataFrame, count: int, template: str, low: int = 1, high: int | None = None, seed: str = SEED) -> DataFrame:
    """Entities whose answers (e, answer) are within bounds, in drawing order, with ``answers`` as a sorted list, duplicates kept."""
    shaped = answers.groupBy("e").agg(F.sort_array(F.collect_list("answer")).alias("answers"))
    own = pool.join(shaped, "e").where(F.size("answers") >= low)
    if high is not None:
        own = own.where(F.size("answers") <= high)
    return sample(own, count, template, seed)


def sample_pairs(pairs: DataFrame, sizes: DataFrame, count: int, template: str, low: int = 1, high: int | None = None, seed: str = SEED) -> DataFrame:
    """One partner for an anchor: of its first MAX_ATTEMPTS in drawing order, the first whose answer size (anchor, partner, size) fits."""
    order = Window.partitionBy("anchor").orderBy("_key", "partner")
    tried = pairs.withColumn("_key", rank_key(seed, template, "anchor", "partner")).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= MAX_ATTEMPTS)
    fits = tried.join(sizes, ["anchor", "partner"], "left").withColumn("size", F.coalesce("size", F.lit(0))).where(F.col("size") >= low)
    if high is not None:
        fits = fits.where(F.col("size") <= high)
    first = fits.groupBy("anchor").agg(F.min_by(F.struct("partner", "size"), "_n").alias("p")).select("anchor", "p.partner", "p.size")
    return first.withColumn("_key", rank_key(seed, template, "anchor")).orderBy("_key", "anchor").limit(count).drop("_key")


def sample_boolean(true_pairs: DataFrame, false_pairs: DataFrame, count: int, template: str, seed: str = SEED, single: bool = False) -> DataFrame:
    """count // 2 true pairs and the rest false ones, one for an anchor; anchors of true pairs come first and aren't used again.

    single: both hold at most one pair for an anchor, so that they need not be sent to it.
    """
    def drawn(pairs: DataFrame, n: int, tag: str) -> DataFrame:
        keyed = pairs.withColumn("_key", rank_key(seed, f"{template}:{tag}", "anchor", "partner"))
        if single:
            return keyed.orderBy("_key", "anchor").limit(n).select("anchor", "partner", F.lit(tag).alias("answer"))
        one = keyed.groupBy("anchor").agg(F.min(F.struct("_key", "partner")).alias("m"))
        return one.select("anchor", "m.partner", "m._key").orderBy("_key", "anchor").limit(n).select("anchor", "partner", F.lit(tag).alias("answer"))

    yes = drawn(true_pairs, count // 2, "true")
    no = drawn(false_pairs.join(F.broadcast(yes.select("anchor")), "anchor", "left_anti"), count - count // 2, "false")
    return yes.unionByName(no)


def records(sampled: DataFrame, type_id: str, template: str, scoring: str, wording: str, slots: dict[str, str], answer_var: str, seed: str = SEED) -> DataFrame:
    """Question rows of sampled seeds; wording has {slot} for each key of slots (slot -> label column)."""
    text = F.lit(wording)
    for slot, column in slots.items():
        text = F.replace(text, F.lit("{" + slot + "}"), F.col(column))
    n = F.row_number().over(Window.orderBy("_key"))
    keyed = sampled.withColumn("_key", rank_key(seed, template, sampled.columns[0]))
    scalar, labels = (F.lit(None).cast("string"), F.col("answers")) if "answers" in sampled.columns else (F.col("answer"), F.lit(None).cast("array<string>"))
    return keyed.select(F.concat_ws("__", F.lit(type_id), F.lit(template), F.format_string("%02d", n)).alias("question_id"), F.lit(type_id).alias("type_id"), F.lit(template).alias("template_id"), text.alias("question"), F.lit(scoring).alias("scoring"), F.lit(answer_var).alias("answer_var"), scalar.alias("gt_scalar"), labels.alias("gt_set"), F.lit(seed).alias("sampling_seed"))


def distribution(rows: DataFrame) -> DataFrame:
    """(type_id, n) with a total row, whose type is null."""
    return rows.rollup("type_id").agg(F.count("*").alias("n"))


def verify(expected: DataFrame, found: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, answer, side): answers of the one that the other lacks; scalars compare without case."""
    a, b = (df.select(key, F.lower("answer").alias("_k"), "answer").dropDuplicates([key, "_k"]) for df in (expected, found))
    missing = a.join(b.select(key, "_k"), [key, "_k"], "left_anti").select(key, "answer", F.lit("missing").alias("side"))
    return missing.unionByName(b.join(a.select(key, "_k"), [key, "_k"], "left_anti").select(key, "answer", F.lit("extra").alias("side")))


def corpus_entities(nodes: DataFrame, seeds: DataFrame, distractors: int, seed: str = SEED) -> DataFrame:
    """Entities (iri, label) for a corpus: of each seed label the first entity, and drawn others."""
    chosen = nodes.join(seeds.select("label").distinct(), "label", "left_semi").groupBy("label").agg(F.min("iri").alias("iri"))
    others = nodes.join(chosen.select("iri"), "iri", "left_anti").select("iri", "label").withColumn("_key", rank_key(seed, "corpus", "iri")).orderBy("_key", "iri").limit(distractors)
    return chosen.select("iri", "label", F.lit("seed").alias("role")).unionByName(others.select("iri", "label", F.lit("distractor").alias("role")))
