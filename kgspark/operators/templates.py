"""Question templates: what is asked, how seeds are drawn, and the query that answers it for all seeds at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..plans.compiler import execute, execute_for
from ..sources.graph import BASE, Graph
from . import sampling


@dataclass(frozen=True)
class Template:
    """query: has a VALUES block for each placeholder; ?answer is what counts.

    mode: fixed (no placeholder), has_edge or lacks_edge (one), paired or bridge
    (two); spec: the pool's bounds; low and high: size of an answer.
    """

    id: str
    type_id: str
    scoring: str
    wording: str
    query: str
    mode: str
    count: int
    spec: dict = field(default_factory=dict)
    low: int = 1
    high: int | None = None


A, B_, SEED = "VALUES ?a { n:x }", "VALUES ?b { n:x }", "VALUES ?seed { n:x }"
TEMPLATES = [
    Template("segment_of_customer", "01", "string_match", "What is the market segment of {seed}?", f"SELECT ?answer WHERE {{ {SEED} ?seed kg:segment ?answer }}", "has_edge", 3, {"kind": "Customer", "edge": "segment"}),
    Template("parts_of_order", "02", "set_match", "Which parts are in {seed}?", f"SELECT ?x ?answer WHERE {{ {SEED} ?seed kg:contains ?x . ?x rdfs:label ?answer }}", "has_edge", 5, {"kind": "Order", "edge": "contains", "low": 2, "high": 25}),
    Template("parts_ordered_by_customer", "03", "set_match", "Which parts has {seed} ordered?", f"SELECT DISTINCT ?x ?answer WHERE {{ {SEED} ?seed kg:places ?o . ?o kg:contains ?x . ?x rdfs:label ?answer }}", "has_edge", 7, {"kind": "Customer", "edge": "places"}, 2, 25),
    Template("nations_supplying_customer", "04", "set_match", "From which nations come the suppliers in orders of {seed}?", f"SELECT DISTINCT ?x ?answer WHERE {{ {SEED} ?seed kg:places ?o . ?o kg:involves ?s . ?s a c:Supplier ; kg:based_in ?x . ?x rdfs:label ?answer }}", "has_edge", 8, {"kind": "Customer", "edge": "places"}, 2, 25),
    Template("parts_of_supplier", "05", "numerical", "How many parts does {seed} supply?", f"SELECT (COUNT(DISTINCT ?p) AS ?answer) WHERE {{ {SEED} ?p kg:supplied_by ?seed }}", "has_edge", 8, {"kind": "Supplier", "edge": "based_in"}),
    Template("shared_suppliers", "06", "set_match", "Which suppliers have {a} and {b} in common?", f"SELECT DISTINCT ?x ?answer WHERE {{ {A} {B_} ?a kg:supplied_by ?x . ?b kg:supplied_by ?x . ?x a c:Supplier ; rdfs:label ?answer }}", "paired", 5, {"kind": "Part", "edge": "supplied_by", "target": "Supplier", "high": 25, "overlap": 2}, 2, 25),
    Template("suppliers_of_one_only", "07", "set_match", "Which suppliers of {a} do not supply {b}?", f"SELECT DISTINCT ?x ?answer WHERE {{ {A} {B_} ?a kg:supplied_by ?x . ?x a c:Supplier ; rdfs:label ?answer . FILTER NOT EXISTS {{ ?b kg:supplied_by ?x }} }}", "paired", 5, {"kind": "Part", "edge": "supplied_by", "target": "Supplier", "low": 3, "high": 25, "overlap": 1}, 2, 25),
    Template("urgent_orders_of_customer", "08", "binary", "Which urgent orders has {seed} placed?", f"SELECT ?x ?answer WHERE {{ {SEED} ?seed kg:places_urgent ?x . ?x rdfs:label ?answer }}", "lacks_edge", 7, {"kind": "Customer", "edge": "places_urgent", "presence": "places", "low": 5}, 0, 0),
    Template("order_reaches_supplier", "09", "boolean", "Does {a} involve a supplier of {b}?", f"SELECT DISTINCT ?a ?b WHERE {{ {A} {B_} ?a kg:involves / ^kg:supplied_by ?b }}", "bridge", 4, {"kind": "Order", "first": "involves", "second": "supplied_by", "partner": "Part", "anchors": 200}),
    Template("second_region", "10", "semantic", "What is the region with key 1 called?", f"SELECT ?answer WHERE {{ <{BASE}Region/1> rdfs:label ?answer }}", "fixed", 1),
]
PLACEHOLDERS = {"fixed": 0, "has_edge": 1, "lacks_edge": 1, "paired": 2, "bridge": 2}


def registry(templates: list[Template] = TEMPLATES) -> list[Template]:
    """Templates by type; an unknown mode is an error."""
    for t in templates:
        if t.mode not in PLACEHOLDERS:
            raise NotImplementedError(f"{t.id}: no sampling mode {t.mode!r}")
    return sorted(templates, key=lambda t: (t.type_id, t.id))


def pool(graph: Graph, t: Template) -> DataFrame:
    own = t.spec
    if t.mode == "has_edge":
        return sampling.has_edge(graph, own["kind"], own["edge"], own.get("target"), own.get("low"), own.get("high"))
    return sampling.lacks_edge(graph, own["kind"], own["edge"], own.get("presence"), own.get("low"))


def answers(graph: Graph, t: Template, seeds: DataFrame) -> DataFrame:
    """seeds and answers: a sorted list of all answers of each seed, duplicates kept, empty if there are none."""
    found = execute_for(graph, t.query, seeds).groupBy(*seeds.columns).agg(F.sort_array(F.collect_list(F.col("answer").cast("string"))).alias("answers"))
    none = F.array(F.lit("0")) if t.scoring == "numerical" else F.array().cast("array<string>")
    return seeds.join(found, seeds.columns, "left").withColumn("answers", F.coalesce("answers", none))


def batches(pool: DataFrame, first: int, template: str, seed: str) -> Iterator[DataFrame]:
    """The first anchors of a pool in drawing order, in growing numbers up to all of them."""
    whole, size = pool.count(), first
    while size < whole:
        yield sampling.sample(pool, size, template, seed)
        size *= 10
    yield pool


def instantiate(graph: Graph, t: Template, seed: str = sampling.SEED) -> DataFrame:
    """Question rows of a template, at most ``count``; more anchors of pairs are tried until there are so many."""
    labels = lambda df, *names: df if not names else labels(df.join(sampling.labelled(graph, df.select(F.col(names[0]).alias("e")).distinct()).select(F.col("e").alias(names[0]), F.col("label").alias(f"{names[0]}_label")), names[0]), *names[1:])
    fits = (F.size("answers") >= t.low) & (F.lit(True) if t.high is None else F.size("answers") <= t.high)
    if t.mode == "fixed":
        rows = execute(graph, t.query).agg(F.sort_array(F.collect_list("answer")).alias("answers")).withColumn("seed", F.lit(t.id))
        names: list[str] = []
    elif PLACEHOLDERS[t.mode] == 1:
        drawn = pool(graph, t).select(F.col("e").alias("seed"))
        rows = answers(graph, t, drawn).where(fits).withColumn("_key", sampling.rank_key(seed, t.id, "seed")).orderBy("_key", "seed").limit(t.count).drop("_key")
        names = ["seed"]
    elif t.mode == "paired":
        own = t.spec
        for anchors in batches(sampling.has_edge(graph, own["kind"], own["edge"], own.get("target"), own.get("low"), own.get("high")), 10 * t.count, t.id, seed):
            pairs = sampling.paired(graph, anchors, own["edge"], own["kind"], own.get("target"), own["overlap"], template=t.id, seed=seed).select(F.col("anchor").alias("a"), F.col("partner").alias("b"))
            found = answers(graph, t, pairs)
            sizes = found.select(F.col("a").alias("anchor"), F.col("b").alias("partner"), F.size("answers").alias("size"))
            picked = sampling.sample_pairs(pairs.withColumnsRenamed({"a": "anchor", "b": "partner"}), sizes, t.count, t.id, t.low, t.high, seed)
            rows = found.join(picked.select(F.col("anchor").alias("a"), F.col("partner").alias("b")), ["a", "b"])
            if rows.count() >= t.count:
                break
        names = ["a", "b"]
    else:
        own = t.spec
        for anchors in batches(sampling.has_edge(graph, own["kind"], own["first"]), own["anchors"], t.id, seed):
            edges = (own["first"], own["second"], own["partner"])
            picked = sampling.sample_boolean(*sampling.bridged_or_not(graph, anchors, *edges, template=t.id, seed=seed), t.count, t.id, seed, single=True)
            picked = picked.withColumnsRenamed({"anchor": "a", "partner": "b"})
            # what the query itself says; a pair on which the two disagree is skipped
            seen = execute_for(graph, t.query, picked.select("a", "b")).withColumn("found", F.lit("true"))
            rows = picked.join(seen, ["a", "b"], "left").where(F.coalesce("found", F.lit("false")) == F.col("answer")).select("a", "b", F.array("answer").alias("answers"))
            if rows.count() >= t.count:
                break
        names = ["a", "b"]
    rows = labels(rows, *names)
    if t.scoring in ("string_match", "numerical", "boolean"):
        rows = rows.withColumn("answer", F.get("answers", F.lit(0))).drop("answers")
    rows = rows.select(names[0] if names else "seed", *[c for c in rows.columns if c not in (names[:1] or ["seed"])])
    return sampling.records(rows, t.type_id, t.id, t.scoring, t.wording, {n: f"{n}_label" for n in names}, "answer", seed)


def explain(graph: Graph, t: Template, seed: str = sampling.SEED) -> str:
    """How a template's questions came about, as Markdown: pool, query, and the questions."""
    lines = [f"# {t.id} (type {t.type_id})", "", f"mode {t.mode}, scoring {t.scoring}, answers {t.low} to {t.high or 'any'}, spec {t.spec}", ""]
    if PLACEHOLDERS[t.mode] == 1:
        lines.append(f"pool: {pool(graph, t).count()} candidates")
    lines += ["", "```sparql", t.query, "```", ""]
    return "\n".join(lines + [f"- {r.question_id}: {r.question}" for r in instantiate(graph, t, seed).orderBy("question_id").collect()]) + "\n"
