"""Queries of question templates over the graph of the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import retrieve, sampling, templates, validate
from ..plans.algebra import InvalidQuery
from ..plans.sparql import canonical_text, parse
from ..sources import graph as g, scratch
from . import draw_sql, query
from .graph_sql import B, sql
from .question_queries import ORDER_EDGES, ORDERS, at, drawn_pairs


def template(name: str):
    return next(t for t in templates.TEMPLATES if t.id == name)


def shaped(rows: DataFrame) -> DataFrame:
    return rows.select("question_id", "question", F.coalesce("gt_scalar", F.array_join("gt_set", "~")).alias("truth"))


def register(key: str, name: str, twin: str | None = None) -> None:
    @query(key, twin)
    def run(spark, sf_dir):
        return shaped(templates.instantiate(g.from_tables(spark, sf_dir), template(name)))


LAB = "(SELECT iri, min(label) AS label FROM nodes GROUP BY 1)"


def one(name: str, answers: str, wording: str, bounds: str = "true", type_id: str = "", truth: str = "string_agg(answer, '~' ORDER BY answer)") -> str:
    """Twin of a template with one seed: answers (seed, answer)."""
    t = template(name)
    return sql(f"""SELECT '{t.type_id}__{name}__' || lpad('' || row_number() OVER (ORDER BY k), 2, '0') AS question_id, replace('{wording}', '{{seed}}', label) AS question, truth
FROM (SELECT *, {at(name, 'seed')} AS k FROM (SELECT seed, count(*) AS n, {truth} AS truth FROM ({answers}) GROUP BY 1) WHERE {bounds} ORDER BY k, seed LIMIT {t.count}) JOIN {LAB} ON iri = seed""")


register("sm12_segment_of_customer", "segment_of_customer", one("segment_of_customer", "SELECT s AS seed, o AS answer FROM segment", template("segment_of_customer").wording))
register("sm12_parts_of_order", "parts_of_order", one("parts_of_order", "SELECT s AS seed, label AS answer FROM contains JOIN nodes ON iri = o", template("parts_of_order").wording, "n BETWEEN 2 AND 25"))
register("sm12_parts_ordered", "parts_ordered_by_customer", one("parts_ordered_by_customer", "SELECT DISTINCT a.s AS seed, b.o, label AS answer FROM places a JOIN contains b ON a.o = b.s JOIN nodes ON iri = b.o", template("parts_ordered_by_customer").wording, "n BETWEEN 2 AND 25"))
register("sm12_nations_supplying", "nations_supplying_customer", one("nations_supplying_customer", f"SELECT DISTINCT a.s AS seed, c.o, label AS answer FROM places a JOIN involves b ON a.o = b.s JOIN based_in c ON c.s = b.o JOIN nodes ON iri = c.o WHERE b.o LIKE '{B}Supplier/%'", template("nations_supplying_customer").wording, "n BETWEEN 2 AND 25"))
register("sm12_parts_of_supplier", "parts_of_supplier", one("parts_of_supplier", "SELECT o AS seed, s AS answer FROM supplied_by", template("parts_of_supplier").wording, truth="'' || count(DISTINCT answer)"))


def two(name: str, size: str, answers: str, least: int, low: int = 1) -> str:
    """Twin of a template with two seeds: drawn pairs, the size of their answer, and the answers (anchor, partner, answer)."""
    t = template(name)
    chosen = f"picked AS (SELECT anchor, partner, {at(name, 'anchor')} AS k FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY nth) AS first FROM pairs WHERE ({size}) BETWEEN {t.low} AND {t.high}) WHERE first = 1 ORDER BY k, anchor LIMIT {t.count})"
    return sql(f"""SELECT '{t.type_id}__{name}__' || lpad('' || row_number() OVER (ORDER BY k), 2, '0') AS question_id, replace(replace('{t.wording}', '{{a}}', a.label), '{{b}}', b.label) AS question, truth
FROM picked JOIN (SELECT anchor, partner, string_agg(answer, '~' ORDER BY answer) AS truth FROM ({answers}) GROUP BY 1, 2) USING (anchor, partner) JOIN {LAB} a ON a.iri = anchor JOIN {LAB} b ON b.iri = partner""", more=drawn_pairs(name, least, low) + ", " + chosen)


register("sm12_shared_suppliers", "shared_suppliers", two("shared_suppliers", "overlap", "SELECT anchor, partner, label AS answer FROM picked JOIN supplied_by x ON x.s = anchor JOIN supplied_by y ON y.s = partner AND y.o = x.o JOIN nodes ON iri = x.o", 2))
register("sm12_suppliers_of_one_only", "suppliers_of_one_only", two("suppliers_of_one_only", "(SELECT count(*) FROM supplied_by WHERE s = anchor) - overlap", "SELECT anchor, partner, label AS answer FROM picked JOIN supplied_by x ON x.s = anchor JOIN nodes ON iri = x.o WHERE NOT EXISTS (SELECT 1 FROM supplied_by y WHERE y.s = partner AND y.o = x.o)", 1, 3))
register("sm12_urgent_orders", "urgent_orders_of_customer", one("urgent_orders_of_customer", "SELECT s AS seed, o AS answer FROM places WHERE s NOT IN (SELECT s FROM places_urgent)", template("urgent_orders_of_customer").wording, "n >= 5", truth="''"))


def reaches() -> str:
    t = template("order_reaches_supplier")
    name, yes = t.id, t.count // 2
    more = ", ".join([draw_sql.common("yes", *ORDER_EDGES, name, 1, sampling.BRIDGE_DRAWS), draw_sql.apart("no", ORDERS, *ORDER_EDGES, name), f"""pool AS (SELECT anchor FROM {ORDERS} ORDER BY {at(name, 'anchor')}, anchor LIMIT {t.spec['anchors']}),
y1 AS (SELECT anchor, partner, {at(name + ':true', 'anchor', 'partner')} AS k FROM yes JOIN pool USING (anchor) ORDER BY k, anchor LIMIT {yes}),
n1 AS (SELECT anchor, partner, {at(name + ':false', 'anchor', 'partner')} AS k FROM no JOIN pool USING (anchor) WHERE anchor NOT IN (SELECT anchor FROM y1) ORDER BY k, anchor LIMIT {t.count - yes}),
picked AS (SELECT anchor, partner, 'true' AS truth, {at(name, 'anchor')} AS k FROM y1 UNION ALL SELECT anchor, partner, 'false', {at(name, 'anchor')} FROM n1)"""])
    return sql(f"SELECT '{t.type_id}__{name}__' || lpad('' || row_number() OVER (ORDER BY k), 2, '0') AS question_id, replace(replace('{t.wording}', '{{a}}', a.label), '{{b}}', b.label) AS question, truth FROM picked JOIN {LAB} a ON a.iri = anchor JOIN {LAB} b ON b.iri = partner", more=more)


register("sm12_order_reaches_supplier", "order_reaches_supplier", reaches())
register("sm11_fixed", "second_region", sql(f"SELECT '10__second_region__01' AS question_id, 'What is the region with key 1 called?' AS question, label AS truth FROM nodes WHERE iri = '{B}Region/1'"))


@query("sm16_registry", "SELECT * FROM (VALUES " + ", ".join(f"('{t.type_id}', '{t.id}', {t.count})" for t in templates.TEMPLATES) + ") AS t(type_id, template_id, count)")
def sm16(spark, sf_dir):
    return spark.createDataFrame([(t.type_id, t.id, t.count) for t in templates.registry()], "type_id string, template_id string, count int")


@query("sm19_validate_all")
def sm19(spark, sf_dir):
    """Problems of the questions of all templates; those whose pools are too small here are reported."""
    graph = g.from_tables(spark, sf_dir)
    own = templates.registry()
    meta = spark.createDataFrame([(t.id, t.count, t.low, t.high) for t in own], "template_id string, count int, min_answer int, max_answer int")
    path = scratch.new_folder(spark, "produced")  # written once, as the rules read it several times
    for t in own:
        templates.instantiate(graph, t).write.mode("append").parquet(path)
    return validate.problems(spark.read.parquet(path), meta)


def fixed(key: str, rows: list[tuple[str, str]], want: list[tuple[str, str]]) -> None:
    """A driver-side text operator over given cases, as rows."""
    cell = lambda s: "'" + s.replace("'", "''") + "'"

    @query(key, "SELECT * FROM (VALUES " + ", ".join(f"({cell(a)}, {cell(b)})" for a, b in want) + ") AS t(name, value)")
    def run(spark, sf_dir):
        return spark.createDataFrame(rows, "name string, value string")


def accepted(text: str) -> str:
    try:
        return "query" if parse(text) else ""
    except InvalidQuery:
        return "miss"


TEXTS = {"plain": "SELECT ?s WHERE { ?s ?p ?o }", "led": "PREFIX x: <y:>\nASK { ?s x:p ?o }", "update": "DELETE WHERE { ?s ?p ?o }", "refusal": "I cannot say."}
fixed("gq29_canonical_text", [("a", canonical_text("# head\nSELECT ?x  # why\nWHERE { ?x ?p ?o }"))], [("a", "SELECT ?x\nWHERE { ?x ?p ?o }")])
fixed("rt09_fences", [(k, retrieve.extract_query(f)) for k, f in {"closed": "ok\n```sparql\nASK {}\n```\nend", "open": "```\nASK {}", "bare": " ASK {} "}.items()], [(k, "ASK {}") for k in ("closed", "open", "bare")])
fixed("rt10_gate", [(k, accepted(t)) for k, t in TEXTS.items()], [("plain", "query"), ("led", "query"), ("update", "miss"), ("refusal", "miss")])
fixed("rt11_bounds", [(k, str(retrieve.bounded(parse(t)).limit)) for k, t in {"plain": TEXTS["plain"], "own": TEXTS["plain"] + " LIMIT 5", "count": "SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o }", "led": "PREFIX x: <y:>\nSELECT ?s WHERE { ?s x:p ?o }"}.items()], [("plain", "200"), ("own", "5"), ("count", "None"), ("led", "200")])
fixed("rt13_registry", [(k, "retriever") for k in retrieve.REGISTRY], [(k, "retriever") for k in ("closed_book", "vector", "graph_neighborhood_1hop", "graph_neighborhood_2hop", "graph_sparqlgen")])


@query("sm15_explain")
def sm15(spark, sf_dir):
    """The lines that say how a template's questions came about."""
    text = templates.explain(g.from_tables(spark, sf_dir), template("segment_of_customer"))
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "n int, line string")
