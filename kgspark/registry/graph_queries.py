"""Graph-pattern queries: one for each construct, and the ten question types."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.compiler import execute
from ..plans.sparql import rewrite_values
from ..sources import graph
from . import query
from .graph_sql import B, sql


def text(name: str, sparql: str, twin: str, *, numbers: tuple[str, ...] = (), triples: bool = False, more: str = "") -> None:
    """Register a query text and its twin."""

    @query(name, sql(twin, triples, more))
    def run(spark, sf_dir):
        return execute(graph.from_tables(spark, sf_dir), sparql)


C1, O1, P1, P2, S1 = (f"<{B}{x}>" for x in ("Customer/1", "Order/1", "Part/1", "Part/2", "Supplier/1"))
c1, o1, p1, p2, s1 = (f"'{B}{x}'" for x in ("Customer/1", "Order/1", "Part/1", "Part/2", "Supplier/1"))

text("gq01_constant_predicate", "SELECT ?n ?r WHERE { ?n kg:within ?r }", "SELECT s AS n, o AS r FROM within")
text("gq02_variable_predicate", f"SELECT ?p ?o WHERE {{ {O1} ?p ?o }}", f"SELECT p, o FROM triples WHERE s = {o1}", triples=True)
text("gq02_variable_predicate_in", f"SELECT ?s ?p WHERE {{ ?s ?p <{B}Nation/3> }}", f"SELECT s, p FROM triples WHERE o = '{B}Nation/3'", triples=True)
text("gq03_type_pattern", "SELECT ?e WHERE { ?e a c:Supplier }", "SELECT iri AS e FROM nodes WHERE kind = 'Supplier'")
text("gq04_join_chain", f"SELECT ?o ?p ?l WHERE {{ {C1} kg:places ?o . ?o kg:contains ?p . ?p rdfs:label ?l }}", f"SELECT a.o, b.o AS p, n.label AS l FROM places a JOIN contains b ON a.o = b.s JOIN nodes n ON n.iri = b.o WHERE a.s = {c1}")
text("gq05_intersection", f"SELECT ?x WHERE {{ {P1} kg:supplied_by ?x . {P2} kg:supplied_by ?x }}", f"SELECT o AS x FROM supplied_by WHERE s = {p1} INTERSECT SELECT o FROM supplied_by WHERE s = {p2}")
text("gq06_values", f"SELECT ?a ?o WHERE {{ VALUES ?a {{ {P1} {P2} }} ?a kg:supplied_by ?o }}", f"SELECT s AS a, o FROM supplied_by WHERE s IN ({p1}, {p2})")
text("gq07_two_values", f"SELECT ?o ?s WHERE {{ VALUES ?o {{ {O1} <{B}Order/2> }} VALUES ?s {{ {S1} <{B}Supplier/2> }} ?o kg:contains ?p . ?p kg:supplied_by ?s }}", f"SELECT a.s AS o, b.o AS s FROM contains a JOIN supplied_by b ON a.o = b.s WHERE a.s IN ({o1}, '{B}Order/2') AND b.o IN ({s1}, '{B}Supplier/2')")
text("gq08_path_sequence", f"SELECT ?s WHERE {{ {O1} kg:contains / kg:supplied_by ?s }}", f"SELECT b.o AS s FROM contains a JOIN supplied_by b ON a.o = b.s WHERE a.s = {o1}")
text("gq09_path_inverse", f"SELECT DISTINCT ?o WHERE {{ {S1} ^kg:supplied_by / ^kg:contains ?o }}", f"SELECT DISTINCT b.s AS o FROM supplied_by a JOIN contains b ON a.s = b.o WHERE a.o = {s1}")
text("gq10_not_exists", "SELECT ?e WHERE { ?e a c:Customer . FILTER NOT EXISTS { ?e kg:places_urgent ?bridge } }", "SELECT iri AS e FROM nodes WHERE kind = 'Customer' AND iri NOT IN (SELECT s FROM places_urgent)")
text("gq11_optional", f"SELECT ?p ?o ?l WHERE {{ {O1} ?p ?o . OPTIONAL {{ ?o rdfs:label ?l }} }}", f"SELECT p, o, n.label AS l FROM triples LEFT JOIN nodes n ON n.iri = o WHERE s = {o1}", triples=True)
text("gq12_starts_with", f'SELECT ?p ?o WHERE {{ {C1} ?p ?o . FILTER(STRSTARTS(STR(?p), "{B}p/")) }}', f"SELECT p, o FROM triples WHERE s = {c1} AND starts_with(p, '{B}p/')", triples=True)
text("gq13_not_equal", f"SELECT DISTINCT ?e WHERE {{ {P1} kg:supplied_by ?x . ?e kg:supplied_by ?x . FILTER(?e != {P1}) }}", f"SELECT DISTINCT b.s AS e FROM supplied_by a JOIN supplied_by b ON a.o = b.o WHERE a.s = {p1} AND b.s <> {p1}")
text("gq14_is_iri", f"SELECT ?p ?o (ISIRI(?o) AS ?isIri) WHERE {{ {O1} ?p ?o }}", f"SELECT p, o, CASE WHEN o_kind = 'iri' THEN 'true' ELSE 'false' END AS \"isIri\" FROM triples WHERE s = {o1}", triples=True)
text("gq15_distinct", f"SELECT DISTINCT ?p ?l WHERE {{ {C1} kg:places ?o . ?o kg:contains ?p . ?p rdfs:label ?l }}", f"SELECT DISTINCT b.o AS p, n.label AS l FROM places a JOIN contains b ON a.o = b.s JOIN nodes n ON n.iri = b.o WHERE a.s = {c1}")
text("gq16_bag", f"SELECT ?l WHERE {{ {P1} kg:supplied_by ?s . ?o kg:contains {P1} . ?o kg:status ?l }}", f"SELECT c.o AS l FROM supplied_by a, contains b JOIN status c ON c.s = b.s WHERE a.s = {p1} AND b.o = {p1}")
text("gq17_count_distinct", "SELECT (COUNT(DISTINCT ?x) AS ?n) WHERE { ?a kg:supplied_by ?x }", "SELECT count(DISTINCT o) AS n FROM supplied_by")
text("gq17_count_of_nothing", f"SELECT (COUNT(DISTINCT ?x) AS ?n) WHERE {{ <{B}Part/0> kg:supplied_by ?x }}", f"SELECT count(DISTINCT o) AS n FROM supplied_by WHERE s = '{B}Part/0'")
text("gq18_group_by", "SELECT ?e ?l (COUNT(DISTINCT ?x) AS ?fan) WHERE { ?e a c:Part ; rdfs:label ?l ; kg:supplied_by ?x } GROUP BY ?e ?l", "SELECT iri AS e, label AS l, count(DISTINCT o) AS fan FROM nodes JOIN supplied_by ON s = iri WHERE kind = 'Part' GROUP BY 1, 2")
text("gq19_having", "SELECT ?e (COUNT(DISTINCT ?x) AS ?fan) WHERE { ?e kg:places ?x } GROUP BY ?e HAVING (COUNT(DISTINCT ?x) >= 2 && COUNT(DISTINCT ?x) <= 8)", "SELECT s AS e, count(DISTINCT o) AS fan FROM places GROUP BY 1 HAVING count(DISTINCT o) BETWEEN 2 AND 8")
text("gq20_count_all", "SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o }", "SELECT count(*) AS n FROM triples", triples=True)
text("gq21_count_nodes", f'SELECT (COUNT(DISTINCT ?s) AS ?n) WHERE {{ ?s a ?t . FILTER(STRSTARTS(STR(?t), "{B}class/")) }}', "SELECT count(DISTINCT iri) AS n FROM nodes")
text("gq22_count_edges", "SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o . ?s a ?st . ?o a ?ot }", "SELECT count(*) AS n FROM triples JOIN nodes a ON a.iri = s JOIN nodes b ON b.iri = o", triples=True)
text("gq23_order_by", "SELECT ?e ?l WHERE { ?e a c:Nation ; rdfs:label ?l } ORDER BY ?l ?e", "SELECT iri AS e, label AS l FROM nodes WHERE kind = 'Nation' ORDER BY l, e")
text("gq24_limit", "SELECT ?o ?p WHERE { ?o kg:contains ?p } ORDER BY ?o ?p LIMIT 500", "SELECT s AS o, o AS p FROM contains ORDER BY 1, 2 LIMIT 500")
text("gq25_ask", f"ASK {{ VALUES ?a {{ {O1} }} ?a kg:contains / kg:supplied_by {S1} }}", f"SELECT CASE WHEN count(*) > 0 THEN 'true' ELSE 'false' END AS boolean FROM contains a JOIN supplied_by b ON a.o = b.s WHERE a.s = {o1} AND b.o = {s1}")
text("gq26_quoted_triple", f"SELECT ?part ?q WHERE {{ << {O1} kg:contains ?part >> kg:quantity ?q }}", f"SELECT o AS part, value AS q FROM notes WHERE s = {o1} AND key = 'quantity'")
text("gq26_annotations_by_flag", "SELECT ?flag (COUNT(*) AS ?n) WHERE { << ?o kg:contains ?part >> kg:returnflag ?flag } GROUP BY ?flag", "SELECT value AS flag, count(*) AS n FROM notes WHERE key = 'returnflag' GROUP BY 1")
text("gq27_prefixes", f"PREFIX q: <{B}p/>\nPREFIX x: <{B}>\nSELECT ?r WHERE {{ x:Nation\\/1 q:within ?r }}".replace("x:Nation\\/1", f"<{B}Nation/1>"), f"SELECT o AS r FROM within WHERE s = '{B}Nation/1'")
text("gq28_rewritten_values", rewrite_values("SELECT ?s WHERE { VALUES ?p { n:x }   # the seed\n ?p kg:supplied_by ?s }", "p", f"{B}Part/7"), f"SELECT o AS s FROM supplied_by WHERE s = '{B}Part/7'")
text("gq30_label_by_iri", f"SELECT ?l WHERE {{ VALUES ?x {{ <{B}Region/2> }} ?x rdfs:label ?l }}", f"SELECT label AS l FROM nodes WHERE iri = '{B}Region/2'")
text("gq31_anchor_by_label", 'SELECT ?r WHERE { ?n a c:Nation ; rdfs:label ?name ; kg:within ?r . FILTER(STRENDS(?name, "3")) }', "SELECT o AS r FROM nodes JOIN within ON s = iri WHERE kind = 'Nation' AND label LIKE '%3'")
text("gq32_union_minus_bind", f"SELECT ?x ?tag WHERE {{ {{ {P1} kg:supplied_by ?x }} UNION {{ {P2} kg:supplied_by ?x }} MINUS {{ <{B}Part/3> kg:supplied_by ?x }} BIND(LCASE(STR(?x)) AS ?tag) }}", f"SELECT o AS x, lower(o) AS tag FROM supplied_by WHERE s IN ({p1}, {p2}) AND o NOT IN (SELECT o FROM supplied_by WHERE s = '{B}Part/3')")
text("gq33_aggregates", "SELECT ?b (SUM(?z) AS ?total) (AVG(?z) AS ?mean) (MIN(?z) AS ?low) (MAX(?z) AS ?high) WHERE { ?p kg:brand ?b ; kg:size ?z } GROUP BY ?b", "SELECT b.o AS b, sum(CAST(z.o AS DOUBLE)) AS total, avg(CAST(z.o AS DOUBLE)) AS mean, min(z.o) AS low, max(z.o) AS high FROM brand b JOIN size z USING (s) GROUP BY 1")
text("gq34_regex_offset", 'SELECT ?e WHERE { ?e a c:Part ; kg:brand ?b ; kg:size ?z . FILTER(REGEX(?b, "#[1-3]") || ?z > 40) } ORDER BY ?e LIMIT 50 OFFSET 20', "SELECT s AS e FROM brand JOIN size USING (s) WHERE regexp_matches(brand.o, '#[1-3]') OR CAST(size.o AS INT) > 40 ORDER BY 1 LIMIT 50 OFFSET 20")

# The ten question types, for all seeds at once: a seed's answers are its rows.
text("qt01_attribute", "SELECT ?seed ?answer WHERE { ?seed a c:Customer ; kg:segment ?answer }", "SELECT s AS seed, o AS answer FROM segment")
text("qt02_one_hop", "SELECT ?seed ?answer ?label WHERE { ?seed a c:Order ; kg:contains ?answer . ?answer rdfs:label ?label }", "SELECT s AS seed, o AS answer, label FROM contains JOIN nodes ON iri = o")
text("qt03_two_hop", "SELECT DISTINCT ?seed ?answer WHERE { ?seed kg:places ?o . ?o kg:contains ?answer }", "SELECT DISTINCT a.s AS seed, b.o AS answer FROM places a JOIN contains b ON a.o = b.s")
text("qt04_three_hop", "SELECT DISTINCT ?seed ?answer ?label WHERE { ?seed kg:places ?o . ?o kg:involves ?s . ?s a c:Supplier ; kg:based_in ?answer . ?answer rdfs:label ?label }", f"SELECT DISTINCT a.s AS seed, c.o AS answer, label FROM places a JOIN involves b ON a.o = b.s JOIN based_in c ON c.s = b.o JOIN nodes ON iri = c.o WHERE b.o LIKE '{B}Supplier/%'")
text("qt05_aggregate", "SELECT ?seed (COUNT(DISTINCT ?p) AS ?answer) WHERE { ?p kg:supplied_by ?seed } GROUP BY ?seed", "SELECT o AS seed, count(DISTINCT s) AS answer FROM supplied_by GROUP BY 1")
text("qt06_intersection", f"SELECT DISTINCT ?b ?answer WHERE {{ VALUES ?a {{ {P1} <{B}Part/11> }} ?a kg:supplied_by ?answer . ?b kg:supplied_by ?answer . ?answer a c:Supplier . FILTER(?a != ?b) }}", f"SELECT DISTINCT y.s AS b, y.o AS answer FROM supplied_by x JOIN supplied_by y ON x.o = y.o WHERE x.s IN ({p1}, '{B}Part/11') AND x.s <> y.s")
text("qt07_difference", f"SELECT DISTINCT ?answer WHERE {{ VALUES ?a {{ {P1} }} ?a kg:supplied_by ?answer . ?answer a c:Supplier . FILTER NOT EXISTS {{ {P2} kg:supplied_by ?answer }} }}", f"SELECT o AS answer FROM supplied_by WHERE s = {p1} EXCEPT SELECT o FROM supplied_by WHERE s = {p2}")
text("qt08_negative", "SELECT ?seed (COUNT(DISTINCT ?o) AS ?fan) WHERE { ?seed a c:Customer ; kg:places ?o . FILTER NOT EXISTS { ?seed kg:places_urgent ?u } } GROUP BY ?seed HAVING (COUNT(DISTINCT ?o) >= 5)", "SELECT s AS seed, count(DISTINCT o) AS fan FROM places WHERE s NOT IN (SELECT s FROM places_urgent) GROUP BY 1 HAVING count(DISTINCT o) >= 5")
text("qt09_path_exists", "SELECT DISTINCT ?seed ?target WHERE { ?c kg:segment \"BUILDING\" . ?c kg:places ?seed . ?seed kg:contains / kg:supplied_by ?target }", "SELECT DISTINCT b.o AS seed, d.o AS target FROM segment a JOIN places b ON a.s = b.s JOIN contains c ON c.s = b.o JOIN supplied_by d ON d.s = c.o WHERE a.o = 'BUILDING'")
text("qt10_reference_lookup", "SELECT ?seed ?label WHERE { ?seed a c:Region ; rdfs:label ?label }", "SELECT iri AS seed, label FROM nodes WHERE kind = 'Region'")
