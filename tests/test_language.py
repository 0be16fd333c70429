"""The query language: what it accepts, what it refuses, and how patterns behave."""

import pytest
from kgspark.operators import retrieve
from kgspark.plans.algebra import InvalidQuery
from kgspark.plans.compiler import execute
from kgspark.plans.sparql import canonical_text, parse, rewrite_values
from kgspark.sources.graph import BASE, CLASS, LABEL, PREDICATE, TYPE, Graph


@pytest.fixture(scope="module")
def small(spark):
    """Three compounds, two of them with one label, and two diseases."""
    pairs = lambda rows: spark.createDataFrame(rows, "s string, o string")
    n = lambda x: BASE + x
    return Graph(spark, {
        TYPE: (pairs([(n(x), CLASS + ("C" if x[0] == "c" else "D")) for x in ("c1", "c2", "c3", "d1", "d2")]), "iri"),
        LABEL: (pairs([(n("c1"), "Aspirin"), (n("c2"), "Aspirin"), (n("c3"), "Other"), (n("d1"), "Pain, acute"), (n("d2"), "Fever")]), "literal"),
        PREDICATE + "treats": (pairs([(n("c1"), n("d1")), (n("c1"), n("d2")), (n("c2"), n("d1"))]), "iri"),
        PREDICATE + "dose": (pairs([(n("c1"), "10"), (n("c2"), "9")]), "literal"),
    }, spark.createDataFrame([(n("c1"), PREDICATE + "treats", n("d1"), PREDICATE + "source", v) for v in ("X", "Y")], "s string, p string, o string, key string, value string"))


def run(graph, text):
    return sorted(tuple(r) for r in execute(graph, text).collect())


def test_bag_and_set(small):
    assert run(small, "SELECT ?l WHERE { ?c kg:treats ?d ; rdfs:label ?l }") == [("Aspirin",)] * 3
    assert run(small, "SELECT DISTINCT ?l WHERE { ?c kg:treats ?d ; rdfs:label ?l }") == [("Aspirin",)]
    assert len(run(small, "SELECT DISTINCT ?c ?l WHERE { ?c kg:treats ?d ; rdfs:label ?l }")) == 2


def test_annotations_are_repeated(small):
    assert run(small, f"SELECT ?v WHERE {{ << <{BASE}c1> kg:treats <{BASE}d1> >> kg:source ?v }}") == [("X",), ("Y",)]


def test_optional_negation_and_numbers(small):
    assert len(run(small, "SELECT ?c ?d WHERE { ?c a c:C . OPTIONAL { ?c kg:treats ?d } }")) == 4
    assert run(small, "SELECT ?c WHERE { ?c a c:C . FILTER NOT EXISTS { ?c kg:treats ?x } }") == [(BASE + "c3",)]
    assert run(small, "SELECT ?c WHERE { ?c a c:C . FILTER EXISTS { ?c kg:treats ?x . ?x rdfs:label \"Fever\" } }") == [(BASE + "c1",)]
    assert run(small, "SELECT ?c WHERE { ?c kg:dose ?n . FILTER(?n > 9.5) }") == [(BASE + "c1",)]
    # an optional part over what may be unbound: c3 treats nothing, and meets every label
    rows = execute(small, "SELECT ?c ?d ?l WHERE { ?c a c:C . OPTIONAL { ?c kg:treats ?d } OPTIONAL { ?d rdfs:label ?l } }").collect()
    labels = {(r.s, r.o) for r in small.scan(LABEL).collect()}
    assert {(r.d, r.l) for r in rows if r.c == BASE + "c3"} == labels and all(r.d is not None for r in rows)
    assert all(r.l is None or (r.d, r.l) in labels for r in rows)


def test_ask_and_counts(small):
    assert run(small, f"ASK {{ <{BASE}c1> kg:treats / ^kg:treats <{BASE}c2> }}") == [("true",)]
    assert run(small, f"ASK {{ <{BASE}c3> kg:treats ?x }}") == [("false",)]
    assert run(small, "SELECT (COUNT(?x) AS ?n) WHERE { ?x kg:none ?y }") == [(0,)]


def test_order_puts_unbound_before_iris_before_literals(small):
    out = [r.x for r in execute(small, "SELECT ?x WHERE { ?c a c:C . OPTIONAL { ?c ?p ?x . FILTER(?p != rdf:type) } } ORDER BY ?x").collect()]
    kinds = [0 if x is None else 1 if x.startswith("http") else 2 for x in out]
    assert kinds == sorted(kinds)


@pytest.mark.parametrize("text", ["", "DELETE WHERE { ?s ?p ?o }", "INSERT DATA { }", "SELECT WHERE { ?s ?p ?o }", "SELECT ?s { ?s nope:x ?o }", "SELECT ?s WHERE { ?s ?p }", "SELECT ?s WHERE { ?s ?p ?o } LIMIT x", "I cannot answer that.", "SELECT ?s WHERE { SERVICE <x> { ?s ?p ?o } }"])
def test_refused(text):
    with pytest.raises(InvalidQuery):
        parse(text)


def test_values_are_rewritten_once():
    text = "SELECT ?s WHERE { VALUES ?a { <x:1> }  # seed\n ?a <p:q> ?s }"
    assert "<y:2> }  # seed" in rewrite_values(text, "a", "y:2")
    for name, bad in (("b", text), ("a", text + "VALUES ?a { <x:2> }")):
        with pytest.raises(InvalidQuery):
            rewrite_values(bad, name, "y:2")
    assert canonical_text("# head\n\nSELECT ?x  # why\nWHERE { }") == "SELECT ?x\nWHERE { }"


def test_written_queries(small):
    assert retrieve.extract_query("Sure:\n```sparql\nSELECT 1\n```\nok") == "SELECT 1"
    assert retrieve.extract_query("```\nSELECT 2") == "SELECT 2"
    assert retrieve.extract_query("SELECT 3") == "SELECT 3"
    assert retrieve.query_text(small, "```\n```") is None and retrieve.query_text(small, "DELETE WHERE { ?s ?p ?o }") is None
    own = retrieve.bounded(parse("PREFIX k: <x:>\nSELECT ?s WHERE { ?s ?p ?o }"))
    assert own.limit == 200 and len(own.order_by) == 1
    assert retrieve.bounded(parse("SELECT ?s WHERE { ?s ?p ?o } LIMIT 5")).limit == 5
    assert retrieve.bounded(parse("SELECT (COUNT (?s) AS ?n) WHERE { ?s ?p ?o }")).limit is None
    lines = retrieve.serialised(retrieve.query_text(small, "SELECT ?d ?l WHERE { ?d a c:D ; rdfs:label ?l }")).collect()
    assert [r.line for r in lines] == [f"d={BASE}d1 | l=Pain, acute", f"d={BASE}d2 | l=Fever"] and lines[0].sources == [BASE + "d1"]


def test_linking_takes_the_longest_match(small, spark):
    asked = spark.createDataFrame([("q1", "Does aspirin help PAIN, acute or fever?"), ("q2", "???"), ("q3", "fever fever")], "question_id string, question string")
    names = retrieve.gazetteer(small)
    assert {r.name: r.iri for r in names.collect()}["aspirin"] == BASE + "c1"
    assert sorted(tuple(r)[:2] for r in retrieve.link(asked, names).collect()) == [("q1", BASE + "c1"), ("q1", BASE + "d1"), ("q1", BASE + "d2"), ("q3", BASE + "d2")]


def test_neighborhood(small, spark):
    asked = spark.createDataFrame([("q", "fever")], "question_id string, question string")
    one = retrieve.retrieve("graph_neighborhood_1hop", small, asked).first()
    assert one.context == "Aspirin treats Fever" and one.sources == [BASE + "c1", BASE + "d2"]
    two = retrieve.retrieve("graph_neighborhood_2hop", small, asked).first()
    assert two.num_triples == 4 and BASE + "d1" in two.sources
    with pytest.raises(KeyError):
        retrieve.retrieve("other", small, asked)


def test_vectors_and_written_queries(small, spark):
    asked = spark.createDataFrame([("q1", "?"), ("q2", "?"), ("q3", "?")], "question_id string, question string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "L", "e", "5", "near"), (2, [0.0, 1.0], "", "e", "6", "far")], "id long, embedding array<double>, label string, entity string, pmid string, document string")
    queries = spark.createDataFrame([("q1", [1.0, 0.1]), ("q2", [0.1, 1.0])], "question_id string, query array<double>")
    out = {r.question_id: r for r in retrieve.retrieve("vector", small, asked, vectors=vectors, queries=queries, k=1).collect()}
    assert [(out[q].context, out[q].sources) for q in ("q1", "q2", "q3")] == [("[L \u2014 PMID 5] near", ["1"]), ("[e \u2014 PMID 6] far", ["2"]), ("", [])]
    answers = spark.createDataFrame([("q1", "```\nSELECT ?d WHERE { ?c kg:treats ?d }\n```"), ("q2", "DROP ALL")], "question_id string, answer string")
    out = {r.question_id: r for r in retrieve.retrieve("graph_sparqlgen", small, asked, answers=answers).collect()}
    assert [out[q].miss for q in ("q1", "q2", "q3")] == [False, True, True] and BASE + "d2" in out["q1"].sources and out["q1"].context.startswith("d=")


def test_cap(spark):
    rows = spark.createDataFrame([("q", f"s{i:03d}", f"p{i % 3}", "o", None) for i in range(400)], "question_id string, s_name string, p_name string, o_name string, other string")
    out = retrieve.capped(rows, 25, 60).collect()
    kept, counts = [], {}
    for i in range(400):
        if counts.get(i % 3, 0) < 25 and len(kept) < 60:
            counts[i % 3] = counts.get(i % 3, 0) + 1
            kept.append(f"s{i:03d}")
    assert sorted(r.s_name for r in out) == kept


def test_store_prunes_partitions(small, spark, tmp_path):
    small.save(str(tmp_path))
    stored = Graph.load(spark, str(tmp_path))
    text = "SELECT ?c ?l WHERE { ?c kg:treats ?d . ?d rdfs:label ?l }"
    assert run(stored, text) == run(small, text)
    plan = stored.scan(PREDICATE + "treats")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(predicate" in plan
