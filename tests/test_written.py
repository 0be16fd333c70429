"""Written queries by shape: as many plans as shapes, each question's rows as if its query ran alone."""

import pytest

from kgspark.operators import retrieve, written
from kgspark.sources.graph import BASE, CLASS, LABEL, PREDICATE, TYPE, Graph


@pytest.fixture(scope="module")
def graph(spark):
    n = lambda k, i: f"{BASE}{k}/{i}"
    frame = lambda rows: spark.createDataFrame(rows, "s string, o string")
    return Graph(spark, {
        TYPE: (frame([(n("a", i), CLASS + "A") for i in range(200)] + [(n("b", i), CLASS + "B") for i in range(30)]), "iri"),
        LABEL: (frame([(n("a", i), f"a {i % 50}") for i in range(200)] + [(n("b", i), f"b {i}") for i in range(30)]), "literal"),
        PREDICATE + "to": (frame([(n("a", i), n("b", (i * k) % 29)) for i in range(200) for k in (1, 2, 3)]), "iri"),
        PREDICATE + "size": (frame([(n("a", i), str(i % 7)) for i in range(200)]), "literal"),
    })


SHAPES = [
    f"SELECT ?x WHERE {{{{ <{BASE}a/{{0}}> kg:to ?x }}}}",
    f"SELECT DISTINCT ?a ?l WHERE {{{{ VALUES ?b {{{{ <{BASE}b/{{1}}> }}}} ?a kg:to ?b ; rdfs:label ?l . OPTIONAL {{{{ ?a kg:size ?z }}}} }}}} ORDER BY DESC(?l) ?a LIMIT 4 OFFSET 1",
    f"SELECT (COUNT(?a) AS ?n) (COUNT(DISTINCT ?l) AS ?m) WHERE {{{{ ?a a c:A ; kg:to <{BASE}b/{{1}}> ; kg:size \"{{2}}\" ; rdfs:label ?l }}}}",
    f"ASK {{{{ <{BASE}a/{{0}}> kg:to / ^kg:to <{BASE}a/{{3}}> }}}}",
    f"SELECT ?z (COUNT(*) AS ?n) WHERE {{{{ ?a kg:to <{BASE}b/{{1}}> ; kg:size ?z }}}} GROUP BY ?z ORDER BY ?z LIMIT 3",
]


def test_a_plan_for_each_shape(spark, graph):
    texts = [SHAPES[i % 5].format(i % 210, i % 31, i % 8, (i * 7) % 200) for i in range(1000)]
    rows = [(f"q{i:04d}", f"Sure:\n```sparql\n{t}\n```" if i % 2 else t) for i, t in enumerate(texts)]
    bad = [("x1", "no query"), ("x2", "DELETE WHERE { ?s ?p ?o }"), ("x3", None), ("x4", "SELECT ?l (COUNT(*) AS ?n) WHERE { ?s rdfs:label ?l } GROUP BY ?s"), ("x5", "")]
    got, plans = written.answered(graph, spark.createDataFrame(rows + bad, "question_id string, answer string"))
    assert plans == 5
    by = {r.question_id: r for r in got.collect()}
    assert len(by) == 1005 and {i for i, r in by.items() if r.miss} == {i for i, _ in bad}
    for i in [*range(0, 30), 995, 999]:
        alone = written.serialised(retrieve.query_text(graph, texts[i])).collect()
        own = by[f"q{i:04d}"]
        assert own.query == texts[i] and own.context == "\n".join(sorted(r.line for r in alone)), texts[i]
        assert own.sources == sorted({s for r in alone for s in r.sources})


def test_queries_without_constants_and_nothing_at_all(spark, graph):
    rows = [("a", "SELECT ?b WHERE { ?b a c:B }"), ("b", "SELECT ?b WHERE { ?b a c:B }")]
    got, plans = written.answered(graph, spark.createDataFrame(rows, "question_id string, answer string"))
    assert plans == 1 and [r.context.count("\n") for r in got.collect()] == [29, 29]
    none, plans = written.answered(graph, spark.createDataFrame([], "question_id string, answer string"))
    assert plans == 0 and none.count() == 0
