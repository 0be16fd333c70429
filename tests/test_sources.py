"""Turtle, articles, abstract files, and run files: fixtures and round trips."""

import json

from pyspark.sql import functions as F

from kgspark.functions.text import escape, unescape
from kgspark.operators import telemetry, validate
from kgspark.sources import articles, rdf, runs
from kgspark.streaming import runs as streams

NAMES = rdf.Names(
    prefixes={"mine": "https://rocks.example.org/mine/", "ore": "http://example.org/ores/O_", "firm": "https://rocks.example.org/firm/"},
    kinds={"Mine": ("mine", False), "Ore": ("ore", True), "Firm": ("firm", False), "Rock Layer": ("ore", True)},
    attributes={"Firm": ("founded",)},
)
GRAPH = {
    "nodes": [
        {"kind": "Firm", "identifier": 88, "name": "Hillside & Daughters", "data": {"founded": "1871"}},
        {"kind": "Mine", "identifier": "M-7", "name": 'The "Old" Shaft', "data": {}},
        {"kind": "Ore", "identifier": "ORE:204", "name": "galena"},
        {"kind": "Ore", "identifier": "ORE:205", "name": "sphalerite"},
    ],
    "edges": [
        {"source_id": ["Mine", "M-7"], "target_id": ["Ore", "ORE:204"], "kind": "yields", "direction": "forward", "data": {"tons": 12.25, "surveyed": True, "maps": ["north", "south"], "years": [1903, 1911], "note": "wet"}},
        {"source_id": ["Firm", 88], "target_id": ["Mine", "M-7"], "kind": "owns", "direction": "forward", "data": {"surveyed": False}},
        {"source_id": ["Mine", "M-7"], "target_id": ["Ore", "ORE:205"], "kind": "yields", "direction": "forward", "data": {}},
    ],
}


def read(spark, tmp_path):
    path = tmp_path / "graph.json"
    path.write_text(json.dumps(GRAPH))
    return rdf.read_graph(spark, str(path))


def test_graph_to_turtle_and_back(spark, tmp_path):
    nodes, edges = read(spark, tmp_path)
    assert (nodes.count(), edges.count()) == (4, 3)
    out = str(tmp_path / "ttl")
    rdf.write_turtle(nodes.coalesce(1), edges, NAMES, out)
    text = "\n".join(r.value for r in spark.read.text(out).collect())
    assert "mine:M-7 a kg:Mine ;" in text and 'rdfs:label "The \\"Old\\" Shaft"' in text
    assert "<< mine:M-7 kg:yields ore:204 >>" in text and 'kg:maps "north" ;' in text and 'kg:maps "south"' in text
    assert "kg:surveyed false" in text and 'kg:tons "12.25"^^xsd:double' in text and "kg:years 1903 ;" in text and 'kg:founded "1871"' in text
    rows = sorted(tuple(r) for r in rdf.read_entities(spark, out).collect())
    assert rows == [("firm:88", "Firm", "Hillside & Daughters"), ("mine:M-7", "Mine", 'The "Old" Shaft'), ("ore:204", "Ore", "galena"), ("ore:205", "Ore", "sphalerite")]


def test_slice_has_only_what_its_edges_touch(spark, tmp_path):
    nodes, edges = rdf.slice_edges(*read(spark, tmp_path), 2)
    assert sorted(r.kind for r in nodes.collect()) == ["Firm", "Mine", "Ore"] and sorted(r.kind for r in edges.collect()) == ["owns", "yields"]


def test_terms(spark):
    rows = [("Ore", "ORE:9031", "ore:9031"), ("Firm", "88", "firm:88"), ("Mine", "M(7)", "<https://rocks.example.org/mine/M(7)>"), ("Cave", "x", None)]
    out = spark.createDataFrame(rows, "k string, i string, want string").select(rdf.term(NAMES, F.col("k"), F.col("i")).alias("t"), "want").collect()
    assert all(r.t == r.want for r in out)
    assert spark.range(1).select(rdf.class_name(F.lit("Rock Layer")).alias("c")).first().c == "RockLayer"


def test_escapes(spark):
    rows = [('a"b',), ("a\\b",), ("l1\nl2",), ("\\n",), ("\t\r\\\\",), ("\x00\\",), ("",)]
    out = spark.createDataFrame(rows, "x string").select("x", escape(F.col("x")).alias("e")).select("x", "e", unescape(F.col("e")).alias("back")).collect()
    assert all(r.x == r.back and "\n" not in r.e for r in out)


def test_articles(spark):
    xml = """<PubmedArticleSet>
      <PubmedArticle><PMID>7001</PMID><ArticleTitle>No abstract here</ArticleTitle></PubmedArticle>
      <PubmedArticle><PMID Version='2'>7002</PMID><ArticleTitle>Lead <sub>2</sub> in <b>old</b> shafts</ArticleTitle>
        <Abstract><AbstractText Label='SITES'>Wet &amp; deep.</AbstractText><AbstractText>Three seams.</AbstractText><AbstractText>Little zinc.</AbstractText></Abstract></PubmedArticle>
    </PubmedArticleSet>"""
    df = spark.createDataFrame([(None,), (xml,), ("<PubmedArticleSet/>",)], "value string")
    assert [tuple(r) for r in articles.parse_articles(df).collect()] == [("7002", "Lead 2 in old shafts", "Wet & deep. Three seams. Little zinc.")]


def test_abstract_files(spark):
    text = "# entity: ore:204\tgalena\t(Ore)\n\n# pmid: 7002\n# title: Old shafts\nthree seams\n of lead\n\n# pmid: 7003\n# title: Zinc\nlittle\n"
    out = articles.parse(spark.createDataFrame([(text,)], "text string"))
    assert [tuple(r) for r in out.orderBy("pmid").collect()] == [("ore:204", "galena", "Ore", "7002", "Old shafts", "three seams of lead"), ("ore:204", "galena", "Ore", "7003", "Zinc", "little")]
    back = articles.parse(articles.render(out))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, out.collect()))
    bare = articles.parse(spark.createDataFrame([("# pmid: 1\nbody",)], "text string")).first()
    assert (bare.entity, bare.pmid, bare.abstract) == ("", "1", "body")


def test_runs(spark, tmp_path):
    for name, question in (("a", "q1"), ("b", "q2"), ("orphan", "q3")):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"question_id": question, "passed": True, "judge_details": {"recall": 0.5, "extra": ["x", "y"]}}) + "\n\n")
    for name in ("a", "b"):
        (tmp_path / f"{name}.manifest.json").write_text(json.dumps({"run_id": f"r-{name}", "timestamp": "2026-06-01T00:00:00+0000", "retriever": "graph_neighborhood_2hop", "generator_model": "m-20251001"}))
    rows, manifests = runs.discover(spark, str(tmp_path))
    assert sorted((r.run_id, r.question_id) for r in rows.collect()) == [("r-a", "q1"), ("r-b", "q2")]
    out = telemetry.load(rows, manifests, runs.profiles(spark, str(tmp_path))).orderBy("run_id").collect()
    assert [(r.recall, r.num_extra, r.hops, r.generator_model_family) for r in out] == [(0.5, 2, 2.0, "m")] * 2
    assert all(c in out[0] and out[0][c] is None for c in telemetry.GUARANTEED)
    assert runs.full_runs(rows, 1).count() == 2 and runs.full_runs(rows, 58).count() == 0


def test_latest_wins(spark):
    rows = [("r1", "q1", False, "2026-06-01", "w1"), ("r2", "q1", True, "2026-06-02", "w1"), ("r2", "q2", True, "2026-06-02", None), ("r3", "q1", False, "2026-06-03", "w2"), ("r0", "q2", False, "2026-06-01", None)]
    df = spark.createDataFrame(rows, "run_id string, question_id string, passed boolean, run_ts string, w string").select("*", F.lit("graph").alias("retriever"), F.lit("m").alias("generator_model"), F.to_json(F.struct(F.col("w").alias("writer_model"))).alias("traversal_info"))
    out = telemetry.canonical(telemetry.with_families(df))
    assert sorted((r.run_id, r.question_id) for r in out.collect()) == [("r2", "q1"), ("r2", "q2"), ("r3", "q1")]


def test_validator(spark):
    schema = "question_id string, type_id string, template_id string, question string, scoring string, answer_var string, gt_scalar string, gt_set array<string>, sampling_seed string"
    meta = spark.createDataFrame([("t", 1, 2, 3)], "template_id string, count int, min_answer int, max_answer int")
    good = ("q", "01", "t", "Which?", "set_match", "x", None, ["a", "b"], "s")
    cases = {None: {}, "missing question": {3: None}, "placeholder left": {3: "Which {x}?"}, "scalar expected": {4: "string_match"}, "list expected": {7: None}, "empty list expected": {4: "binary"}, "true or false expected": {4: "boolean"}, "below the least answer": {7: ["a"]}, "above the greatest answer": {7: list("abcd")}}
    for rule, change in cases.items():
        row = tuple(change.get(i, v) for i, v in enumerate(good))
        assert [r.rule for r in validate.problems(spark.createDataFrame([row], schema), meta).collect()] == ([rule] if rule else [])
    twice = {r.rule for r in validate.problems(spark.createDataFrame([good, good], schema), meta).collect()}
    assert twice == {"id is not unique", "count differs"}


def test_sessions(spark, tmp_path):
    spark.sql("SELECT stack(3, 1L, timestamp'2024-01-01 00:00:00', 2L, timestamp'2024-01-01 00:05:00', 3L, timestamp'2024-01-01 01:00:00') AS (event_id, ts)").select("event_id", "ts", F.lit(7).alias("user_id")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id int").parquet(str(tmp_path / "in"))
    out = streams.run_to_end(streams.sessions(stream), "sessions_test").collect()
    assert sorted(r.n for r in out) == [1, 2]


def test_articles_in_full_syntax(spark):
    head = '<!DOCTYPE PubmedArticleSet [<!ENTITY unit "kg">]>'
    one = "<PubmedArticle><MedlineCitation><PMID>{}</PMID><Article><ArticleTitle>{}</ArticleTitle>{}</Article></MedlineCitation></PubmedArticle>"
    text = lambda *parts: "<Abstract>" + "".join(f"<AbstractText>{p}</AbstractText>" for p in parts) + "</Abstract>"
    good = head + "<PubmedArticleSet>" + one.format(1, "<![CDATA[a < b]]> c", text("&#945;&#x3b2; 5 &unit;", "x<sup>2</sup>y", "", "  ")) + one.format(2, "no text", "<Abstract/>") + one.format(3, "", text("<!-- c -->plain <i>in <b>two</b></i> tags")) + one.format(4, "t", text("quoted &lt;PubmedArticle&gt;")) + "</PubmedArticleSet>"
    rows = [(good,), ("<PubmedArticleSet>" + one.format(5, "t", text("lost & gone")) + "</PubmedArticleSet>",), (None,), ("",), ("<PubmedArticleSet></PubmedArticleSet>",), ("<?xml version='1.0' encoding='latin-1'?>" + one.format(6, "é", text("ü")),)]
    df = spark.createDataFrame(rows, "value string")
    got = sorted(tuple(r) for r in articles.parse_articles(df).collect())
    assert got == [("1", "a < b c", "αβ 5 kg x 2 y"), ("3", "", "plain in two tags"), ("4", "t", "quoted <PubmedArticle>"), ("6", "é", "ü")]
    assert articles.faults(df).count() == 1


def test_turtle_read_back_in_full(spark, tmp_path):
    text = """@prefix k: <x:k/> .
@prefix : <x:> .
# a comment
:a a k:Kind ;
    k:name "dots . and \\"signs\\" ; \\\\ \\n over . \\t" ;
    k:n 5 ; k:d -1.5e3 ; k:t true ; k:o :b , <x:c d> .
:a k:to :b .
<< :a k:to :b >> k:source "A . B" , "C" ;
    k:weight "0.25"^^<http://www.w3.org/2001/XMLSchema#double> .
:c nope:x :d .
:c k:to [ ] .
:c k:to :d .
"""
    (tmp_path / "g.ttl").write_text(text)
    triples, notes, errors = rdf.read_turtle(spark, str(tmp_path))
    assert {(r.s, r.p, r.o, r.o_kind) for r in triples.collect()} == {
        ("x:a", rdf.RDF_TYPE, "x:k/Kind", "iri"), ("x:a", "x:k/name", 'dots . and "signs" ; \\ \n over . \t', "literal"), ("x:a", "x:k/n", "5", "literal"), ("x:a", "x:k/d", "-1.5e3", "literal"),
        ("x:a", "x:k/t", "true", "literal"), ("x:a", "x:k/o", "x:b", "iri"), ("x:a", "x:k/o", "x:c d", "iri"), ("x:a", "x:k/to", "x:b", "iri"), ("x:c", "x:k/to", "x:d", "iri"),
    }
    assert {tuple(r) for r in notes.collect()} == {("x:a", "x:k/to", "x:b", "x:k/" + k, v, rdf.XSD + t) for k, v, t in (("source", "A . B", "string"), ("source", "C", "string"), ("weight", "0.25", "double"))}
    assert errors.count() == 2
