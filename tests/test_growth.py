"""Operators whose work once grew faster than their tables, or met them in few tasks."""

import os

from pyspark.sql import functions as F

from kgspark import registry
from kgspark.operators import adjacency, draws, matching, retrieve, sampling
from kgspark.session import PARTITION
from kgspark.sources import graph as g, scratch


def folders(monkeypatch):
    """Names of the tables that are written."""
    out, new = [], scratch.new_folder
    monkeypatch.setattr(scratch, "new_folder", lambda spark, name: out.append(name) or new(spark, name))
    return out


def test_one_hop_writes_no_edges(spark, sf, monkeypatch):
    """rt06_capped, rt07_context: edges go to their questions and are not stored on the way."""
    names = folders(monkeypatch)
    own = g.from_tables(spark, sf)
    got = adjacency.around(own, own.scan(g.TYPE).where("o like '%/Nation'").select(F.col("s").alias("question_id"), F.col("s").alias("iri")))
    assert got.count() and "runs" not in names and "seen" not in names


def test_two_hops_make_edges_of_nodes_that_are_met(spark, sf, monkeypatch):
    """rt05_two_hops: one region has edges to its nations, and these to what is based there; orders have none that count."""
    made, build = [], adjacency.build
    monkeypatch.setattr(adjacency, "build", lambda *a, **k: made.append(build(*a, **k)) or made[-1])
    anchors = spark.createDataFrame([("q", g.BASE + "Region/1")], "question_id string, iri string")
    got = adjacency.around(g.from_tables(spark, sf), anchors, 2)
    assert got.where("p_name = 'based_in'").count() and not got.where("p_name = 'contains'").count()
    assert sum(m.runs.where("node like '%/Order/%' or node like '%/Part/%'").count() for m in made) == 0


def test_edges_of_other_nodes_are_not_sent(spark, sf, monkeypatch):
    """rt05_two_hops: of all orders' edges those of the one that is met go to their far ends, and labels of others to no node."""
    sent, named = [], adjacency.named
    monkeypatch.setattr(adjacency, "named", lambda graph, rows, *a: sent.append(rows) or named(graph, rows, *a))
    own = g.from_tables(spark, sf)
    nodes = spark.createDataFrame([(g.BASE + "Order/7",)], "iri string")
    got = adjacency.build(own, nodes=nodes, hops=1).runs.collect()
    assert [r.node for r in got] == [g.BASE + "Order/7"]
    assert 0 < sent[0].count() == len({tuple(x) for x in got[0]["items"]})


def test_linking_reads_no_names_in_the_driver(spark, monkeypatch):
    """rt03_linked: names of any number are joined, in either way, with the same result."""
    monkeypatch.setattr(matching, "through", None)
    asked = spark.createDataFrame([("a", "Is Big red-dog here, or a red dog?"), ("b", "big big red"), ("c", None), ("d", "")], "question_id string, question string")
    names = spark.createDataFrame([("big red", "1", 2), ("red dog here", "2", 3), ("big red dog", "3", 3), ("red dog", "4", 2), ("big", "5", 1)], "name string, iri string, words int").withColumn("label", F.col("name"))
    for most in (100, 1):
        monkeypatch.setattr(matching, "HEADS", most)
        assert sorted(map(tuple, retrieve.link(asked, names).select("question_id", "iri").collect())) == [("a", "3"), ("a", "4"), ("b", "1"), ("b", "5")]


def test_partitions_grow_with_the_tables(spark, sf, tmp_path):
    """qt09_path_exists and others: tables of twelve partitions' size are not met in eight."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for name in os.listdir(sf):
        if name != "events.parquet":
            os.symlink(f"{sf}/{name}", tmp_path / name)
    (tmp_path / "lineitem.parquet").unlink()
    spark.read.parquet(f"{sf}/lineitem.parquet").write.parquet(str(tmp_path / "lineitem.parquet"))
    with open(tmp_path / "lineitem.parquet" / "_padding", "wb") as out:
        out.truncate(12 * PARTITION)
    try:
        registry.load()
        assert registry.QUERIES["gq18_group_by"](spark, str(tmp_path)).count()
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) > 12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_draws_store_hubs_of_their_anchors_only(spark, monkeypatch):
    """sm12_order_reaches_supplier, sm12_suppliers_of_one_only: of a hundred hubs one belongs to the anchor."""
    kept, written = {}, draws.written

    def keeping(df, name):
        out = written(df, name)
        kept.setdefault(name, out)
        return out

    monkeypatch.setattr(draws, "written", keeping)
    left = spark.createDataFrame([("a", "x7")], "anchor string, x string")
    right = spark.createDataFrame([(f"p{i}", f"x{i % 100}") for i in range(1000)], "partner string, x string")
    assert draws.common(left, right, "t", 1, 32, seed="s").count() == 1
    assert kept["edges"].count() == 10
    kept.clear()
    assert draws.apart(left, right, left.select("anchor"), "t", "s").count() == 1 and "right" not in kept


def test_pairs_of_five_anchors_are_not_drawn_for_all(spark, sf, monkeypatch):
    """sm09_sample_pairs: anchors are gone through in the order in which five are taken."""
    sizes, paired = [], sampling.paired
    monkeypatch.setattr(sampling, "paired", lambda graph, anchors, *a, **k: sizes.append(anchors.count()) or paired(graph, anchors, *a, **k))
    registry.load()
    assert registry.QUERIES["sm09_sample_pairs"](spark, sf).count() == 5
    assert sizes == [50]


def test_literals_do_not_meet_patterns_of_nodes(spark, sf):
    """gq22_count_edges: objects that must have a class are IRIs; literals are dropped before the joins."""
    from kgspark.plans.compiler import execute

    plan = execute(g.from_tables(spark, sf), "SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o . ?s a ?st . ?o a ?ot }")._jdf.queryExecution().executedPlan().toString()
    assert "o_orderstatus" not in plan and "p_brand" not in plan and "l_partkey" in plan


def test_parts_that_cannot_meet_are_not_read(spark, sf):
    """qt04_three_hop, sm12_nations_supplying: suppliers are no parts, and what they are based in is no customer's."""
    from kgspark.plans.compiler import execute

    own = g.from_tables(spark, sf)
    plan = lambda text: execute(own, text)._jdf.queryExecution().executedPlan().toString()
    got = plan("SELECT DISTINCT ?c ?n ?l WHERE { ?c kg:places ?o . ?o kg:involves ?s . ?s a c:Supplier ; kg:based_in ?n . ?n rdfs:label ?l }")
    assert "l_suppkey" in got and "n_name" in got and "l_partkey" not in got and "c_nationkey" not in got and "p_name" not in got
    assert "l_partkey" in plan("SELECT ?x WHERE { ?o kg:involves ?x }")
    assert execute(own, "SELECT ?x WHERE { ?x kg:within ?y . ?x kg:brand ?z }").count() == 0


def test_annotations_are_told_apart_as_numbers(spark, sf):
    """src16_bulk_load, src16_stored_query: a line is sent once, not its IRIs for each of three annotations."""
    notes = g.from_tables(spark, sf).annotations()
    plan = notes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(l_orderkey" in plan
    assert notes.count() == notes.distinct().count() and notes.where("key is null").count() == 0


def test_lines_of_turtle_meet_within_their_splits(spark, tmp_path):
    """src05_turtle_entities: declarations are found at every split, and no shuffle takes the lines of a file."""
    from kgspark.sources import rdf

    text = "".join(f'n:{i} a kg:K ;\n    rdfs:label "x{i}" ;\n    kg:a 1 .\nn:{i} kg:to n:0 .\n' for i in range(60)) + 'n:60 a kg:K ;\n\n    rdfs:label "apart" .\n'
    (tmp_path / "g.ttl").write_text(text)
    sizes = {"maxPartitionBytes": "37", "openCostInBytes": "1"}
    for key, value in sizes.items():
        spark.conf.set(f"spark.sql.files.{key}", value)
    try:
        found = rdf.read_entities(spark, str(tmp_path / "g.ttl"))
    finally:
        for key in sizes:
            spark.conf.unset(f"spark.sql.files.{key}")
    assert sorted(map(tuple, found.collect())) == sorted((f"n:{i}", "K", f"x{i}") for i in range(60))
    assert "mapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_annotations_of_edges_are_made_without_a_join(spark, sf):
    """src05_turtle_triples: an edge's lines are made of its own row, and quoted triples are not parsed for triples."""
    from kgspark.registry import source_queries as own

    lines = own.rdf.edge_lines(own.property_graph(spark, sf)[1], own.NAMES)
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()


def test_lines_of_a_question_are_not_sent_again(spark, sf):
    """rt08_written_queries: a question's rows are cut and made one text in the same task."""
    from kgspark.operators import written
    from kgspark.registry import question_queries as own

    answers = own.written_answers(spark, sf).where("question_id rlike '^(Part|Customer|Region)/'")
    got, plans = written.answered(g.from_tables(spark, sf), answers)
    lines = got._jdf.queryExecution().executedPlan().toString().splitlines()
    at = [i for i, line in enumerate(lines) if "[collect_list(" in line]
    assert plans == 2 and at and not any("Exchange" in lines[i + 1] for i in at)
    assert got.count() == answers.count() and got.where("miss").count() == 5


def test_edges_of_the_only_node_are_not_sent_to_its_question(spark, sf):
    """rt06_capped, rt07_context: questions of one node are cut where it is; those of two are what they were."""
    own = g.from_tables(spark, sf)
    rows = [("a", "Nation/1"), ("b", "Nation/1"), ("b", "Nation/2"), ("c", "Region/1"), ("c", "Region/1")]
    parts = adjacency.kept(own, spark.createDataFrame([(q, g.BASE + n) for q, n in rows], "question_id string, iri string"))
    alone, rest = parts
    assert alone[1] == ("node", "question_id") and "hashpartitioning(question_id" not in alone[0]._jdf.queryExecution().executedPlan().toString()
    ids = lambda df: {r[0] for r in df.select("question_id").collect()}
    assert ids(alone[0]) == {"a", "c"} and ids(rest[0]) == {"b"}
