"""Arrays of one JSON object: brackets, quotes and backslashes at every split, bzip2, and many tasks for a large file."""

import bz2
import json

import pytest
from pyspark.sql import functions as F

from kgspark.sources import json_array, rdf

ITEMS = [{"k": i, "t": t} for i, t in enumerate(["", "}", "{", "]}", '"', '\\', '\\"', "a\\\\", '}",{"', "[[{{", "é}ü", "x" * 50, "\n}\t", "},{", '\\\\"}'])]
OBJECT = {"meta": {"a": {"b": "}"}, "c": [1, {"k": 99}]}, "first": [], "tuples": [["a", "b"], ["}", "]"]], "nodes": ITEMS, "name": 'no } "array', "edges": [{"k": 1, "t": {"deep": ["}", {"x": "]"}]}}], "last": 5}
SCHEMA = "k int, t string"


@pytest.fixture
def split(spark):
    def into(size):
        for key, value in (("maxPartitionBytes", size), ("openCostInBytes", 1)):
            spark.conf.set(f"spark.sql.files.{key}", str(value))

    yield into
    for key in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{key}")


def test_small_splits(spark, split, tmp_path):
    text = json.dumps(OBJECT, ensure_ascii=False)
    (tmp_path / "o.json").write_text(text)
    whole = [(i, x["k"], x["t"]) for i, x in enumerate(ITEMS)]
    for size in (1 << 20, 61):  # (the first is cut by the number of cores)
        split(size)
        got = sorted(map(tuple, json_array.elements(spark, str(tmp_path / "o.json"), "nodes", SCHEMA).collect()))
        assert got == whole, size
        edge = json_array.elements(spark, str(tmp_path / "o.json"), "edges", SCHEMA).collect()
        assert [(r.pos, r.k, json.loads(r.t)) for r in edge] == [(0, 1, OBJECT["edges"][0]["t"])]
        assert json_array.elements(spark, str(tmp_path / "o.json"), "first", SCHEMA).count() == json_array.elements(spark, str(tmp_path / "o.json"), "none", SCHEMA).count() == 0


def test_states_at_every_cut():
    """What a split does to a reader's state, composed over any two cuts, is what the whole does."""
    import numpy as np

    data = np.frombuffer(json.dumps(OBJECT).encode(), np.uint8)
    within, step, *end = json_array.scanned(data, False, False)
    assert end == [False, False] and step.sum() == 0
    for cut in range(1, len(data)):
        a, b = json_array.scanned(data[:cut], False, False), json_array.scanned(data[cut:], *json_array.scanned(data[:cut], False, False)[2:])
        assert (np.concatenate((a[0], b[0])) == within).all() and (np.concatenate((a[1], b[1])) == step).all() and list(b[2:]) == end


def test_large_files_and_bzip2(spark, split, tmp_path):
    nodes = [{"kind": "K", "identifier": i, "name": f"n}} {i}", "data": {"v": i, "w": ["}"]}} for i in range(5_000)]
    edges = [{"source_id": ["K", i], "target_id": ["K", i + 1], "kind": "e", "direction": "both", "data": {}} for i in range(5000)]
    text = json.dumps({"nodes": nodes, "edges": edges})
    (tmp_path / "g.json").write_text(text)
    (tmp_path / "g.json.bz2").write_bytes(bz2.compress(text.encode(), 1))
    split(30_000)
    assert spark.read.text(str(tmp_path / "g.json"), lineSep="}").rdd.getNumPartitions() >= 10
    for name in ("g.json", "g.json.bz2"):
        a, b = rdf.read_graph(spark, str(tmp_path / name))
        rows = a.orderBy("pos").collect()
        assert [r.pos for r in rows] == list(range(5_000)) == [int(r.identifier) for r in rows]
        assert rows[777].name == "n} 777" and json.loads(rows[777].data) == {"v": 777, "w": ["}"]}
        assert b.agg(F.count("*"), F.sum(F.col("source_id")[1].cast("long"))).first() == (5000, sum(range(5000)))


def test_written_arrays_are_read(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id"), F.concat(F.lit('"}],[{\\'), F.col("id")).alias("t")).repartition(5)
    json_array.write(rows, "nodes", str(tmp_path))
    json_array.write(rows.limit(0), "edges", str(tmp_path))
    assert sorted(map(tuple, json_array.elements(spark, str(tmp_path), "nodes", "id long, t string").drop("pos").collect())) == sorted(map(tuple, rows.collect()))
    assert json_array.elements(spark, str(tmp_path), "edges", "id long, t string").count() == 0


def test_arrays_are_cut_once(spark, split, tmp_path, monkeypatch):
    """src01_json_nodes, src02_json_edges: two arrays are read of one cut, without a shuffle of whole elements, and blanks are none."""
    cuts, cutter = [], json_array.cutter
    monkeypatch.setattr(json_array, "cutter", lambda entry: cuts.append(1) or cutter(entry))
    text = '{"edges": [\n\t], "nodes": [' + ",\n".join(json.dumps({"k": i, "t": "}" * (i % 9)}) for i in range(40)) + '\n], "x": {"nodes": [1]}, "edges": [ {"k": 7}\r\n], "nodes": [{"k": 40}, {"k": 41}]}'
    (tmp_path / "o.json").write_text(text)
    for size in (1 << 20, 50, 23):
        split(size)
        nodes, edges = json_array.arrays(spark, str(tmp_path / "o.json"), {"nodes": SCHEMA, "edges": SCHEMA})
        assert sorted((r.pos, r.k) for r in nodes.collect()) == [(i, i) for i in range(42)], size
        assert [(r.pos, r.k) for r in edges.collect()] == [(0, 7)]
        assert "Window" not in nodes._jdf.queryExecution().optimizedPlan().toString()
    assert len(cuts) == 3
