"""Property-graph JSON to Turtle with edge annotations, and back to entities.

Kinds and their namespaces are a parameter, so any graph of nodes (kind,
identifier, name, data) and edges (source_id, target_id, kind, direction, data)
can be written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import escape, unescape
from . import json_array, scratch

NODE_SCHEMA = "kind string, identifier string, name string, data string"
EDGE_SCHEMA = "source_id array<string>, target_id array<string>, kind string, direction string, data string"
RDF_TYPE, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/2001/XMLSchema#"
LOCAL = r"^[A-Za-z0-9_][A-Za-z0-9_.\-]*$"


@dataclass
class Names:
    """prefixes: prefix -> namespace; kinds: kind -> (prefix, whether 'XXX:' is cut off); attributes: kind -> data keys that are written."""

    prefixes: dict[str, str]
    kinds: dict[str, tuple[str, bool]]
    attributes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    vocabulary: str = "kg"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with a position, from a JSON object with these arrays (.json or .json.bz2), read by many tasks; data stays JSON text."""
    nodes, edges = json_array.arrays(spark, path, {"nodes": NODE_SCHEMA, "edges": EDGE_SCHEMA})
    return nodes, edges


def read_lines(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """The same from JSON lines, which can be split; for large graphs."""
    order = F.monotonically_increasing_id().alias("pos")
    return spark.read.schema(NODE_SCHEMA).json(nodes).select(order, "*"), spark.read.schema(EDGE_SCHEMA).json(edges).select(order, "*")


def slice_edges(nodes: DataFrame, edges: DataFrame, first: int) -> tuple[DataFrame, DataFrame]:
    """The first edges and only the nodes that they touch."""
    edges = edges.orderBy("pos").limit(first)
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("e")).select(F.col("e")[0].alias("kind"), F.col("e")[1].alias("identifier")).distinct()
    return nodes.join(ends, ["kind", "identifier"], "left_semi"), edges


def term(names: Names, kind: Column, identifier: Column) -> Column:
    """prefix:local, or <IRI> where the local part isn't safe; null for an unknown kind."""
    out = None
    for own, (prefix, strip) in names.kinds.items():
        local = F.regexp_replace(identifier, "^[^:]*:", "") if strip else identifier
        value = F.when(F.regexp_like(local, F.lit(LOCAL)), F.concat(F.lit(f"{prefix}:"), local)).otherwise(F.concat(F.lit(f"<{names.prefixes[prefix]}"), local, F.lit(">")))
        out = F.when(kind == own, value) if out is None else out.when(kind == own, value)
    return out


def class_name(kind: Column) -> Column:
    return F.replace(kind, F.lit(" "), F.lit(""))


def literal(json: Column) -> Column:
    """A JSON scalar as a Turtle literal: booleans and whole numbers bare, other numbers xsd:double, texts quoted."""
    is_text = F.startswith(json, F.lit('"'))
    text = F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v")
    return F.when(is_text, F.concat(F.lit('"'), escape(text), F.lit('"'))).when(json.isin("true", "false") | F.regexp_like(json, F.lit("^-?[0-9]+$")), json).otherwise(F.concat(F.lit('"'), json, F.lit('"^^xsd:double')))


def annotations(direction: Column, data: Column, vocabulary: str) -> Column:
    """The clauses of an edge: its direction, then its data as literals in the order of their keys, lists as several."""
    data = F.coalesce(data, F.lit("{}"))
    keys = F.json_object_keys(data)
    clause = lambda key, value: F.concat(F.lit(f"{vocabulary}:"), key, F.lit(" "), value)

    def items(value: Column) -> Column:
        is_list = F.startswith(F.schema_of_variant(value), F.lit("ARRAY"))
        return F.when(is_list, value.try_cast("array<variant>")).otherwise(F.array(value))

    once = lambda value, use: F.flatten(F.transform(F.array(value), use))  # noqa: E731  (what is used twice is made once)

    def of_key(v: Column, key: Column) -> Column:
        texts = once(F.variant_get(v, F.concat(F.lit('$["'), key, F.lit('"]')), "variant"), lambda value: F.transform(items(value), lambda item: F.to_json(item)))
        return F.transform(texts, lambda json: clause(key, literal(json)))

    own = F.when(F.size(keys) > 0, F.flatten(F.transform(F.array(F.parse_json(data)), lambda v: F.flatten(F.transform(keys, lambda key: of_key(v, key))))))
    return F.concat(F.array(clause(F.lit("direction"), F.concat(F.lit('"'), escape(direction), F.lit('"')))), F.coalesce(own, F.array().cast("array<string>")))


def node_line(names: Names) -> Column:
    """A node's declaration: type, label and the attributes written for the kind."""
    clauses = [F.concat(F.lit(f"a {names.vocabulary}:"), class_name(F.col("kind"))), F.concat(F.lit('rdfs:label "'), escape(F.col("name")), F.lit('"'))]
    for kind, keys in names.attributes.items():
        for key in keys:
            value = F.get_json_object("data", f"$.{key}")
            clauses.append(F.when((F.col("kind") == kind) & (value != ""), F.concat(F.lit(f"{names.vocabulary}:{key} "), literal(F.expr(f"to_json(variant_get(parse_json(data), '$.{key}', 'variant'))")))))
    return F.concat(term(names, F.col("kind"), F.col("identifier")), F.lit(" "), F.concat_ws(" ;\n    ", *clauses), F.lit(" ."))


def edge_line(names: Names) -> Column:
    """An edge's triple and its annotations."""
    s, o = (term(names, F.col(c)[0], F.col(c)[1]) for c in ("source_id", "target_id"))
    t = F.concat_ws(" ", s, F.concat(F.lit(f"{names.vocabulary}:"), "kind"), o)
    return F.concat(t, F.lit(" .\n<< "), t, F.lit(" >> "), F.array_join(annotations(F.col("direction"), F.col("data"), names.vocabulary), " ;\n    "), F.lit(" ."))


def node_lines(nodes: DataFrame, names: Names) -> DataFrame:
    """(pos, line) of node declarations."""
    return nodes.select("pos", node_line(names).alias("line"))


def edge_lines(edges: DataFrame, names: Names) -> DataFrame:
    """(pos, line) of edges."""
    return edges.select("pos", edge_line(names).alias("line"))


def write_turtle(nodes: DataFrame, edges: DataFrame, names: Names, path: str) -> None:
    """Text files: prefixes, nodes, edges, in order of their positions; lines are made of what is in order."""
    spark = nodes.sparkSession
    head = spark.createDataFrame([(0, i, f"@prefix {p}: <{iri}> .") for i, (p, iri) in enumerate(names.prefixes.items())], "part int, pos long, line string")
    rows = head
    for i, df, columns in ((1, nodes, ("kind", "identifier", "name", "data")), (2, edges, ("kind", "source_id", "target_id", "direction", "data"))):
        rows = rows.unionByName(df.select(F.lit(i).alias("part"), F.col("pos").cast("long").alias("pos"), *columns), allowMissingColumns=True)
    line = F.when(F.col("part") == 0, F.col("line")).when(F.col("part") == 1, node_line(names)).otherwise(edge_line(names))
    rows.orderBy("part", "pos").select(line.alias("line")).write.mode("overwrite").text(path)


ENTITY = "file string, begin long, ends boolean, value string, after string"


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that follow each other within a split, and a row for each split with its last line and its first."""
    key, first, last = None, None, pa.array([], pa.string())

    def made(own: tuple[str, int], ends: bool, value: pa.Array, after: pa.Array) -> pa.RecordBatch:
        n = len(value)
        return pa.RecordBatch.from_arrays([pa.array([own[0]] * n, pa.string()), pa.array([own[1]] * n, pa.int64()), pa.array([ends] * n, pa.bool_()), value, after], [c.split()[0] for c in ENTITY.split(", ")])

    for own, texts in json_array.by_split(batches):
        texts = texts.cast(pa.string())
        if own != key:
            if key is not None:
                yield made(key, True, last, first)
            key, first, last = own, texts.slice(0, 1), texts.slice(0, 0)
        lines = pa.concat_arrays([last, texts])
        value, after = lines.slice(0, len(lines) - 1), lines.slice(1)
        both = pc.and_(value.is_valid(), after.is_valid())
        yield made(own, False, value.filter(both), after.filter(both))
        last = lines.slice(len(lines) - 1)
    if key is not None:
        yield made(key, True, last, first)


def read_entities(spark: SparkSession, path: str, vocabulary: str = "kg") -> DataFrame:
    """(term, kind, label) of node declarations: a line with the class, then one with the label, ended by ; or a dot.

    Lines meet within their split; only its last and its first go to its neighbours.
    """
    node = rf"^(\S+)\s+a\s+{vocabulary}:(\w+)\s*;"
    label = r'^\s*rdfs:label\s+"(.*)"\s*[;.]\s*$'
    some = F.regexp_like("value", F.lit(node)) | F.regexp_like("value", F.lit(label))
    lines = spark.read.text(path).select(F.when(some, F.col("value")).alias("value"), F.hex(F.xxhash64("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("begin"))
    folder = scratch.new_folder(spark, "lines")
    lines.mapInArrow(neighbours, ENTITY).where(F.col("ends") | F.regexp_like("value", F.lit(node)) & F.regexp_like("after", F.lit(label))).write.parquet(folder)
    found = spark.read.schema(ENTITY).parquet(folder)
    over = found.where("ends").select("value", F.lead("after").over(Window.partitionBy("file").orderBy("begin")).alias("after"))
    over = over.where(F.regexp_like("value", F.lit(node)) & F.regexp_like("after", F.lit(label)))
    pairs = found.where("not ends").select("value", "after").unionByName(over)
    return pairs.select(F.regexp_extract("value", node, 1).alias("term"), F.regexp_extract("value", node, 2).alias("kind"), unescape(F.regexp_extract("after", label, 1)).alias("label"))


TOKEN = re.compile(r'\s*(?:(<<|>>|[;,])|<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:\^\^(?:<([^>]*)>|([\w.\-]+):([\w.\-]*))|@[\w\-]+)?|(true|false)\b|([+-]?[0-9]+(?![\w:.]))|([+-]?[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?(?![\w:]))|(a)(?=\s)|([\w\-]*):([\w.\-]*)|#[^\n]*(?:\n|$))', re.DOTALL)
UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
SIGNS = {"n": "\n", "r": "\r", "t": "\t"}
STATEMENT = "s string, p string, o string, o_kind string, o_type string, key string, value string, value_type string, error string"


def statement(text: str, prefixes: dict[str, str]) -> list[tuple]:
    """Rows of one statement: triples, or annotations of a quoted one (key and value); an error row if it cannot be read."""
    terms, at = [], 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            return [(None,) * 8 + (f"not understood: {text[at : at + 60]!r}",)]
        at = m.end()
        sign, iri, quoted, type_iri, type_prefix, type_local, truth, whole, number, kind, prefix, local = m.groups()
        if sign:
            terms.append((sign, None, None))
        elif iri is not None:
            terms.append((iri, "iri", None))
        elif quoted is not None:
            own = type_iri if type_iri is not None else prefixes.get(type_prefix, type_prefix + ":") + type_local if type_prefix else XSD + "string"
            terms.append((UNESCAPE.sub(lambda e: SIGNS.get(e[1], e[1]), quoted), "literal", own))
        elif truth or whole or number:
            terms.append((truth or whole or number, "literal", XSD + ("boolean" if truth else "integer" if whole else "decimal")))
        elif kind:
            terms.append((RDF_TYPE, "iri", None))
        elif prefix is not None:
            if prefix not in prefixes:
                return [(None,) * 8 + (f"no prefix {prefix!r}",)]
            terms.append((prefixes[prefix] + local, "iri", None))
    if not terms:
        return []
    subject: tuple = ()
    if terms[0][0] == "<<" and terms[0][1] is None:
        if len(terms) < 5 or terms[4][:2] != (">>", None):
            return [(None,) * 8 + ("a quoted triple is not closed",)]
        subject, terms = tuple(t[0] for t in terms[1:4]), terms[5:]
    else:
        subject, terms = (terms[0][0],), terms[1:]
    out, predicate, i = [], None, 0
    while i < len(terms):
        if terms[i][1] is None:
            predicate = None if terms[i][0] == ";" else predicate
            i += 1
        elif predicate is None:
            predicate, i = terms[i][0], i + 1
        else:
            value, kind, own = terms[i]
            out.append((*subject, None, None, predicate, value, own, None) if len(subject) == 3 else (*subject, predicate, value, kind, own, None, None, None, None))
            i += 1
    return out


def read_turtle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(triples (s, p, o, o_kind, o_type), annotations (s, p, o, key, value, value_type), errors (error)) of Turtle files.

    A statement ends with a dot at the end of a line, which splits a file among tasks; a string has no line end but an
    escaped one.  Prefixes hold for all files.  Statements that cannot be read are errors, the others count.
    """
    text = spark.read.text(path, lineSep=".\n").where(F.trim("value") != "")
    head = r"^\s*@?(?i:prefix)\s+([\w\-]*):\s*<([^>]*)>\s*\.?\s*$"
    prefixes = {r[0]: r[1] for r in text.where(F.regexp_like("value", F.lit(head))).select(F.regexp_extract("value", head, 1), F.regexp_extract("value", head, 2)).distinct().collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in STATEMENT.split(", ")]
        for batch in batches:
            rows = [r for value in batch.column("value").to_pylist() for r in statement(re.sub(r"\.\s*\Z", "", value), prefixes)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))], names)

    own = text.where(~F.regexp_like("value", F.lit(head)))
    rows = own.mapInArrow(run, STATEMENT)
    plain = own.where(~F.regexp_like("value", F.lit(r"^\s*<<"))).mapInArrow(run, STATEMENT)  # (a quoted triple gives none)
    triples = plain.where("error is null and key is null").select("s", "p", "o", "o_kind", "o_type").distinct()
    notes = rows.where("key is not null").select("s", "p", "o", "key", "value", "value_type").distinct()
    return triples, notes, rows.where("error is not null").select("error")
