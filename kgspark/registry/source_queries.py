"""Queries of source and sink operators over the order tables, documents and events; and of the streaming extras."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vector import norm
from ..operators import harness
from ..plans.compiler import execute
from ..sources import articles, graph, json_array, rdf, runs, scratch, vectors
from ..streaming import runs as streams
from . import query
from .graph_sql import sql

NAMES = rdf.Names(
    prefixes={"kg": graph.PREDICATE, "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": "http://www.w3.org/2001/XMLSchema#", "cust": graph.BASE + "Customer/", "ord": graph.BASE + "Order/", "part": graph.BASE + "Part/"},
    kinds={"Customer": ("cust", True), "Order": ("ord", False), "Part": ("part", False)},
    attributes={"Customer": ("segment",)},
)


def property_graph(spark, sf_dir):
    """Customers, orders and parts as the nodes and edges of a property graph."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    customers = read("customer").select(F.lit("Customer").alias("kind"), F.concat(F.lit("C:"), "c_custkey").alias("identifier"), F.concat("c_name", F.lit(' "x"\\')).alias("name"), F.to_json(F.struct(F.col("c_mktsegment").alias("segment"))).alias("data"), F.col("c_custkey").alias("pos"))
    parts = read("part").select(F.lit("Part"), F.concat(F.lit("p("), "p_partkey", F.lit(")")), "p_name", F.lit(None).cast("string"), F.col("p_partkey") + 10**9)
    orders = read("orders").select(F.lit("Order"), F.col("o_orderkey").cast("string"), F.concat(F.lit("Order#"), "o_orderkey"), F.lit(None).cast("string"), F.col("o_orderkey") + 2 * 10**9)
    edges = read("orders").select(F.col("o_orderkey").alias("pos"), F.array(F.lit("Customer"), F.concat(F.lit("C:"), "o_custkey")).alias("source_id"), F.array(F.lit("Order"), F.col("o_orderkey").cast("string")).alias("target_id"), F.lit("places").alias("kind"), F.lit("both").alias("direction"), F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.array(F.lit("X"), "o_orderpriority").alias("sources"), (F.col("o_custkey") % 2 == 0).alias("even"), F.col("o_custkey").alias("n"), F.lit(0.5).alias("half"))).alias("data"))
    return customers.union(parts).union(orders), edges


@query("src03_slice", """WITH e AS (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100)
SELECT DISTINCT 'Customer' AS kind, 'C:' || o_custkey AS identifier FROM e UNION ALL SELECT 'Order', '' || o_orderkey FROM e""")
def src03(spark, sf_dir):
    return rdf.slice_edges(*property_graph(spark, sf_dir), 100)[0].select("kind", "identifier")


@query("src04_turtle_nodes", f"""SELECT 'cust:' || c_custkey || ' a kg:Customer ;' || chr(10) || '    rdfs:label "' || replace(replace(c_name || ' "x"\\', '\\', '\\\\'), '"', '\\"') || '" ;' || chr(10) || '    kg:segment "' || c_mktsegment || '" .' AS line FROM customer
UNION ALL SELECT '<{graph.BASE}Part/p(' || p_partkey || ')> a kg:Part ;' || chr(10) || '    rdfs:label "' || p_name || '" .' FROM part
UNION ALL SELECT 'ord:' || o_orderkey || ' a kg:Order ;' || chr(10) || '    rdfs:label "Order#' || o_orderkey || '" .' FROM orders""")
def src04(spark, sf_dir):
    return rdf.node_lines(property_graph(spark, sf_dir)[0], NAMES).select("line")


EDGE = "'cust:' || o_custkey || ' kg:places ord:' || o_orderkey"


@query("src04_turtle_edges", f"""SELECT {EDGE} || ' .' || chr(10) || '<< ' || {EDGE} || ' >> kg:direction "both" ;' || chr(10) || '    kg:status "' || o_orderstatus || '" ;' || chr(10) || '    kg:sources "X" ;' || chr(10) || '    kg:sources "' || o_orderpriority || '" ;' || chr(10) || '    kg:even ' || CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END || ' ;' || chr(10) || '    kg:n ' || o_custkey || ' ;' || chr(10) || '    kg:half "0.5"^^xsd:double .' AS line FROM orders""")
def src04_edges(spark, sf_dir):
    return rdf.edge_lines(property_graph(spark, sf_dir)[1], NAMES).select("line")


def abstracts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    body = F.trim(F.regexp_replace("text", r"\s+", " "))
    return docs.select(F.concat(F.lit("n:"), "source").alias("entity"), F.upper("source").alias("label"), F.lit("Gene").alias("kind"), F.col("doc_id").cast("string").alias("pmid"), F.concat(F.lit("T "), "lang").alias("title"), body.alias("abstract")).where("abstract <> ''")


@query("src08_abstract_files", r"""SELECT 'n_' || source || '.txt' AS file, count(*) AS n FROM documents WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> '' GROUP BY 1""")
def src08(spark, sf_dir):
    files = articles.render(abstracts(spark, sf_dir))
    return files.select("file", (F.size(F.split("text", r"(?m)^# pmid:")) - 1).cast("long").alias("n"))


@query("src07_abstract_records", r"""SELECT 'n:' || source AS entity, upper(source) AS label, 'Gene' AS kind, '' || doc_id AS pmid, 'T ' || lang AS title, trim(regexp_replace(text, '\s+', ' ', 'g')) AS abstract FROM documents WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''""")
def src07(spark, sf_dir):
    return articles.parse(articles.render(abstracts(spark, sf_dir)))


@query("src09_articles", r"""SELECT '' || doc_id AS pmid, 'A & title α β ' || lang AS title, 'one < ' || source || ' two H 2 O' AS abstract FROM documents WHERE doc_id % 3 > 0""")
def src09(spark, sf_dir):
    """Articles with nested tags, comments, character references and unparsed sections."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    body = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit('<Abstract><AbstractText Label="x"><![CDATA[one < ]]>'), "source", F.lit("<!-- no text --></AbstractText><AbstractText/><AbstractText>two H<sub>2</sub>O</AbstractText></Abstract>"))).otherwise("")
    xml = docs.select(F.concat(F.lit('<?xml version="1.0" encoding="ISO-8859-1"?><PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">'), "doc_id", F.lit("</PMID><Article><ArticleTitle>A &amp; <i>title</i> &#945; <b>&#x3b2;</b> "), "lang", F.lit("</ArticleTitle>"), body, F.lit("</Article></MedlineCitation></PubmedArticle></PubmedArticleSet>")).alias("value"))
    return articles.parse_articles(xml)


@query("src10_fetch_summary", "SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def src10(spark, sf_dir):
    return articles.fetch_summary(spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("event_type", "status"))


@query("src15_full_runs", "SELECT user_id AS run_id, event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) = (SELECT max(n) FROM (SELECT count(*) AS n FROM events GROUP BY user_id)))")
def src15(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("run_id"), "event_id")
    most = events.groupBy("run_id").count().agg(F.max("count")).first()[0]
    return runs.full_runs(events, most or 0)


def stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


@query("src12_append_sink", "SELECT event_id, event_type, CAST(epoch_us(ts) AS BIGINT) AS ts, value FROM events")
def src12(spark, sf_dir):
    """Events through the append sink, and read back."""
    own = stream(spark, sf_dir).select("event_id", "event_type", F.unix_micros("ts").alias("ts"), "value")
    return streams.run_to_end(own, "src12", "append")


@query("st01_windows", "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def st01(spark, sf_dir):
    out = streams.run_to_end(streams.windows(stream(spark, sf_dir)), f"st01_{abs(hash(sf_dir))}")
    return out.withColumn("start", F.col("start").cast("long"))


@query("st02_latest", "SELECT event_type, user_id, max(ts) AS ts FROM events GROUP BY 1, 2".replace("max(ts) AS ts", "CAST(epoch_us(max(ts)) AS BIGINT) AS ts"))
def st02(spark, sf_dir):
    out = streams.run_to_end(streams.latest(stream(spark, sf_dir), ["event_type", "user_id"]), f"st02_{abs(hash(sf_dir))}")
    return out.select("event_type", "user_id", F.unix_micros("ts").alias("ts"))


@query("st03_once", "SELECT count(*) AS n FROM events")
def st03(spark, sf_dir):
    return streams.run_to_end(streams.once(stream(spark, sf_dir)), f"st03_{abs(hash(sf_dir))}", "append").agg(F.count("*").alias("n"))


def scanned_graph(spark, sf_dir):
    path = scratch.new_folder(spark, "arrays")
    for key, rows in zip(("nodes", "edges"), property_graph(spark, sf_dir)):
        json_array.write(rows.drop("pos"), key, path)
    return rdf.read_graph(spark, path)


@query("src01_json_nodes", "SELECT 'Customer' AS kind, 'C:' || c_custkey AS identifier, c_name || ' \"x\"\\' AS name FROM customer UNION ALL SELECT 'Part', 'p(' || p_partkey || ')', p_name FROM part UNION ALL SELECT 'Order', '' || o_orderkey, 'Order#' || o_orderkey FROM orders")
def src01(spark, sf_dir):
    """Nodes and edges written as arrays of JSON objects, and the nodes scanned again."""
    return scanned_graph(spark, sf_dir)[0].select("kind", "identifier", "name")


@query("src02_json_edges", "SELECT 'C:' || o_custkey AS s, '' || o_orderkey AS o, 'places' AS kind FROM orders")
def src02(spark, sf_dir):
    return scanned_graph(spark, sf_dir)[1].select(F.col("source_id")[1].alias("s"), F.col("target_id")[1].alias("o"), "kind")


@query("src05_turtle_entities", "SELECT 'cust:' || c_custkey AS term, 'Customer' AS kind, c_name || ' \"x\"\\' AS label FROM customer UNION ALL SELECT '<" + graph.BASE + "Part/p(' || p_partkey || ')>', 'Part', p_name FROM part UNION ALL SELECT 'ord:' || o_orderkey, 'Order', 'Order#' || o_orderkey FROM orders")
def src05(spark, sf_dir):
    """The Turtle of the graph written and its entities read back."""
    path = scratch.new_folder(spark, "turtle")
    rdf.write_turtle(*property_graph(spark, sf_dir), NAMES, path)
    return rdf.read_entities(spark, path)


CUSTOMER, PART, ORDER, KG = (f"'{x}' || " for x in (graph.BASE + "Customer/", graph.BASE + "Part/p(", graph.BASE + "Order/", graph.PREDICATE))
NODES_SQL = f"""SELECT {CUSTOMER}c_custkey AS s, 'Customer' AS kind, c_name || ' "x"\\' AS label FROM customer UNION ALL SELECT {PART}p_partkey || ')', 'Part', p_name FROM part UNION ALL SELECT {ORDER}o_orderkey, 'Order', 'Order#' || o_orderkey FROM orders"""


def turtle(spark, sf_dir):
    path = scratch.new_folder(spark, "turtle")
    rdf.write_turtle(*property_graph(spark, sf_dir), NAMES, path)
    return rdf.read_turtle(spark, path)


@query("src05_turtle_triples", f"""WITH n AS ({NODES_SQL}) SELECT s, '{rdf.RDF_TYPE}' AS p, {KG}kind AS o, 'iri' AS o_kind FROM n UNION ALL SELECT s, '{NAMES.prefixes["rdfs"]}label', label, 'literal' FROM n
UNION ALL SELECT {CUSTOMER}c_custkey, {KG}'segment', c_mktsegment, 'literal' FROM customer UNION ALL SELECT {CUSTOMER}o_custkey, {KG}'places', {ORDER}o_orderkey, 'iri' FROM orders""")
def src05_triples(spark, sf_dir):
    """The Turtle of the graph written, and all its triples read back."""
    return turtle(spark, sf_dir)[0].drop("o_type")


@query("src05_turtle_annotations", f"""SELECT {CUSTOMER}o_custkey AS s, {KG}'places' AS p, {ORDER}o_orderkey AS o, {KG}k AS key, v AS value, '{rdf.XSD}' || t AS value_type FROM
(SELECT o_custkey, o_orderkey, unnest(['direction', 'status', 'sources', 'sources', 'even', 'n', 'half']) AS k, unnest(['both', o_orderstatus, 'X', o_orderpriority, CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END, '' || o_custkey, '0.5']) AS v, unnest(['string', 'string', 'string', 'string', 'boolean', 'integer', 'double']) AS t FROM orders)""")
def src05_annotations(spark, sf_dir):
    """The annotations of its edges."""
    return turtle(spark, sf_dir)[1]


@query("src11_jsonl", "SELECT conv_id, turn, role, text FROM conversations")
def src11(spark, sf_dir):
    """Rows written as JSON lines (src12) and read with an explicit schema."""
    path, rows = scratch.new_folder(spark, "rows"), spark.read.parquet(f"{sf_dir}/conversations.parquet")
    runs.write_rows(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("src13_discovered", "SELECT user_id AS question, event_type AS retriever FROM events WHERE event_type IN ('view', 'click')")
def src13(spark, sf_dir):
    """A run file and a manifest for two types of events, and a run file without a manifest."""
    path = scratch.new_folder(spark, "runs")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    move = spark._jvm.org.apache.hadoop.fs.Path
    for kind in ("view", "click", "error"):
        parts = [(events.where(F.col("event_type") == kind).select(F.col("user_id").cast("string").alias("question_id")), "jsonl")]
        if kind != "error":
            parts.append((spark.createDataFrame([(kind, kind, "2026-01-01T00:00:00+0000")], "run_id string, retriever string, timestamp string"), "manifest.json"))
        for df, suffix in parts:
            df.coalesce(1).write.json(f"{path}/tmp-{kind}-{suffix}")
            system = move(path).getFileSystem(spark._jsc.hadoopConfiguration())
            for status in system.globStatus(move(f"{path}/tmp-{kind}-{suffix}/part-*")):
                system.rename(status.getPath(), move(f"{path}/{kind}.{suffix}"))
    rows, manifests = runs.discover(spark, path)
    return rows.join(manifests.select("run_id", F.col("retriever").alias("r")), "run_id").select(F.col("question_id").cast("long").alias("question"), F.col("r").alias("retriever"))


@query("src14_profiles", "SELECT 'b' || c_nationkey AS corpus_build_id, count(*) AS corpus_triples, CAST(NULL AS BIGINT) AS corpus_words FROM customer GROUP BY 1")
def src14(spark, sf_dir):
    path = scratch.new_folder(spark, "profiles")
    counts = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy("c_nationkey").count()
    own = counts.select(F.concat(F.lit("b"), "c_nationkey").alias("corpus_build_id"), F.struct(F.col("count").alias("triples")).alias("graph"))
    own.repartition(F.col("corpus_build_id")).write.option("maxRecordsPerFile", 1).json(path)
    return runs.profiles(spark, path).select("corpus_build_id", "corpus_triples", "corpus_words")


@query("src16_bulk_load", sql("SELECT p, count(*) AS n FROM triples GROUP BY 1", triples=True))
def src16(spark, sf_dir):
    """The graph stored by predicate, loaded again."""
    path = scratch.new_folder(spark, "store")
    graph.from_tables(spark, sf_dir).save(path)
    return graph.Graph.load(spark, path).scan().groupBy("p").agg(F.count("*").alias("n"))


@query("src16_stored_query", sql(f"SELECT DISTINCT b.o AS p FROM places a JOIN contains b ON a.o = b.s WHERE a.s = '{graph.BASE}Customer/1'"))
def src16_query(spark, sf_dir):
    """A query over the stored graph: each pattern reads the partition of its predicate."""
    path = scratch.new_folder(spark, "store")
    graph.from_tables(spark, sf_dir).save(path)
    return execute(graph.Graph.load(spark, path), f"SELECT DISTINCT ?p WHERE {{ <{graph.BASE}Customer/1> kg:places ?o . ?o kg:contains ?p }}")


@query("src17_vector_collection", "SELECT vec_id, label, 1.0 AS length FROM embeddings")
def src17(spark, sf_dir):
    path = scratch.new_folder(spark, "vectors")
    vectors.create(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), path)
    return vectors.load(spark, path).select("vec_id", "label", F.round(norm(F.col("embedding")), 6).alias("length"))


@query("src18_report", """WITH r AS (SELECT '' || doc_id AS q, lpad('' || doc_id % 3, 2, '0') AS t, quality = 1 AS p, CAST(quality AS DOUBLE) AS s FROM labels),
h AS (SELECT * FROM (VALUES (1, '00', '# Run r1'), (1, '01', ''), (1, '02', '| factor | value |'), (1, '03', '| - | - |'), (1, 'key judge', '| judge | quality |'), (1, 'key run_id', '| run_id | r1 |'),
(2, '00', ''), (2, '01', '| question | type | passed | score |'), (2, '02', '| - | - | - | - |'), (4, '00', ''), (4, '01', '| type | passed | judged |'), (4, '02', '| - | - | - |')) AS v(part, key, line))
SELECT * FROM h UNION ALL SELECT 3, q, '| ' || q || ' | ' || t || ' | ' || coalesce('' || p, '') || ' | ' || coalesce('' || s, '') || ' |' FROM r
UNION ALL SELECT 5, t, '| ' || t || ' | ' || count(*) FILTER (p) || ' | ' || count(*) || ' |' FROM r GROUP BY t""")
def src18(spark, sf_dir):
    """The lines of a Markdown report of labelled documents as trial rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = labels.select(F.col("doc_id").cast("string").alias("question_id"), F.lpad(F.col("doc_id") % 3, 2, "0").alias("type_id"), (F.col("quality") == 1).alias("passed"), F.col("quality").cast("double").alias("score"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("judged"), F.lit(1).alias("input_tokens"))
    return harness.report_lines(rows, {"run_id": "r1", "judge": "quality"})


@query("hn04_manifest", "SELECT 'r1' AS run_id, count(*) AS questions, 'v1' AS harness_version FROM labels")
def hn04(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", "question_id")
    return harness.manifest(labels, run_id="r1", harness_version="v1").select("run_id", "questions", "harness_version")


@query("hn07_active_corpus", "SELECT 'b1' AS corpus_build_id")
def hn07(spark, sf_dir):
    profiles = spark.createDataFrame([("b1",), ("b2",)], "corpus_build_id string")
    return harness.active_corpus(profiles, None, "b1")
