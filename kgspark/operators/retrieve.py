"""Batch retrievers: questions (question_id, question) to (question_id, context, sources, ...).

``closed_book``, ``neighborhood`` (entity linking, capped expansion), ``similar``
(vectors of the questions against those of passages) and ``written`` (queries
that a model wrote for the questions, gated and bounded).  What a model makes,
vectors and written queries, is an input table.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import count_tokens, normalize
from ..functions.vector import context_block, nearest
from ..plans.algebra import InvalidQuery
from ..plans.compiler import Compiler
from ..plans.sparql import parse
from ..sources.graph import LABEL, PREDICATE, Graph
from .adjacency import FETCH, Adjacency, around, capped, kept  # noqa: F401
from .matching import short_matches
from .written import ROWS, answered, bounded, extract_query, serialised  # noqa: F401

LONGEST = 10  # words of a linked label at most


def result(rows: DataFrame) -> DataFrame:
    """Adds the proxy token count and the name of its tokenizer."""
    return rows.withColumns({"context_tokens": count_tokens(F.col("context")), "context_tokenizer": F.lit("wordpunct-v1")})


def closed_book(questions: DataFrame) -> DataFrame:
    return result(questions.select("question_id", F.lit("").alias("context"), F.array().cast("array<string>").alias("sources")))


def gazetteer(graph: Graph) -> DataFrame:
    """(name, iri, label, words): of several entities with one normalised label the least IRI."""
    rows = graph.scan(LABEL).select(normalize(F.col("o")).alias("name"), F.col("s").alias("iri"), F.col("o").alias("label")).where("name <> ''")
    return rows.groupBy("name").agg(F.min(F.struct("iri", "label")).alias("m")).select("name", "m.iri", "m.label", F.size(F.split("name", " ")).alias("words"))


def link(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(question_id, iri, label): greedy longest match from left to right, a match's words used up, entities once."""
    known = names.where(F.col("words") <= LONGEST).select("name", "iri", "label")
    return short_matches(questions.select("question_id", "question"), known, "question", "name", LONGEST).select("question_id", "iri", "label").distinct()


def hop(graph: Graph, frontier: DataFrame, fetch: int | None = FETCH) -> DataFrame:
    """(question_id, s, p, o, other, outgoing) around a frontier (question_id, iri): edges out and in, each direction's first ``fetch``, or all if that is None."""
    triples = graph.scan().where(F.startswith("p", F.lit(PREDICATE)))
    order = Window.partitionBy("question_id").orderBy("s", "p", "o")
    parts = []
    for own, other, outgoing in (("s", "o", True), ("o", "s", False)):
        found = triples.join(frontier.withColumnRenamed("iri", own), own)
        if not outgoing:
            found = found.where("o_kind = 'iri'")
        if fetch is not None:
            found = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= fetch)
        parts.append(found.select("question_id", "s", "p", "o", F.when((F.col("o_kind") == "iri"), F.col(other)).alias("other"), F.lit(outgoing).alias("outgoing")))
    return parts[0].unionByName(parts[1])


def neighborhood(graph: Graph, questions: DataFrame, hops: int = 1, adjacency: Adjacency | None = None) -> DataFrame:
    """Context of ``hops`` expansions from linked entities, capped by predicate and in all; stored runs serve many calls."""
    anchors = link(questions, gazetteer(graph))
    made = lambda rows, by: rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" ", "s_name", "p_name", "o_name").alias("line")))), lambda x: x["line"]), "\n").alias("context"), F.collect_set("other").alias("others"), F.count("*").alias("num_triples")).select("question_id", "context", "others", "num_triples")
    lines = functools.reduce(DataFrame.unionByName, [made(*part) for part in kept(graph, anchors, hops, adjacency)])
    starts = anchors.groupBy("question_id").agg(F.collect_set("iri").alias("iris"), F.count("*").alias("num_linked"))
    own = questions.select("question_id").join(starts, "question_id", "left").join(lines, "question_id", "left")
    none = F.array().cast("array<string>")
    return result(own.select("question_id", F.coalesce("context", F.lit("")).alias("context"), F.array_sort(F.array_union(F.coalesce("iris", none), F.coalesce("others", none))).alias("sources"), F.coalesce("num_linked", F.lit(0)).alias("num_linked"), F.coalesce("num_triples", F.lit(0)).alias("num_triples")))


def query_text(graph: Graph, answer: str) -> DataFrame | None:
    """Rows of a written query, bounded; None (a miss) if there is no acceptable query."""
    try:
        return Compiler(graph).run(bounded(parse(extract_query(answer), graph.prefixes)))
    except InvalidQuery:
        return None


def similar(questions: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest passages: vectors (id, embedding, label, entity, pmid, document), queries (question_id, query); sources are ids by rank."""
    asked = queries.join(questions.select("question_id"), "question_id", "left_semi").withColumnRenamed("question_id", "query_id")
    found = nearest(vectors, asked, k).join(vectors.drop("embedding"), "id")
    ids = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id")))).alias("r"))
    own = context_block(found).join(ids, "query_id").select(F.col("query_id").alias("question_id"), "context", F.col("r.id").alias("sources"), "distances")
    none = F.array().cast("array<string>")
    own = questions.select("question_id").join(own, "question_id", "left")
    return result(own.withColumns({"context": F.coalesce("context", F.lit("")), "sources": F.coalesce("sources", none)}))


def written(graph: Graph, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows of each question's written query: answers (question_id, answer); ``miss`` says that there was no acceptable query.

    There is a plan for each shape of query, however many questions have it.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    own = questions.select(text("question_id")).join(answers.select(text("question_id"), "answer"), "question_id", "left")
    return result(answered(graph, own)[0])


REGISTRY = {
    "closed_book": lambda graph, questions: closed_book(questions),
    "vector": lambda graph, questions, vectors, queries, k=5: similar(questions, vectors, queries, k),
    "graph_neighborhood_1hop": lambda graph, questions: neighborhood(graph, questions, 1),
    "graph_neighborhood_2hop": lambda graph, questions: neighborhood(graph, questions, 2),
    "graph_sparqlgen": written,
}


def retrieve(name: str, graph: Graph, questions: DataFrame, **inputs) -> DataFrame:
    """Retrieval by name; ``vector`` takes vectors and queries, ``graph_sparqlgen`` answers."""
    if name not in REGISTRY:
        raise KeyError(f"no retriever {name!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](graph, questions, **inputs)
