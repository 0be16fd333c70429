"""Queries that a model wrote, a table of them at a time: one plan for each shape.

Texts are taken out of their fences, parsed and bounded where they are.  The
constants of a query's patterns are lifted out of it, and what is left is its
shape; all questions of a shape are answered by one plan, in which constants are
columns of a seed table.  The driver sees a text of each shape, not of each
question.  A text that is no acceptable query is a miss, never an error.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.algebra import InvalidQuery, Iri, Lit, Query, Step, Triple, Values, Var, aggregates
from ..plans.compiler import Compiler
from ..plans.sparql import parse
from ..sources import scratch
from ..sources.graph import TYPE, Graph

ROWS = 200  # of a written query
FENCE = re.compile(r"```(?:\w+)?[ \t]*\n?(.*?)(?:```|\Z)", re.DOTALL)
QUESTION = "_q"


def extract_query(answer: str) -> str:
    """The text of the first fence (closed or not), or the whole answer."""
    found = FENCE.search(answer or "")
    return (found[1] if found else answer or "").strip()


def bounded(query: Query, rows: int = ROWS) -> Query:
    """Ordered by what it selects and limited, unless it has a limit or counts."""
    if not query.ask and query.limit is None and not any(aggregates(e) for _, e in query.projection):
        query.order_by = query.order_by or [(Var(n), False) for n, _ in query.projection]
        query.limit = rows
    return query


def serialised(rows: DataFrame, names: list[str] | None = None, *keep: str) -> DataFrame:
    """(line, sources) of result rows: 'name=value | ...' of bound values, and their IRIs sorted."""
    names = names if names is not None else rows.columns
    parts: list[Column] = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in names]
    values = F.array_compact(F.array(*[F.col(c).cast("string") for c in names]))
    return rows.select(*keep, F.concat_ws(" | ", *parts).alias("line"), F.array_sort(F.array_distinct(F.filter(values, lambda v: F.regexp_like(v, F.lit("^https?://"))))).alias("sources"))


def lifted(query: Query) -> tuple[Query, list[tuple[str, str, str]]]:
    """The query without the constants of its outermost patterns, and these: (variable, value, kind).

    A seed of one row becomes its variables; constants within OPTIONAL, MINUS and other groups stay, and so do classes.
    """
    query = copy.deepcopy(query)
    if not query.ask and not query.projection:
        query.projection = [(n, None) for n in sorted(Compiler(None)._visible(query.where))]
    seen = [n for i in query.where.items if isinstance(i, Values) for n in i.names]
    constants: list[tuple[str, str, str]] = []

    def column(term, name: str | None = None):
        if not isinstance(term, (Iri, Lit)):
            return term
        constants.append((name or f"_c{len(constants)}", term.value, "iri" if isinstance(term, Iri) else "literal"))
        return Var(constants[-1][0])

    items: list = []
    for item in query.where.items:
        if isinstance(item, Triple):
            classes = item.path[-1] == Step(Iri(TYPE))
            items.append(Triple(column(item.s), item.path, item.o if classes else column(item.o)))
        elif isinstance(item, Values) and len(item.rows) == 1 and all(isinstance(v, (Iri, Lit)) and seen.count(n) == 1 for n, v in zip(item.names, item.rows[0], strict=True)):
            for n, v in zip(item.names, item.rows[0], strict=True):
                column(v, n)
        else:
            items.append(item)
    query.where.items = items
    return query, constants


def parsed(answers: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """(question_id, query, shape, constants); shape is null for a miss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, shapes, constants = [], [], []
            for answer in batch.column("answer").to_pylist():
                texts.append(extract_query(answer or ""))
                try:
                    query, own = lifted(bounded(parse(texts[-1], prefixes)))
                    shapes.append(f"{query} {[(n, k) for n, _, k in own]}")
                    constants.append([v for _, v, _ in own])
                except (InvalidQuery, RecursionError):
                    shapes.append(None)
                    constants.append([])
            yield pa.RecordBatch.from_arrays([batch.column("question_id"), pa.array(texts, pa.string()), pa.array(shapes, pa.string()), pa.array(constants, pa.list_(pa.string()))], ["question_id", "query", "shape", "constants"])

    own = answers.select(F.col("question_id").cast("string").alias("question_id"), F.col("answer").cast("string").alias("answer"))
    return own.mapInArrow(run, "question_id string, query string, shape string, constants array<string>")


class Batch(Compiler):
    """Answers all questions of a shape: QUESTION is a column of every solution, and bounds hold for each question."""

    def __init__(self, graph: Graph, seeds: DataFrame, kinds: dict[str, str]):
        super().__init__(graph, seeds, kinds)
        self.per = QUESTION

    def answer(self, query: Query) -> tuple[DataFrame, list[str]]:
        """(rows with QUESTION, names of the result's columns)."""
        query.where.items = [Values(tuple(self.seeds.columns), []), *query.where.items]
        asked = self.seeds.select(QUESTION)
        if query.ask:
            some = self.group(query.where, {QUESTION}, True).df.select(QUESTION).distinct().withColumn("_found", F.lit(True))
            return asked.join(some, QUESTION, "left").select(QUESTION, F.coalesce("_found", F.lit(False)).cast("string").alias("boolean")), ["boolean"]
        names = [n for n, _ in query.projection]
        whole = not query.group_by and any(aggregates(e) for _, e in query.projection)
        if query.group_by or whole:
            query.group_by = [QUESTION, *query.group_by]
        query.projection = [(QUESTION, None), *query.projection]
        rows = self.run(query)
        if whole and query.having is None:  # a count of nothing is 0
            zero = [n for n, e in query.projection if isinstance(e, tuple) and e[:2] == ("agg", "COUNT")]
            rows = asked.join(rows, QUESTION, "left").withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in zero})
        return rows, names

    def _ordered(self, query: Query, found) -> DataFrame:
        """The first rows of each question."""
        if query.limit is None and not query.offset:
            return found.df
        keys = [key for expression, down in query.order_by for key in self.order_keys(found, expression, down)]
        nth = F.row_number().over(Window.partitionBy(QUESTION).orderBy(*keys, *found.df.columns))
        upto = F.lit(True) if query.limit is None else F.col("_nth") <= query.limit + query.offset
        return found.df.withColumn("_nth", nth).where((F.col("_nth") > query.offset) & upto).drop("_nth")


def of_shape(graph: Graph, table: DataFrame, shape: str, text: str) -> DataFrame | None:
    """(question_id, line, sources) of all questions of a shape; None if the compiler refuses it."""
    query, constants = lifted(bounded(parse(text, graph.prefixes)))
    names = [n for n, _, _ in constants]
    seeds = table.where(F.col("shape") == shape).select(F.col("question_id").alias(QUESTION), *[F.col("constants")[i].alias(n) for i, n in enumerate(names)])
    try:
        if constants:
            rows, columns = Batch(graph, seeds, {QUESTION: "literal"} | {n: k for n, _, k in constants}).answer(query)
        else:  # the same for all of them
            rows = Compiler(graph).run(query)
            columns = rows.columns
            rows = seeds.crossJoin(rows)
    except InvalidQuery:
        return None
    return serialised(rows, columns, QUESTION).withColumnRenamed(QUESTION, "question_id")


def answered(graph: Graph, answers: DataFrame) -> tuple[DataFrame, int]:
    """((question_id, query, miss, context, sources), number of plans) of answers (question_id, answer); ids are distinct."""
    spark = graph.spark
    path = scratch.new_folder(spark, "written")
    table = parsed(answers, graph.prefixes)
    table.write.parquet(path)
    table = spark.read.schema(table.schema).parquet(path)
    shapes = table.where("shape is not null").groupBy("shape").agg(F.min("query").alias("query")).orderBy("shape").collect()  # a row for each shape
    plans = [(s.shape, rows) for s in shapes if (rows := of_shape(graph, table, s.shape, s.query)) is not None]
    good = spark.createDataFrame([(s,) for s, _ in plans], "shape string")
    none = F.array().cast("array<string>")
    own = table.join(F.broadcast(good), "shape", "left_anti").select("question_id", "query", F.lit(True).alias("miss"), none.alias("lines"), none.alias("sources"))
    for shape, rows in plans:  # lines meet where their shape's plan has put each question, and are not sent again
        lines = rows.groupBy("question_id").agg(F.array_sort(F.collect_list("line")).alias("lines"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
        asked = table.where(F.col("shape") == shape).select("question_id", "query", F.lit(False).alias("miss"))
        own = own.unionByName(asked.join(lines, "question_id", "left"))
    return own.select("question_id", "query", "miss", F.coalesce(F.array_join("lines", "\n"), F.lit("")).alias("context"), F.coalesce("sources", none).alias("sources")), len(plans)
