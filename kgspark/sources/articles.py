"""Article XML, abstract files, and the texts of a literature corpus."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import LINE_END, file_name

DECLARED = re.compile(r"^\s*<\?xml[^>]*\?>")  # (a text is read already, whatever encoding it says)
ROWS = 1000  # articles that a task hands on at once


def flat(element: ET.Element | None) -> str:
    """An element's pieces of text, those within tags too, trimmed and joined by a blank."""
    return " ".join(t.strip() for t in element.itertext() if t.strip()) if element is not None else ""


def article(element: ET.Element) -> tuple[str, str, str] | None:
    """(pmid, title, abstract) of an article with an abstract and a number; a record may lack the elements around these."""
    first = lambda *paths: next((e for p in paths if (e := element.find(p)) is not None), None)
    pmid = first(".//MedlineCitation/PMID", "PMID")
    abstract = " ".join(filter(None, map(flat, element.iterfind(".//Abstract/AbstractText"))))
    if pmid is None or not abstract:
        return None
    return pmid.text or "", flat(first(".//Article/ArticleTitle", "ArticleTitle")), abstract


def scanned(xml: DataFrame, column: str = "value") -> DataFrame:
    """(pmid, title, abstract, error): the articles of XML texts, and a row with an error for a text that is not well-formed.

    A text is parsed as a stream, an article at a time.  Of a text with an error the articles before it are
    no result; null and blank texts have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["pmid", "title", "abstract", "error"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                rows: list[tuple] = []
                if not (text or "").strip():
                    continue
                try:
                    for _, element in ET.iterparse(io.BytesIO(DECLARED.sub("", text).encode()), ("end",)):
                        if element.tag == "PubmedArticle":
                            if (own := article(element)) is not None:
                                rows.append((*own, None))
                            element.clear()
                except ET.ParseError as fault:
                    rows = [(None, None, None, str(fault))]
                for i in range(0, len(rows), ROWS):
                    yield made(rows[i : i + ROWS])

    return xml.select(F.col(column).cast("string").alias("value")).mapInArrow(run, "pmid string, title string, abstract string, error string")


def parse_articles(xml: DataFrame, column: str = "value") -> DataFrame:
    """(pmid, title, abstract) of XML texts; articles without an abstract or a number go, and texts that are not well-formed."""
    return scanned(xml, column).where("error is null").drop("error")


def faults(xml: DataFrame, column: str = "value") -> DataFrame:
    """(error) of each text that is not well-formed."""
    return scanned(xml, column).where("error is not null").select("error")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    return parse_articles(spark.read.text(path, wholetext=True))


def render(records: DataFrame) -> DataFrame:
    """(entity, file, text): one abstract file for each entity of (entity, label, kind, pmid, title, abstract)."""
    body = F.concat(F.lit("# pmid: "), "pmid", F.lit("\n# title: "), "title", F.lit("\n"), "abstract", F.lit("\n"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pmid", body.alias("b")))), lambda x: x["b"]), "\n")
    head = F.concat(F.lit("# entity: "), "entity", F.lit("\t"), "label", F.lit("\t("), "kind", F.lit(")\n\n"))
    return records.groupBy("entity", "label", "kind").agg(parts.alias("p")).select("entity", F.concat(file_name(F.col("entity")), F.lit(".txt")).alias("file"), F.concat(head, "p").alias("text"))


def parse(files: DataFrame, column: str = "text") -> DataFrame:
    """The records of abstract files; a missing header leaves entity, label and kind empty; body lines are joined by a blank."""
    lines = F.split(column, LINE_END)
    head = F.when(F.startswith(lines[0], F.lit("# entity:")), F.split(F.trim(F.regexp_replace(lines[0], "^# entity:", "")), "\t")).otherwise(F.array().cast("array<string>"))
    part = lambda i: F.coalesce(F.get(F.col("head"), F.lit(i)), F.lit(""))
    rows = files.select(head.alias("head"), F.slice(F.split(F.concat(F.lit("\n"), column), r"\n# pmid:"), 2, 1_000_000).alias("records"))
    rows = rows.select(part(0).alias("entity"), part(1).alias("label"), F.trim(part(2), F.lit("()")).alias("kind"), F.explode("records").alias("r"))
    own = F.split("r", LINE_END)
    rest = F.slice(own, 2, 1_000_000)
    titled = F.filter(rest, lambda s: F.startswith(s, F.lit("# title:")))
    body = F.filter(F.transform(F.filter(rest, lambda s: ~F.startswith(s, F.lit("# title:"))), lambda s: F.trim(s)), lambda s: s != "")
    return rows.select("entity", "label", "kind", F.trim(own[0]).alias("pmid"), F.coalesce(F.trim(F.regexp_replace(F.get(titled, F.size(titled) - 1), "^# title:", "")), F.lit("")).alias("title"), F.array_join(body, " ").alias("abstract"))


def fetch_summary(results: DataFrame) -> DataFrame:
    """How many entities a fetch skipped, found nothing for, failed on, or got."""
    return results.groupBy("status").agg(F.count("*").alias("n"))
