"""Many patterns in many texts: automata of pattern shards, through which texts are streamed.

Patterns and texts are normalised, and a pattern matches as a run of whole words
of any length.  The patterns' bytes are summed first: up to SHARD_BYTES are one
automaton, which every executor gets; more are dealt to shards of that size by
hash, and texts go through one after the other.  So what is sent to executors,
and held by the driver, is bounded whatever the tables' sizes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.text import normalize

SHARD_BYTES = 4 << 20  # of patterns in one automaton, which takes some 60 times as much

HEADS = 100_000  # first words of patterns, each with a length, that are sent to all tasks

_held: dict[str, tuple] = {}  # the automaton of the shard at hand, in a Python worker


def automaton(table: pa.Table):
    """Texts of a pattern table, each a run of whole words; a text stands for the numbers of all its rows."""
    import ahocorasick

    numbers: dict[str, list[int]] = {}
    for i, text in enumerate(table.column("text").to_pylist()):
        numbers.setdefault(text, []).append(i)
    own = ahocorasick.Automaton()
    for text, rows in numbers.items():
        own.add_word(f" {text} ", (len(text), rows))
    own.make_automaton()
    return own


def found(own, text: str, longest: bool) -> list[tuple[int, int, list[int]]]:
    """(start, end, pattern rows) of all matches, or of the leftmost longest that don't overlap."""
    hits = [(end - 1 - size, end - 1, rows) for end, (size, rows) in own.iter(f" {text} ")]
    if not longest:
        return hits
    hits.sort(key=lambda h: (h[0], -h[1]))
    kept, free = [], 0
    for h in hits:
        if h[0] >= free:
            kept.append(h)
            free = h[1]
    return kept


def through(texts: DataFrame, patterns: DataFrame, longest: bool) -> DataFrame:
    """texts (row, text) through the automaton of all patterns (text, ...), which are within SHARD_BYTES."""
    table = patterns.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    sent = texts.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    key, more = uuid.uuid4().hex, [c for c in patterns.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _held:
            _held.clear()
            own = pa.ipc.open_stream(sent.value).read_all()
            _held[key] = (own, automaton(own) if own.num_rows else None)
        own, machine = _held[key]
        for batch in batches:
            at, rows, spans = [], [], []
            if machine is not None:
                for i, text in enumerate(batch.column("text").to_pylist()):
                    for start, end, numbers in found(machine, text, longest) if text else ():
                        for n in numbers:
                            at.append(i)
                            rows.append(n)
                            spans.append((start, end))
            named = own.select(more).take(pa.array(rows, pa.int64())).combine_chunks()
            columns = [named.column(c).combine_chunks() if named.num_rows else pa.array([], own.schema.field(c).type) for c in more]
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at, pa.int64())), *columns, pa.array([s for s, _ in spans], pa.int32()), pa.array([e for _, e in spans], pa.int32())], ["row", *more, "start", "stop"])

    schema = StructType([texts.schema["row"], *[patterns.schema[c] for c in more], StructField("start", IntegerType()), StructField("stop", IntegerType())])
    return texts.mapInArrow(run, schema)


def leftmost(out: DataFrame, more: list[str]) -> DataFrame:
    """Of each row's matches (row, ``more``, start, stop) the leftmost longest that do not overlap."""
    hits = out.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("stop")).alias("back"), F.struct(*more).alias("pattern")))).alias("hits"))
    # a match is kept if it begins where the kept ones before it end, or is the same span as the last of them
    fold = F.expr("aggregate(hits, struct(0 as free, -1 as from, cast(array() as array<struct<start:int,back:int,pattern:" + hits.schema["hits"].dataType.elementType["pattern"].dataType.simpleString() + ">>) as kept), (s, h) -> if(h.start >= s.free or (h.start = s.from and -h.back = s.free), struct(-h.back as free, h.start as from, concat(s.kept, array(h)) as kept), s)).kept")
    return hits.select("row", F.inline(fold)).select("row", "pattern.*", "start", (-F.col("back")).alias("stop"))


def short_matches(texts: DataFrame, patterns: DataFrame, text_col: str, pattern_col: str, words: int) -> DataFrame:
    """As ``matches`` with longest, for patterns of at most so many words and start and stop counted in words: a join of runs of words.

    Runs that begin with no pattern's first word, or are as long as none of its patterns, are not made, as long as the
    first words are few; work and shuffle grow with texts and patterns, not with their product.
    """
    kept = [c for c in texts.columns if c != text_col]
    more = [c for c in patterns.columns if c != pattern_col]
    own = patterns.select(normalize(F.col(pattern_col)).alias("text"), *more).where("text <> ''")
    rows = texts.select(F.struct(*kept).alias("row"), F.split(normalize(F.col(text_col)), " ").alias("words"))
    heads = own.select(F.substring_index("text", " ", 1).alias("head"), F.size(F.split("text", " ")).alias("n")).where(F.col("n") <= words).distinct()
    begun = rows.select("row", "words", F.posexplode("words").alias("start", "head"))
    if heads.limit(HEADS + 1).count() <= HEADS:
        begun = begun.join(F.broadcast(heads), "head")
    else:
        begun = begun.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(words))))
    stop = F.col("start") + F.col("n")
    runs = begun.where(stop <= F.size("words")).select("row", "start", stop.alias("stop"), F.array_join(F.slice("words", F.col("start") + 1, F.col("n")), " ").alias("text"))
    out = leftmost(runs.join(own, "text").select("row", *more, "start", "stop"), more)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *more, "start", "stop")


def matches(texts: DataFrame, patterns: DataFrame, text_col: str = "text", pattern_col: str = "text", longest: bool = False) -> DataFrame:
    """texts' other columns, patterns' other columns, start and stop (characters of the normalised text) of each match.

    longest: of each text only the leftmost longest matches that do not overlap.  Empty and null texts and patterns
    match nothing; equal patterns match each for itself; a text is told from others by its other columns.
    """
    kept = [c for c in texts.columns if c != text_col]
    rows = texts.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), normalize(F.col(text_col)).alias("text"))
    own = patterns.select(normalize(F.col(pattern_col)).alias("text"), *[F.col(f"`{c}`") for c in patterns.columns if c != pattern_col]).where("text <> ''")
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-size // SHARD_BYTES))
    if shards == 1:
        out = through(rows, own, longest)
    else:
        shard = F.pmod(F.xxhash64("text"), F.lit(shards))
        out = reduce(DataFrame.unionByName, [through(rows, own.where(shard == i), False) for i in range(shards)])
        if longest:
            out = leftmost(out, [c for c in own.columns if c != "text"])
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *[c for c in out.columns if c != "row"])
