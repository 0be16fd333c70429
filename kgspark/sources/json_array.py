"""Arrays of one large JSON object, read by many tasks.

The file is read as text that ends at ``}``, which Spark splits (bzip2 by its
blocks as well), so every task has a run of bytes without knowing what it
begins in.  A first pass finds what each split does to the state of a reader:
whether it ends within a string or after a backslash, for each state that it
may begin in, and how much deeper.  Composed along the file, this gives the
state in which each split begins; the driver does so from one row a split.  A
second pass cuts each split at the commas and brackets of the second level,
where elements of the object's arrays end; what a split begins and ends with is
joined to its neighbours' ends.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from . import scratch

STEP, QUOTE, BACKSLASH, COMMA = np.zeros(256, np.int8), 0x22, 0x5C, 0x2C
STEP[[0x7B, 0x5B]], STEP[[0x7D, 0x5D]] = 1, -1
KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*([\[{])$', re.DOTALL)
SPLIT = ["file", "begin"]


def bytes_of(column: pa.Array) -> np.ndarray:
    """The texts, each with the brace that ended it."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    out = np.full(len(data) + len(column), 0x7D, np.uint8)
    keep = np.ones(len(out), bool)
    keep[(offsets[1:] - offsets[0]) + np.arange(len(column))] = False
    out[keep] = data
    return out


def scanned(data: np.ndarray, inside: bool, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """(whether each byte is within a string or ends one, depth steps, and the state after the last byte)."""
    if not len(data):
        return np.zeros(0, bool), np.zeros(0, np.int8), inside, escaped
    quote = data == QUOTE
    slash = np.flatnonzero(data == BACKSLASH)
    ends = escaped
    if escaped:
        quote[0] = False
        slash = slash[slash > 0]  # (one that is escaped escapes nothing)
        ends = False
    if len(slash):
        first = np.concatenate(([True], slash[1:] != slash[:-1] + 1))  # of each run of backslashes
        start = np.maximum.accumulate(np.where(first, slash, 0))
        after = slash[(slash - start) % 2 == 0] + 1  # what an unescaped backslash escapes
        ends = bool(after[-1] == len(data))
        quote[after[:-1] if ends else after] = False
    odd = (np.cumsum(quote, dtype=np.uint8) & 1).astype(bool) ^ inside
    within = odd | quote
    return within, STEP[data] * ~within, bool(odd[-1]), ends


def by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """Runs of a batch's texts that are of one split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        begin = batch.column("begin").to_numpy()
        file = batch.column("file").dictionary_encode()
        code = file.indices.to_numpy()
        cut = [0, *(np.flatnonzero((begin[1:] != begin[:-1]) | (code[1:] != code[:-1])) + 1).tolist(), len(begin)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield (file.dictionary[int(code[a])].as_py(), int(begin[a])), batch.column("value").slice(a, b - a)


STATES = [(False, False), (True, False), (True, True)]
EFFECT = "file string, begin long, " + ", ".join(f"in{i} boolean, esc{i} boolean, deeper{i} long" for i in range(3))


def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split and each state that it may begin in: the state at its end, and how much deeper it ends."""
    names = [c.split()[0] for c in EFFECT.split(", ")]
    key, now, deeper = None, list(STATES), [0, 0, 0]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(names, [*key, *(v for (a, b), d in zip(now, deeper, strict=True) for v in (a, b, d))], strict=True))], pa.schema([("file", pa.string()), ("begin", pa.int64()), *[f for i in range(3) for f in ((f"in{i}", pa.bool_()), (f"esc{i}", pa.bool_()), (f"deeper{i}", pa.int64()))]]))

    for own, texts in by_split(batches):
        if own != key:
            if key is not None:
                yield row()
            key, now, deeper = own, list(STATES), [0, 0, 0]
        data = bytes_of(texts)
        done = {}  # (states that have met stay together)
        for state in set(now):
            _, step, a, b = scanned(data, *state)
            done[state] = (a, b), int(step.sum(dtype=np.int64))
        for i, state in enumerate(now):
            now[i], deeper[i] = done[state][0], deeper[i] + done[state][1]
    if key is not None:
        yield row()


SEGMENT = "file string, begin long, seg long, place string, section string, nth long, text string"
BLANK = " \t\r\n"


def cutter(entry: dict[tuple[str, int], tuple[bool, bool, int]]):
    """Cuts splits into segments: ``head`` and ``tail`` are incomplete, ``through`` is a split without a cut, ``end`` says in
    which section a split ends, ``count`` how many whole elements of a section it has, which nth numbers; what is empty has
    none, and what is incomplete has 0 or 1 for whether it is not.  A section is the key of an array; '' is what is no array, null what began before the split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        key, inside, escaped, depth, held, seg, section = None, False, False, 0, b"", 0, None
        counts: dict[str | None, int] = {}

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], [c.split()[0] for c in SEGMENT.split(", ")])
            rows.clear()
            return out

        def ended() -> None:
            rows.append((*key, seg, "tail" if seg else "through", section, int(bool(held.strip(BLANK.encode()))), held.decode()))
            rows.append((*key, seg, "end", section, None, None))
            rows.extend((*key, seg, "count", name, n, None) for name, n in counts.items())

        for own, texts in by_split(batches):
            if own != key:
                if key is not None:
                    ended()
                key, held, seg, section, counts = own, b"", 0, None, {}
                inside, escaped, depth = entry[own]
                if depth < 2:
                    section = ""
            data = bytes_of(texts)
            within, step, inside, escaped = scanned(data, inside, escaped)
            level = depth + np.cumsum(step, dtype=np.int64)
            depth = int(level[-1])
            opens, closes = (step > 0) & (level == 2), (step < 0) & (level == 1)
            cuts = np.flatnonzero(opens | closes | ((data == COMMA) & ~within & (level == 2)))
            raw, at = data.tobytes(), 0
            for c in cuts.tolist():
                text = held + raw[at:c]
                whole, nth = text.decode(), None
                if not seg:
                    nth = int(bool(whole.strip(BLANK)))
                elif whole.strip(BLANK):
                    nth = counts.get(section, 0)
                    counts[section] = nth + 1
                rows.append((*key, seg, "mid" if seg else "head", section, nth, whole))
                held, at, seg = b"", c + 1, seg + 1
                if opens[c]:
                    named = KEY.search(text + raw[c : c + 1])
                    if not named:
                        raise ValueError("no JSON object, or one whose keys have braces and go over two splits")
                    section = "" if named[2] == b"{" else json.loads(b'"' + named[1] + b'"')
                elif closes[c]:
                    section = ""
            held += raw[at:]
            if len(rows) >= 10_000:
                yield made()
        if key is not None:
            ended()
        if rows:
            yield made()

    return run


def elements(spark: SparkSession, path: str, key: str, schema: StructType | str) -> DataFrame:
    """(pos, element columns...): the elements of the array ``key`` of the JSON object in each file, in order."""
    return arrays(spark, path, {key: schema})[0]


def arrays(spark: SparkSession, path: str, schemas: dict[str, StructType | str]) -> list[DataFrame]:
    """The elements of several arrays, for which the files are cut once."""
    text = spark.read.text(path, lineSep="}").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"))
    splits = sorted(text.mapInArrow(effects, EFFECT).collect(), key=lambda r: (r.file, r.begin))  # a row for each split
    entry: dict[tuple[str, int], tuple[bool, bool, int]] = {}
    file, state, depth = None, STATES[0], 0
    for r in splits:
        if r.file != file:
            file, state, depth = r.file, STATES[0], 0
        entry[r.file, r.begin] = (*state, depth)
        if state not in STATES:
            raise ValueError(f"{r.file} is not JSON")
        i = STATES.index(state)
        state, depth = (r[f"in{i}"], r[f"esc{i}"]), depth + r[f"deeper{i}"]
    folder = scratch.new_folder(spark, "segments")
    text.mapInArrow(cutter(entry), SEGMENT).write.parquet(folder)
    segments = spark.read.schema(SEGMENT).parquet(folder)
    # what each split begins in: the section at the end of the last split with a cut, and there the segment that goes on
    told = segments.where("place <> 'mid'").drop("text").collect()  # some rows for each split
    ends = {(r.file, r.begin): r for r in told if r.place == "end"}
    counts = {(r.file, r.begin, r.section): r.nth for r in told if r.place == "count"}
    full = {(r.file, r.begin, r.place) for r in told if r.place in ("head", "tail", "through") and r.nth}
    plan, last, section = [], None, ""
    for r in splits:
        if last is None or last[0] != r.file:
            last, section = (r.file, -1), ""
        plan.append((r.file, r.begin, section, last[1]))
        own = ends[r.file, r.begin]
        if own.seg:
            last, section = (r.file, r.begin), own.section if own.section is not None else section
    table = F.broadcast(spark.createDataFrame(plan, "file string, begin long, inherited string, since long"))
    parts = segments.where("place in ('head', 'mid', 'tail', 'through')").join(table, SPLIT)
    own = parts.withColumn("led", F.col("section").isNotNull()).withColumn("section", F.coalesce("section", "inherited"))
    # an element that goes over splits belongs to the one in which it begins, as its last
    pieces = own.where("place <> 'mid'").withColumns({"origin": F.when(F.col("place") == "tail", F.col("begin")).otherwise(F.col("since"))})
    joined = pieces.groupBy("file", F.col("origin").alias("begin")).agg(F.max_by("section", F.when(F.col("place") == "head", F.col("begin"))).alias("section"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "seg", "text"))), lambda x: x["text"]), "").alias("text"))
    joined = joined.where(F.trim("text", F.lit(BLANK)) != "")
    over: dict[tuple[str, int], str] = {}  # the section of what goes on after a split
    some: dict[tuple[str, int], bool] = {}
    for file, begin, section, since in plan:
        for place, origin in (("head", since), ("through", since), ("tail", begin)):
            some[file, origin] = some.get((file, origin), False) or (file, begin, place) in full
        if ends[file, begin].seg and some[file, since]:
            over[file, since] = section

    def of(key: str, schema: StructType | str) -> DataFrame:
        first, base = 0, []
        for file, begin, inherited, _ in plan:
            before = counts.get((file, begin, None), 0) if inherited == key else 0
            within = before + counts.get((file, begin, key), 0)
            base.append((file, begin, first, before, within))
            first += within + (over.get((file, begin)) == key)
        at = F.broadcast(spark.createDataFrame(base, "file string, begin long, first long, before long, within long"))
        whole = own.where((F.col("place") == "mid") & F.col("nth").isNotNull() & (F.col("section") == key)).join(at, SPLIT)
        rows = whole.select((F.col("first") + F.col("nth") + F.when(F.col("led"), F.col("before")).otherwise(0)).alias("pos"), "text")
        rows = rows.unionByName(joined.where(F.col("section") == key).join(at, SPLIT).select((F.col("first") + F.col("within")).alias("pos"), "text"))
        return rows.select("pos", F.from_json("text", schema).alias("e")).select("pos", "e.*")

    return [of(key, schema) for key, schema in schemas.items()]


def write(rows: DataFrame, key: str, path: str) -> None:
    """Add files of one JSON object each to a folder, whose array ``key`` holds a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = f"{{{json.dumps(key)}: [\n"
        for batch in batches:
            lines = []
            for element in batch.column("value").to_pylist():
                lines.append(lead + element)
                lead = ","
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        if lead == ",":
            yield pa.RecordBatch.from_arrays([pa.array(["]}"])], ["value"])

    rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("value")).mapInArrow(run, "value string").write.mode("append").text(path)
