"""Dense document features for the classifiers, computed over whole texts, and their bounded training samples.

Empty and null texts have all-zero features.  Labels, language, source and
document id are no inputs of any feature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .kernels import LOWER, Words, chunks, grams, released


def table_of(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode("latin-1"))] = True
    return out


UPPER, DIGIT = table_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), table_of("0123456789")
SYMBOL, MARK, STOP = table_of("#$%&*@^~_=+<>"), table_of("!?"), table_of(".,;:")
PIPE, LINE, QUOTE = table_of("|/\\{}[]"), table_of("\n"), table_of("\"'()")
HIGH = np.arange(256) >= 0x80
LETTER = UPPER | table_of("abcdefghijklmnopqrstuvwxyz") | HIGH
NOT_LETTER = ~LETTER
LEET = LOWER.copy()
for _from, _to in zip("013457@$", "oieastas", strict=True):
    LEET[ord(_from)] = ord(_to)
NOT_LEET = ~(LETTER | DIGIT | table_of("@$"))

# Frequent function words and second-person words of four languages.
FUNCTION_WORDS = "the of and to a in is it that was for on with as be at by this are or der die das und ist ein eine zu mit von den dem nicht für auf im des sich es le la les de un une et est que qui dans pour pas sur au en el los las y del por con no para su se al".split()
SECOND_PERSON = "you your yours yourself du dich dir dein deine euch euer tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros".split()


def word_values(words: list[str]) -> np.ndarray:
    """Sorted hash values of lower-case words, as ``Words.hashes`` gives them."""
    if not words:
        return np.zeros(0, np.uint64)
    raw = [w.encode() for w in words]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    return np.unique(Words(data, np.array([0, len(data)])).hashes())


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Chunk:
    """Counts per text over a chunk: of byte classes, words, and flags on words."""

    def __init__(self, words: Words):
        self.words = words
        self.n_bytes = np.diff(words.offsets).astype(float)
        self.n_words = np.diff(words.first).astype(float)

    def bytes_in(self, table: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(table[self.words.raw], dtype=np.int64)))
        return (sums[self.words.offsets[1:]] - sums[self.words.offsets[:-1]]).astype(float)

    @staticmethod
    def per_text(words: Words, values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(values, dtype=float)))
        return sums[words.first[1:]] - sums[words.first[:-1]]


def per(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def repeats(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: distinct values, and the count of the most frequent one."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, text))
    text, values = text[order], values[order]
    if not len(values):
        return np.zeros(len(first) - 1), np.zeros(len(first) - 1)
    new = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (values[1:] != values[:-1]))))
    counts, own = np.diff(np.append(new, len(values))), text[new]
    distinct = np.bincount(own, minlength=len(first) - 1).astype(float)
    top = np.zeros(len(first) - 1)
    np.maximum.at(top, own, counts)
    return distinct, top


def family(words: Words) -> np.ndarray:
    """The least value of each text's runs of five words; near copies mostly have the same."""
    hashes = words.hashes()
    value = grams(hashes, 5)
    out = np.zeros(len(words), np.uint64)
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        out[i] = value[a : b - 4].min() if b - a >= 5 else hashes[a:b].sum(dtype=np.uint64)
    return out


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learn: Column, most: int) -> DataFrame:
    """(text, label): texts of at most ``most`` labelled ids, those least by hash among the ids that ``learn`` allows.

    The bound makes the ids small enough to broadcast, however large the tables are.  An id may have many texts;
    ``sampled_features`` bounds those.
    """
    ids = labels.where(learn & F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(f"`{label_col}`").cast("double").alias("label"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(ids), "id").select("text", "label")


def map_texts(rows: DataFrame, schema: str, make: Callable[[pa.RecordBatch, Words], dict]) -> DataFrame:
    """rows (with a column ``text``) chunk by chunk through ``make``."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in chunks(batch, "text", lower=True):
                yield pa.RecordBatch.from_pydict(make(part, words))

    return rows.mapInArrow(run, schema)


def scored(docs: DataFrame, text_col: str, score_col: str, score: Callable[[Words], np.ndarray]) -> DataFrame:
    """docs with a column score_col (double; replaces one of that name); rows go to Python once, as structs."""
    kept = [c for c in docs.columns if c != score_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    place = kept.index(text_col)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            for part, words in chunks(pa.RecordBatch.from_arrays([row, row.field(place).cast(pa.large_string())], ["row", "text"]), "text", lower=True):
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(score(words), pa.float64())], ["row", "score"])

    out = rows.mapInArrow(run, StructType([rows.schema["row"], StructField("score", DoubleType())]))
    return out.select("row.*", F.col("score").alias(score_col))


def sampled_features(rows: DataFrame, make: Callable[[Words], np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample, one row of each family of copies, in an order that reruns keep.

    Of more than ``most`` families, which only ids with many texts can give, those of the least values are taken.
    """

    def run(part: pa.RecordBatch, words: Words) -> dict:
        x = make(words)
        return {"family": family(words).view(np.int64), "label": part.column("label"), "x": pa.array(list(x), pa.list_(pa.float64()))}

    got = map_texts(rows, "family long, label double, x array<double>", run).groupBy("family").agg(F.max(F.struct("label", "x")).alias("r")).orderBy("family").limit(most).select("r.label", "r.x").toArrow()
    x = got.column("x").combine_chunks()
    n = got.num_rows
    return (x.flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 0))), got.column("label").to_numpy()
