"""Substring dedup: removal of word passages that also start elsewhere.

A passage is a window of ``window`` consecutive words of one text.  The corpus
is compared with itself, so every text is reference and query at once:

1. Texts are taken once each; a text that several rows have is repeated whole.
2. Every window has an anchor, the least value of its runs of ``window // 3``
   words.  Equal windows have equal anchors, so only windows whose anchor is met
   twice can be repeated.  An anchor's home is the least text that has it, found by
   an aggregation, which no anchor that many texts share makes a single task; runs
   of such windows with one home are cut out as pieces and sent there.
3. At a home, a suffix automaton is built over the reference pieces and the
   others are streamed through it for matching statistics; only what is new
   extends it, so a family of near copies costs about one text.  Where the
   statistic reaches ``window`` the words of both places are marked.
4. A home with more than ``shard_words`` words is dealt to several reference
   shards, each with its automaton; a window that its own shard could not match
   is matched across the home's shards by a 128-bit digest of its words.  Pieces
   are of at most a quarter of a shard, so that long texts are dealt as well.

An automaton is sent where its anchors are instead of to every task: the
reference here is the corpus, and no bounded broadcast could hold it.

Defined cases: null and empty texts have no words; a text shorter than the
window keeps all; repeated rows are copies of one another; several ids may have
one text, and one id several texts; an empty table gives an empty result.  Texts
are identified by a 64-bit hash, windows of pieces compared word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import shared
from .kernels import chunks, grams, groups, released, sliding

SHARD_WORDS = 200_000  # words of a reference shard; bounds an automaton's memory


class Automaton:
    """Suffix automaton over several word sequences, with the first end of every state."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def _state(self, length: int, link: int, first: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.first.append(first)
        return len(self.length) - 1

    def _clone(self, p: int, q: int, word: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], self.first[q], self.next[q].copy())
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[int], at: int) -> None:
        """Add a sequence whose word i ends at place at + i."""
        following, link, length = self.next, self.link, self.length
        last = 0
        for end, word in enumerate(words, at):
            q = following[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, q, word)
                continue
            new = self._state(length[last] + 1, 0, end, {})
            p = last
            while p >= 0 and word not in following[p]:
                following[p][word] = new
                p = link[p]
            if p >= 0:
                q = following[p][word]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, word)
            last = new

    def matches(self, words: list[int], window: int) -> list[int]:
        """For each word, the first end of the window that ends there, or -1 if the window is unknown."""
        following, link, length, first = self.next, self.link, self.length, self.first
        v = size = 0
        out = []
        for word in words:
            while v and word not in following[v]:
                v = link[v]
                size = length[v]
            to = following[v].get(word)
            if to is not None:
                v = to
                size += 1
            while length[link[v]] >= window if v else False:
                v = link[v]
                size = length[v]
            out.append(first[v] if size >= window else -1)
        return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def repeated_in(pieces: list[bytes], window: int) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """Windows (by first word) of each piece that are met twice among the pieces, and one place of every window met."""
    automaton, codes = Automaton(), {}
    owner: list[tuple[int, int]] = []  # of each place of the reference: piece and word
    words = [[codes.setdefault(w, len(codes)) for w in piece.split()] for piece in pieces]
    marks = [np.zeros(max(0, len(w) - window + 1), bool) for w in words]
    held: list[tuple[int, int]] = []

    def mark(place: int) -> None:
        k, i = owner[place]
        marks[k][i - window + 1] = True

    for k, own in enumerate(words):
        known = np.array(automaton.matches(own, window)[window - 1 :] if owner else [-1] * len(marks[k]), np.int64)
        marks[k] |= known >= 0
        for place in np.unique(known[known >= 0]).tolist():
            mark(place)
        for low, high in runs(known < 0):
            span, at = own[low : high + window - 1], len(owner)
            owner.extend((k, i) for i in range(low, high + window - 1))
            automaton.add(span, at)
            for i, place in enumerate(automaton.matches(span, window)[window - 1 :], at + window - 1):
                if place != i:
                    mark(place)
                    mark(i)
                else:
                    held.append((k, owner[i][1] - window + 1))
    return marks, held


def unique_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """(tid, text, copies): every text once, null as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.xxhash64(text).alias("tid"), text.alias("text")).groupBy("tid").agg(F.first("text").alias("text"), F.count("*").alias("copies"))


def least_values(words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: values of runs of words, least value of each window, and which windows lie in one text."""
    k = max(1, window // 3)
    value = grams(words.hashes(), k)
    low = sliding(value, window - k + 1, np.minimum) if len(value) >= window - k + 1 else value[:0]
    edge = np.zeros(len(low) + 1, np.int64)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= window:
            edge[a] += 1
            edge[b - window + 1] -= 1
    return value, low, np.cumsum(edge[:-1]) > 0


def anchors(window: int) -> Callable:
    """(tid, text) -> (anchor, tid, many): the distinct anchors of every text; many: chosen at two places of it."""
    width = window - max(1, window // 3) + 1

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in chunks(batch, "text"):
                value, low, inside = least_values(words, window)
                if not inside.any():
                    continue
                low = np.where(inside, low, np.uint64(0))
                pad = np.zeros(width - 1, np.uint64)
                chosen = np.flatnonzero(sliding(np.concatenate((pad, low, pad)), width, np.maximum) == value)
                text = np.searchsorted(words.first, chosen, "right") - 1
                value = value[chosen]
                order = np.lexsort((value, text))
                text, value = text[order], value[order]
                new = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (value[1:] != value[:-1]))))
                many = np.diff(np.append(new, len(value))) > 1
                tid = part.column("tid").to_numpy()
                yield pa.RecordBatch.from_pydict({"anchor": value[new].view(np.int64), "tid": tid[text[new]], "many": many})

    return run


def cut_pieces(window: int, most: int) -> Callable:
    """(tid, text, found) -> (home, tid, start, words, piece): runs of up to ``most`` windows whose anchors have one home."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in chunks(batch, "text"):
                _, low, _ = least_values(words, window)
                found = part.column("found")
                offsets, values = found.offsets.to_numpy(), found.values
                anchor, home = values.field("anchor").to_numpy(), values.field("home").to_numpy()
                rows: dict[str, list] = {"home": [], "tid": [], "start": [], "words": [], "piece": []}
                for i, tid in enumerate(part.column("tid").to_pylist()):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    if b - a < window:
                        continue
                    order = np.argsort(anchor[offsets[i] : offsets[i + 1]])
                    own = anchor[offsets[i] : offsets[i + 1]][order]
                    homes = home[offsets[i] : offsets[i + 1]][order]
                    seen = low[a : b - window + 1].view(np.int64)
                    at = np.minimum(np.searchsorted(own, seen), len(own) - 1)
                    known = own[at] == seen
                    to = homes[at]
                    change = np.flatnonzero(np.concatenate(([True], (known[1:] != known[:-1]) | (to[1:] != to[:-1]), [True])))
                    change = np.unique(np.concatenate((change, np.arange(0, len(seen), most))))
                    for low_, high in zip(change[:-1].tolist(), change[1:].tolist(), strict=True):
                        if known[low_]:
                            rows["home"].append(int(to[low_]))
                            rows["tid"].append(tid)
                            rows["start"].append(low_)
                            rows["words"].append(high - low_ + window - 1)
                            rows["piece"].append(words.raw[words.starts[a + low_] : words.ends[a + high + window - 2]].tobytes())
                if rows["home"]:
                    yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "piece" else pa.int64()) for k, v in rows.items()})

    return run


def match_homes(window: int) -> Callable:
    """Sorted pieces of homes (and shards) -> (tid, low, high, digest): marked words, and windows for other shards to find."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {"tid": [], "low": [], "high": [], "digest": []}

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "digest" else pa.int64()) for k, v in rows.items()})
            for v in rows.values():
                v.clear()
            return out

        for group in groups(batches, ["home", "shard"]):
            pieces = group.column("piece").to_pylist()
            tids, starts = group.column("tid").to_pylist(), group.column("start").to_pylist()
            marks, held = repeated_in(pieces, window)
            for tid, start, flags in zip(tids, starts, marks, strict=True):
                for low, high in runs(flags):
                    rows["tid"].append(tid)
                    rows["low"].append(start + low)
                    rows["high"].append(start + high + window - 1)
                    rows["digest"].append(None)
            if group.column("shards")[0].as_py() > 1:
                split: dict[int, list[bytes]] = {}
                for k, i in held:
                    if k not in split:
                        split = {k: pieces[k].split()}
                    rows["tid"].append(tids[k])
                    rows["low"].append(starts[k] + i)
                    rows["high"].append(starts[k] + i + window)
                    rows["digest"].append(hashlib.blake2b(b" ".join(split[k][i : i + window]), digest_size=16).digest())
            if len(rows["tid"]) >= 20_000:
                yield flushed()
        if rows["tid"]:
            yield flushed()

    return run


def strip(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(tid, text, copies, spans) -> counts, the kept words joined by a space, and their digest."""
    for batch in batches:
        for part, words in chunks(batch, "text"):
            spans = part.column("spans").to_pylist()
            n_words, n_removed, kept, digest = [], [], [], []
            for i, copies in enumerate(part.column("copies").to_pylist()):
                own = words.text(i).split()
                gone = np.zeros(len(own), bool)
                if copies > 1 and len(own) >= window:
                    gone[:] = True
                for span in spans[i] or ():
                    gone[span["low"] : span["high"]] = True
                out = b" ".join([w for w, g in zip(own, gone.tolist(), strict=True) if not g] if gone.any() else own)
                n_words.append(len(own))
                n_removed.append(int(gone.sum()))
                kept.append(out)
                digest.append(hashlib.sha256(out).hexdigest())
            yield pa.RecordBatch.from_pydict({"tid": part.column("tid"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string()), "kept_sha256": pa.array(digest, pa.string())})


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, shard_words: int = SHARD_WORDS, keep_text: bool = True) -> DataFrame:
    """docs -> id_col, n_words, n_removed, kept (if keep_text: words that stay, joined by a space), kept_sha256."""
    texts = unique_texts(docs, text_col)
    found = shared.written(texts.select("tid", "text").mapInArrow(anchors(window), "anchor long, tid long, many boolean"), "anchors")
    homes = found.groupBy("anchor").agg(F.min("tid").alias("home"), F.count("*").alias("n"), F.max("many").alias("many")).where("many or n > 1")
    found = shared.matched(found, shared.written(homes, "homes"), ["anchor"], ["home"], ["tid"]).where("home is not null")
    found = found.groupBy("tid").agg(F.collect_list(F.struct("anchor", "home")).alias("found"))
    pieces = texts.join(found, "tid").select("tid", "text", "found").mapInArrow(cut_pieces(window, max(1, shard_words // 4)), "home long, tid long, start long, words long, piece binary")
    pieces = shared.written(pieces, "pieces")
    # a table of its own, so that the join below can split homes with very many pieces
    large = pieces.groupBy("home").agg(F.sum("words").alias("n")).where(F.col("n") > shard_words).select("home", F.ceil(F.col("n") / shard_words).alias("shards"))
    large = shared.written(large, "large")
    pieces = pieces.join(large, "home", "left").withColumn("shards", F.coalesce("shards", F.lit(1))).withColumn("shard", F.pmod(F.xxhash64("tid", "start"), "shards"))
    marks = pieces.repartition("home", "shard").sortWithinPartitions("home", "shard", "tid", "start").mapInArrow(match_homes(window), "tid long, low long, high long, digest binary")
    across = F.when(F.col("digest").isNull(), 2).otherwise(F.count("*").over(Window.partitionBy("digest", F.when(F.col("digest").isNull(), F.col("tid")))))
    spans = marks.withColumn("n", across).where("n > 1").groupBy("tid").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    stripped = texts.join(spans, "tid", "left").select("tid", "text", "copies", "spans").mapInArrow(released(lambda batches: strip(batches, window)), "tid long, n_words long, n_removed long, kept string, kept_sha256 string")
    if not keep_text:
        stripped = stripped.drop("kept")
    ids = docs.select(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_tid"))
    return ids.join(stripped, F.col("_tid") == F.col("tid")).drop("_tid", "tid")
