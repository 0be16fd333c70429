"""Byte-level BPE encoding and decoding.

Two tiers.  A minimal perfect hash over the vocabulary's byte strings resolves
a pre-token that is itself a token; any other pre-token is merged by a heap of
candidate pairs over a doubly linked list of its bytes, pairs being looked up by
their two ids.  Vocabularies are read, never trained.  Bounded memos in each
Python worker keep the ids of pre-tokens met before and, under patterns whose
pre-tokens hold a blank only in front, of words with the blank before them.

Null and empty texts give no ids.  Repeated rows give equal results; no row
depends on another, so nothing is shuffled.  Texts of any length are encoded
whole: time is linear in the text but for the logarithm of a pre-token's length.
Columns of the input, whatever their names, are only read as asked for.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import struct
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .kernels import released

MEMO_ENTRIES = 400_000  # pre-tokens, and words, remembered in a worker before the memo is emptied
SHORT = 40  # bytes of a pre-token up to which its pairs are looked through, not kept in a heap
NONE = 1 << 32  # no pair; above all ranks
MARKS = ".,;:!?)]}\"-"
NATIVE = array("I").itemsize == 4 and sys.byteorder == "little"

# Under these a blank and the word after it are cut alike whatever stands around them: no pre-token goes on from a word
# to white space, and white space before them is a pre-token of its own.
WORDS_APART = {r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""}


class PerfectHash:
    """Minimal perfect hash by hash-and-displace; a lookup reads one seed and compares one key."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.size, self.n_buckets = n, max(1, n // 2)  # (so few keys that a bucket alone, placed last, has many free slots left to its others)
        both = [self._hash(k) for k in keys]
        buckets: list[list[int]] = [[] for _ in range(self.n_buckets)]
        for i, (h, _) in enumerate(both):
            buckets[h % self.n_buckets].append(i)
        self.seeds = [0] * self.n_buckets
        self.slots = [-1] * n
        free = iter(())
        for b in sorted(range(self.n_buckets), key=lambda b: -len(buckets[b])):
            own = buckets[b]
            if not own:
                break
            if len(own) == 1:  # any free slot, stored as a negative seed
                if free == ():
                    free = iter(())
                slot = next((s for s in free if self.slots[s] < 0), None)
                if slot is None:
                    free = iter([s for s in range(n) if self.slots[s] < 0])
                    slot = next(free)
                self.slots[slot] = own[0]
                self.seeds[b] = -slot - 1
                continue
            seed = 1
            while True:
                at = {self._slot(both[i][1], seed) for i in own}
                if len(at) == len(own) and all(self.slots[s] < 0 for s in at):
                    break
                seed += 1
            for i in own:
                self.slots[self._slot(both[i][1], seed)] = i
            self.seeds[b] = seed
        self.keys = [keys[i] for i in self.slots]

    @staticmethod
    def _hash(key: bytes) -> tuple[int, int]:
        return struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())

    def _slot(self, h: int, seed: int) -> int:
        h ^= seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return (h ^ h >> 29) % self.size

    def find(self, key: bytes) -> int:
        """Number of the key in the list given, or -1."""
        if not self.size:
            return -1
        h, g = self._hash(key)
        seed = self.seeds[h % self.n_buckets]
        slot = -seed - 1 if seed < 0 else self._slot(g, seed)
        return self.slots[slot] if self.keys[slot] == key else -1


class Encoder:
    """ranks: token bytes -> id; lower ids merge first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.tokens = list(ranks)
        self.ids = [ranks[t] for t in self.tokens]
        self.hash = PerfectHash(self.tokens)
        self.ranks = ranks
        self.by_id = {i: t for t, i in ranks.items()}
        self.single = [ranks.get(bytes([b])) for b in range(256)]
        self.pairs = {left << 32 | right: r for t, r in ranks.items() for i in range(1, len(t)) if (left := ranks.get(t[:i])) is not None and (right := ranks.get(t[i:])) is not None}
        self.first = [self.pairs.get(-1 if a is None or b is None else a << 32 | b, NONE) for a in self.single for b in self.single]  # pairs of bytes
        self.memo: dict[str, bytes] = {}
        self.words: dict[str, bytes] | None = {} if pattern in WORDS_APART else None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token: the leftmost pair of least rank is merged until no pair is a token."""
        pair, n = self.pairs.get, len(piece)
        own = [self.single[b] for b in piece]
        if n <= SHORT:
            first = self.first
            return self._merge_short(own, [first[a << 8 | b] for a, b in zip(piece, piece[1:])])
        least = [pair(a << 32 | b, -1) for a, b in zip(own, own[1:])] + [-1]  # of the pair that begins here
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i, r in enumerate(least) if r >= 0]
        heapq.heapify(heap)
        while heap:
            at = heapq.heappop(heap)
            r, i = at >> 32, at & 0xFFFFFFFF
            if least[i] != r:
                continue  # one of the two has grown or gone since
            j = after[i]
            k = after[i] = after[j]
            own[i], own[j], least[i], least[j] = r, -1, -1, -1
            if k < n:
                before[k] = i
                if (found := pair(r << 32 | own[k], -1)) >= 0:
                    least[i] = found
                    heapq.heappush(heap, found << 32 | i)
            if (h := before[i]) >= 0:
                found = least[h] = pair(own[h] << 32 | r, -1)
                if found >= 0:
                    heapq.heappush(heap, found << 32 | h)
        return [i for i in own if i >= 0]

    def _merge_short(self, own: list[int], least: list[int]) -> list[int]:
        """The same by looking through all pairs each time, which is faster for few; least: ranks of the pairs."""
        pair = self.pairs.get
        while least and (r := min(least)) != NONE:
            i = least.index(r)
            own[i] = r
            del own[i + 1], least[i]
            if i < len(least):
                least[i] = pair(r << 32 | own[i + 1], NONE)
            if i:
                least[i - 1] = pair(own[i - 1] << 32 | r, NONE)
        return own

    def piece(self, text: str) -> bytes:
        """Little-endian 32-bit ids of one pre-token."""
        raw = text.encode("utf-8", "surrogatepass")
        at = self.hash.find(raw)
        ids = [self.ids[at]] if at >= 0 else self.merge(raw)
        return array("I", ids).tobytes() if NATIVE else struct.pack(f"<{len(ids)}I", *ids)

    def word(self, word: str) -> bytes:
        """Ids of a blank and a word without white space: letters, and marks after them, need no pattern to be told apart."""
        core = word.rstrip(MARKS)
        if not core.isalpha():
            return self.pieces(" " + word)
        if len(core) == len(word):
            return self.piece(" " + word)
        own, tail = self.words.get(core), word[len(core) :]
        if own is None:
            own = self.remembered(self.words, core, self.piece(" " + core))
        return own + (self.memo.get(tail) or self.remembered(self.memo, tail, self.piece(tail)))

    @staticmethod
    def remembered(memo: dict[str, bytes], key: str, got: bytes) -> bytes:
        if len(memo) >= MEMO_ENTRIES:
            memo.clear()
        if len(key) <= 64:
            memo[key] = got
        return got

    def pieces(self, text: str) -> bytes:
        """Ids of all pre-tokens of a text."""
        memo, out = self.memo, []
        for found in self.pattern.findall(text):
            got = memo.get(found)
            if got is None:
                got = self.remembered(memo, found, self.piece(found))
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        words = self.words
        if words is None:
            return self.pieces(text)
        parts = text.split(" ")
        out = list(map(words.get, parts))  # (a word stands for itself and the blank before it)
        out[0] = None
        n, i = len(parts), 0
        while i < n:
            if out[i] is not None:
                i += 1
                continue
            part, start = parts[i], i
            i += 1
            if start and part.split() == [part]:
                got = out[start] = words.get(part)  # (it may have been met since)
                if got is None:
                    out[start] = self.remembered(words, part, self.word(part))
                continue
            while i < n and out[i] is None and parts[i].split() != [parts[i]]:  # several blanks, and words with other white space
                i += 1
            out[start] = self.pieces(" " * (start > 0) + " ".join(parts[start:i]))
            out[start + 1 : i] = [b""] * (i - start - 1)
        return b"".join(out)

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


def parse_ranks(lines: bytes) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, lines.splitlines()))}


@functools.lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Encoder:
    """The encoder of a vocabulary file installed on every machine."""
    with open(path, "rb") as f:
        return Encoder(parse_ranks(f.read()), pattern)


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """docs -> id_col, n_tokens long, ids array<long> (if keep_ids), ids_sha256, decoded_sha256 (lowercase hex).

    path: vocabulary file, at the same place on all executors; pattern: the
    pre-tokenisation.  Null ids are kept as they are.
    """
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, ids, ids_sha, back_sha = [], [], [], []
                for text in part.column("text").to_pylist():
                    raw = coder.encode(text or "")
                    own = np.frombuffer(raw, "<u4")
                    counts.append(len(own))
                    ids_sha.append(hashlib.sha256(raw).hexdigest())
                    back_sha.append(hashlib.sha256(coder.decode(own)).hexdigest())
                    if keep_ids:
                        ids.append(own.astype(np.int64))
                out = {"id": part.column("id"), "n_tokens": pa.array(counts, pa.int64())}
                if keep_ids:
                    out["ids"] = pa.array(ids, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out | {"ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(back_sha, pa.string())})

    schema = f"id {id_type}, n_tokens long, " + "ids array<long>, " * keep_ids + "ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decoded(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids) -> id_col, data binary: the bytes that the ids stand for; null ids give null."""
    id_type = tokens.select(id_col).schema[0].dataType.simpleString()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path, pattern)
        for batch in batches:
            data = [None if ids is None else coder.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "data": pa.array(data, pa.binary())})

    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {id_type}, data binary").withColumnRenamed("id", id_col)
