"""Media columns: MPEG transport streams (ISO/IEC 13818-1) of payloads, stored as a binary column and read back.

``mux`` packs a payload as an elementary stream: program tables, then access
units as packetised elementary stream packets with time stamps, some of them
random-access points with a clock reference, all in packets of 188 bytes.
``demux`` reads any such stream: it finds the programs in the tables, checks
their checksums and the continuity counters of every stream, drops repeated
packets, reassembles elementary packets, and lists access units with their time
stamps and random-access flags.  Both work on the packets of a stream as arrays.

``stored`` writes the media table and ``read_back`` parses it, a row for each
document, so a document is in memory once; nothing is shuffled.

Defined cases: a null text is empty; a payload is padded with blanks to a
positive multiple of ``align`` bytes; equal texts have equal media; repeated
rows and null ids are rows of their own; an empty table gives no rows; columns
beyond those named are ignored.  Bytes that are no packet are skipped and
counted (``lost_bytes``); a table that is cut off or whose checksum fails is ignored and counted; a
gap in a counter ends the unit at hand, which is marked as broken.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import shared
from .kernels import released

# Fixed values of the format.
SIZE, SYNC = 188, 0x47
PAT_PID, NULL_PID = 0x0000, 0x1FFF
PAT_ID, PMT_ID = 0x00, 0x02
PRIVATE_STREAM_1, PES_PRIVATE_DATA = 0xBD, 0x06
CLOCK = 90_000  # ticks a second
CRC_POLYNOMIAL = 0x04C11DB7
NO_HEADER = {0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF}  # stream ids whose packets have no optional header

# Parameters of streams that are made here.
PROGRAM, PMT_PID, DATA_PID = 1, 0x1000, 0x0100
UNIT_BYTES = 3072  # of an access unit
UNIT_TICKS, FIRST_TICK = 3600, 126_000
RANDOM_EVERY = 8  # units from one random-access point to the next
ALIGN = 192
HELD_BYTES = 1 << 22  # of rows that are handed on together


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ CRC_POLYNOMIAL if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


CRC_TABLE = _crc_table()


def crc(data: bytes) -> int:
    """The checksum of program tables; 0 over a table with its checksum."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ CRC_TABLE[(c >> 24) ^ b]
    return c


def section(table: int, number: int, body: bytes) -> bytes:
    """A program table in one section."""
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc(head + body).to_bytes(4, "big")


def table_packet(pid: int, counter: int, data: bytes) -> bytes:
    """A section in one packet."""
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter, 0])
    return (head + data).ljust(SIZE, b"\xff")


def tick_bytes(tick: int, mark: int) -> bytes:
    """A time stamp of 33 bits as 5 bytes with marker bits."""
    t = tick % (1 << 33)
    return bytes([mark << 4 | (t >> 30) << 1 | 1]) + ((t >> 15 & 0x7FFF) << 1 | 1).to_bytes(2, "big") + ((t & 0x7FFF) << 1 | 1).to_bytes(2, "big")


def tick_of(raw: bytes) -> int:
    return (raw[0] >> 1 & 7) << 30 | raw[1] << 22 | (raw[2] >> 1) << 15 | raw[3] << 7 | raw[4] >> 1


def clock_bytes(tick: int) -> bytes:
    """A program clock reference: base of 33 bits and an extension of 0."""
    return ((tick % (1 << 33)) << 15 | 0x3F << 9).to_bytes(6, "big")


def mux(payload: bytes, unit_bytes: int = UNIT_BYTES, random_every: int = RANDOM_EVERY) -> bytes:
    """The payload as a transport stream of one program with one stream; program tables come before every random-access point."""
    if not 0 < unit_bytes <= 0xFFFF - 8:
        raise ValueError(f"an access unit has 1 to {0xFFFF - 8} bytes here")
    pat = section(PAT_ID, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = section(PMT_ID, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PES_PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
    out, counter, tables = bytearray(), 0, 0
    for number, at in enumerate(range(0, len(payload), unit_bytes)):
        data = payload[at : at + unit_bytes]
        tick, random = FIRST_TICK + number * UNIT_TICKS, number % random_every == 0
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + tick_bytes(tick, 2) + data
        if random:
            out += table_packet(PAT_PID, tables, pat) + table_packet(PMT_PID, tables, pmt)
            tables = tables + 1 & 15
        first = (b"\x07\x50" + clock_bytes(tick)) if random else b""
        count = -(-(len(pes) + len(first)) // (SIZE - 4))
        own = np.full((count, SIZE), 0xFF, np.uint8)
        own[:, 0], own[:, 1], own[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
        own[:, 3] = 0x10 | (counter + np.arange(count)) & 15
        own[0, 1] |= 0x40
        # all packets but the last are full; the last (or only) one is filled up by its adaptation field
        start = np.full(count, 4)
        if first:
            own[0, 3] |= 0x20
            own[0, 4 : 4 + len(first)] = np.frombuffer(first, np.uint8)
            start[0] += len(first)
        spare = int((SIZE - start).sum()) - len(pes)
        if spare:
            last = count - 1
            own[last, 3] |= 0x20
            if start[last] == 4:
                own[last, 4] = spare - 1
                if spare > 1:
                    own[last, 5] = 0
            else:
                own[last, 4] += spare
            start[last] += spare
        own[np.arange(SIZE) >= start[:, None]] = np.frombuffer(pes, np.uint8)
        counter = counter + count & 15
        out += own.tobytes()
    return bytes(out)


@dataclass
class Unit:
    """An access unit: time stamps (decoding as presentation where it has none), and where it is in its stream's payload."""

    pts: int | None
    dts: int | None
    random_access: bool
    broken: bool
    offset: int
    bytes: int


@dataclass
class Stream:
    program: int
    pid: int
    stream_type: int
    units: list[Unit] = field(default_factory=list)
    payload: bytes = b""
    packets: int = 0
    gaps: int = 0  # places where the continuity counter jumps
    repeated: int = 0  # packets sent twice
    clocks: int = 0  # program clock references


@dataclass
class Media:
    streams: list[Stream] = field(default_factory=list)
    packets: int = 0
    lost_bytes: int = 0
    bad_tables: int = 0


def packets(media: bytes) -> tuple[np.ndarray, int]:
    """(packets x 188, bytes that are in none).  A packet begins with the sync byte; after other bytes, so must the next one."""
    data = np.frombuffer(media, np.uint8)
    if len(data) % SIZE == 0 and (data[::SIZE] == SYNC).all():
        return data.reshape(-1, SIZE), 0
    found, at, n = [], 0, len(data)
    while at + SIZE <= n:
        follows = bool(found) and found[-1] + SIZE == at
        if data[at] == SYNC and (follows or at + SIZE == n or data[at + SIZE] == SYNC):
            found.append(at)
            at += SIZE
        else:
            at += 1
    own = np.stack([data[i : i + SIZE] for i in found]) if found else np.zeros((0, SIZE), np.uint8)
    return own, n - len(found) * SIZE


class Packets:
    """Header fields of packets as columns."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.pid = (rows[:, 1].astype(np.int64) & 0x1F) << 8 | rows[:, 2]
        self.error = rows[:, 1] & 0x80 > 0
        self.begins = rows[:, 1] & 0x40 > 0
        self.counter = rows[:, 3] & 15
        self.carries = rows[:, 3] & 0x10 > 0
        adapts = rows[:, 3] & 0x20 > 0
        length = np.where(adapts, rows[:, 4].astype(np.int64), -1)
        flags = np.where(length > 0, rows[:, 5], 0)
        self.start = np.where(self.carries, np.minimum(4 + 1 + length, SIZE), SIZE)
        self.jumps = flags & 0x80 > 0  # the counter may begin anew
        self.random = flags & 0x40 > 0
        self.clock = flags & 0x10 > 0

    def of(self, pid: int) -> np.ndarray:
        return np.flatnonzero((self.pid == pid) & ~self.error)

    def continuity(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(packets without those sent twice, which of them come after a gap)."""
        if not len(own):
            return own, np.zeros(0, bool)
        step = (self.counter[own[1:]].astype(int) - self.counter[own[:-1]]) & 15
        moves = self.carries[own[1:]]
        # a repeated packet has the counter and the bytes of the one before it
        twice = np.concatenate(([False], moves & (step == 0) & (self.rows[own[1:], 4:] == self.rows[own[:-1], 4:]).all(1) & self.carries[own[:-1]]))
        gap = np.concatenate(([False], (step != moves.astype(int)) & ~self.jumps[own[1:]])) & ~twice
        return own[~twice], gap[~twice]

    def data(self, own: np.ndarray, skip: np.ndarray | int = 0) -> bytes:
        return self.rows[own][np.arange(SIZE) >= (self.start[own] + skip)[:, None]].tobytes()


def sections(table: Packets, pid: int) -> tuple[list[bytes], int]:
    """(program tables of a packet id whose checksum holds, number of others: wrong or cut off)."""
    own, gaps = table.continuity(table.of(pid))
    out, bad, held = [], 0, None

    def ended(data: bytes) -> bytes:
        nonlocal bad
        while len(data) >= 3 and data[0] != 0xFF:
            size = 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)
            if len(data) < size:
                break
            if size >= 12 and crc(data[:size]) == 0:
                out.append(data[:size])
            else:
                bad += 1
            data = data[size:]
        return data

    def cut(rest: bytes) -> None:
        """What is left where another table begins, or at the end, is a table that was cut off."""
        nonlocal bad
        bad += bool(rest) and rest[0] != 0xFF

    for i, gap in zip(own.tolist(), gaps.tolist(), strict=True):
        data = table.rows[i, table.start[i] :].tobytes()
        if gap and held is not None:
            cut(held)
            held = None
        if table.begins[i] and data:
            before, data = data[1 : 1 + data[0]], data[1 + data[0] :]
            if held is not None:
                cut(ended(held + before))
            held = b""
        if held is not None:
            held = ended(held + data)
    cut(held or b"")
    return out, bad


def programs(table: Packets) -> tuple[list[Stream], int]:
    """Streams of all programs, from the association table and the map tables; the last valid table counts."""
    found, bad = sections(table, PAT_PID)
    maps: dict[int, int] = {}
    for s in found:
        if s[0] == PAT_ID:
            for at in range(8, len(s) - 4, 4):
                number = int.from_bytes(s[at : at + 2], "big")
                if number:  # (0 is the network table)
                    maps[number] = int.from_bytes(s[at + 2 : at + 4], "big") & 0x1FFF
    streams: dict[int, Stream] = {}
    for number, pid in sorted(maps.items()):
        found, wrong = sections(table, pid)
        bad += wrong
        for s in found:
            if s[0] != PMT_ID or int.from_bytes(s[3:5], "big") != number:
                continue
            at = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
            while at + 5 <= len(s) - 4:
                own = int.from_bytes(s[at + 1 : at + 3], "big") & 0x1FFF
                streams[own] = Stream(number, own, s[at])
                at += 5 + (int.from_bytes(s[at + 3 : at + 5], "big") & 0xFFF)
    return [streams[p] for p in sorted(streams)], bad


def reassembled(table: Packets, stream: Stream) -> None:
    """Fill in a stream's units, payload and counts."""
    own = table.of(stream.pid)
    stream.packets, stream.clocks = len(own), int(table.clock[own].sum())
    kept, gaps = table.continuity(own)
    stream.repeated, stream.gaps = len(own) - len(kept), int(gaps.sum())
    starts = np.flatnonzero(table.begins[kept])
    parts, size = [], 0
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(kept)], strict=True):
        broken = bool(gaps[a + 1 : b].any())
        upto = a + 1 + int(np.argmax(gaps[a + 1 : b])) if broken else b  # what follows a gap belongs to no unit for sure
        data = table.data(kept[a:upto])
        if len(data) < 6 or data[:3] != b"\x00\x00\x01":
            broken, body, pts, dts = True, b"", None, None
        else:
            length, pts, dts, at = int.from_bytes(data[4:6], "big"), None, None, 6
            if data[3] not in NO_HEADER and len(data) >= 9:
                at = 9 + data[8]
                if data[7] & 0x80 and len(data) >= 14:
                    pts = tick_of(data[9:14])
                if data[7] & 0xC0 == 0xC0 and len(data) >= 19:
                    dts = tick_of(data[14:19])
            body = data[at : 6 + length] if length else data[at:]  # (length 0: up to the next unit)
            broken |= bool(length) and len(data) < 6 + length
        stream.units.append(Unit(pts, pts if dts is None else dts, bool(table.random[kept[a]]), broken, size, len(body)))
        parts.append(body)
        size += len(body)
    stream.payload = b"".join(parts)


def demux(media: bytes) -> Media:
    """Programs, streams and access units of a transport stream."""
    rows, lost = packets(media)
    table = Packets(rows)
    streams, bad = programs(table)
    for s in streams:
        reassembled(table, s)
    return Media(streams, len(rows), lost, bad)


def feature(media: Media) -> str:
    """What is in a stream, as one line."""
    parts = []
    for s in media.streams:
        ticks = [u.pts for u in s.units if u.pts is not None]
        steps = np.diff(ticks)
        parts.append(f"program {s.program} pid {s.pid} type {s.stream_type}: {s.packets} packets, {len(s.units)} units, {sum(u.random_access for u in s.units)} random access, {s.clocks} clocks, pts {ticks[0] if ticks else '-'} to {ticks[-1] if ticks else '-'} step {int(np.median(steps)) if len(steps) else '-'}, {s.gaps} gaps, {s.repeated} repeated, {sum(u.broken for u in s.units)} broken")
    return "; ".join([*parts, f"{media.packets} packets, {media.lost_bytes} lost bytes, {media.bad_tables} bad tables"])


def padded(data: bytes, align: int = ALIGN) -> bytes:
    """data and blanks up to a positive multiple of align."""
    return data.ljust(max(1, -(-len(data) // align)) * align, b" ")


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", align: int = ALIGN) -> DataFrame:
    """(id, n_bytes, media): texts as transport streams, a written table."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sizes, media = 0, [], []
            for i in range(batch.num_rows):
                data = bytes(batch.column("data")[i].as_buffer() or b"")
                sizes.append(len(data))
                media.append(mux(padded(data, align)))
                if i + 1 == batch.num_rows or sum(map(len, media)) > HELD_BYTES:
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(sizes)), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])
                    at, sizes, media = i + 1, [], []

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("data"))
    kind = rows.schema["id"].dataType.simpleString()
    return shared.written(rows.mapInArrow(run, f"id {kind}, n_bytes long, media binary"), "media")


def files(spark: SparkSession, path: str) -> DataFrame:
    """Transport streams in files as a media table: id is the file's path, and n_bytes its size."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("id"), F.col("length").alias("n_bytes"), F.col("content").alias("media"))


UNITS = "array<struct<pid:int,pts:bigint,dts:bigint,random_access:boolean,broken:boolean,start:bigint,bytes:bigint>>"
DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(table: DataFrame, units: bool = False, payload: bool = False) -> DataFrame:
    """A row for each of ``stored``'s: id, DIGESTS, and if asked for the access units and the payload."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = []
            for i in range(batch.num_rows):
                raw = bytes(batch.column("media")[i].as_buffer() or b"")
                media = demux(raw)
                data = b"".join(s.payload for s in media.streams)
                own = [batch.column("id")[i].as_py(), batch.column("n_bytes")[i].as_py(), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(media)]
                if units:
                    own.append([{"pid": s.pid, "pts": u.pts, "dts": u.dts, "random_access": u.random_access, "broken": u.broken, "start": u.offset, "bytes": u.bytes} for s in media.streams for u in s.units])
                if payload:
                    own.append(data)
                rows.append(own)
                if payload and sum(len(r[-1]) for r in rows) > HELD_BYTES:
                    yield made(rows, batch.schema.field("id").type)
                    rows = []
            if rows:
                yield made(rows, batch.schema.field("id").type)

    unit = pa.list_(pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_()), ("broken", pa.bool_()), ("start", pa.int64()), ("bytes", pa.int64())]))
    fixed = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *([unit] if units else []), *([pa.binary()] if payload else [])]
    names = ["id", *[c.split()[0] for c in DIGESTS.split(", ")], *(["units"] if units else []), *(["payload"] if payload else [])]

    def made(rows: list[list], id_type: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [id_type, *fixed], strict=True)], names)

    kind = table.schema["id"].dataType.simpleString()
    more = (f", units {UNITS}" if units else "") + (", payload binary" if payload else "")
    return table.mapInArrow(run, f"id {kind}, {DIGESTS}{more}")
