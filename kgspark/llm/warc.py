"""WARC: writing web records as archives and reading them back as a chunked record table.

``write_archives`` writes gzip members, a record each, into the shared folder;
``read_chunks`` streams an archive as rows of (record, chunk number) with at
most ``chunk_bytes`` of payload each and a running SHA-1 digest, so a payload of
any size is never in memory whole.  A payload that another record has as well is
written once; the others are revisit records that refer to it.

Defined cases: a null payload is empty; a null url gives a record without target;
rows with equal id and payload are records of their own (each a response if the
id is the largest of its payload); a null id is less than any other; an empty
table gives no archive and no rows; columns beyond those named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import shared
from .kernels import released

LEAST = 1000  # bytes of the smallest payload that is worth a revisit record
FILE_BYTES = 256 << 20  # of compressed records, before another archive is begun
CHUNK_BYTES = 64 << 10
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}|{digest}')}>"


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def header(page: int | None, url: str | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """Header of a record; sizes of payloads that aren't there are in an extension field."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    lines += [f"WARC-Payload-Digest: sha1:{base32(digest)}", f"X-Payload-Length: {size}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(HTTP) + (size if refers_to is None else 0)}", "", ""]
    return "\r\n".join(lines).encode()


class Archive:
    """One archive being written; it gets its name only when it is complete."""

    def __init__(self, folder: str):
        self.system, path = fs.FileSystem.from_uri(folder)
        self.system.create_dir(path, recursive=True)
        name = uuid.uuid4().hex
        self.uri, self.path, self.part = f"{folder}/{name}.warc.gz", f"{path}/{name}.warc.gz", f"{path}/.{name}.part"
        self.out = self.system.open_output_stream(self.part)
        self.records = 0

    def add(self, head: bytes, payload: memoryview) -> None:
        pack = zlib.compressobj(1, wbits=31)
        self.out.write(pack.compress(head + HTTP))
        for at in range(0, len(payload), CHUNK_BYTES):
            self.out.write(pack.compress(payload[at : at + CHUNK_BYTES]))
        self.out.write(pack.compress(b"\r\n\r\n") + pack.flush())
        self.records += 1

    def close(self) -> dict:
        size = self.out.tell()
        self.out.close()
        self.system.move(self.part, self.path)
        return {"archive": [self.uri], "records": pa.array([self.records], pa.int64()), "bytes": pa.array([size], pa.int64())}


def writer(folder: str, file_bytes: int) -> Callable:
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, digest, size, refers_to = (batch.column(c)[i].as_py() for c in ("page", "url", "digest", "size", "refers_to"))
                archive = archive or Archive(folder)
                payload = memoryview(b"") if refers_to is not None else memoryview(batch.column("payload")[i].as_buffer() or b"")
                archive.add(header(page, url, digest, size, refers_to), payload)
                if archive.out.tell() >= file_bytes:
                    yield pa.RecordBatch.from_pydict(archive.close())
                    archive = None
        if archive:
            yield pa.RecordBatch.from_pydict(archive.close())

    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives; the manifest (archive, records, bytes) lists those of tasks that succeeded."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"), F.xxhash64("payload").alias("check"))
    same = rows.where(F.col("size") >= least).groupBy("digest", "check", "size").agg(F.max("page").alias("largest"), F.count("*").alias("n")).where("n > 1")
    rows = shared.matched(rows, shared.written(same, "payloads"), ["digest", "check", "size"], ["largest"], ["page", "url"])
    rows = rows.withColumn("refers_to", F.expr("if(largest is not null and not (page <=> largest), largest, null)"))
    folder = shared.new_path(pages.sparkSession, "warc")
    return shared.written(rows.select("page", "url", "payload", "digest", "size", "refers_to").mapInArrow(writer(folder, file_bytes), "archive string, records long, bytes long"), "manifest")


class Reader:
    """Bytes of an archive's members, decompressed as they are asked for."""

    def __init__(self, uri: str, block: int = 1 << 16):
        system, path = fs.FileSystem.from_uri(uri)
        self.source, self.block = system.open_input_stream(path, compression=None), block
        self.unpack, self.ready = zlib.decompressobj(wbits=31), b""

    def more(self) -> bool:
        """Decompress some more; False at the end."""
        while True:
            raw = self.unpack.unconsumed_tail or self.unpack.unused_data or self.source.read(self.block)
            if not raw:
                return False
            if self.unpack.eof:
                self.unpack = zlib.decompressobj(wbits=31)
            got = self.unpack.decompress(raw, self.block)
            if got:
                self.ready += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.ready.find(mark)) < 0:
            if not self.more():
                return None
        out, self.ready = self.ready[:at], self.ready[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        """Up to n bytes, at least one unless the archive ends."""
        if not self.ready and not self.more():
            raise EOFError("the archive ends within a record")
        out, self.ready = self.ready[:n], self.ready[n:]
        return out

    def skip(self, n: int) -> None:
        while n:
            n -= len(self.take(n))


CHUNK_SCHEMA = "record_id string, record_type string, page_id long, refers_to long, url string, chunk int, last boolean, data binary, payload_bytes long, payload_digest string"


def reader(chunk_bytes: int, with_data: bool) -> Callable:
    names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[c.split()[1]] for c in CHUNK_SCHEMA.split(", ")]

    def records(uri: str) -> Iterator[tuple]:
        source = Reader(uri)
        while (head := source.until(b"\r\n\r\n")) is not None:
            lines = head.decode().split("\r\n")
            if lines[0] not in ("WARC/1.0", "WARC/1.1"):
                raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
            fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
            page, refers_to = (int(v) if (v := fields.get(k)) else None for k in ("x-page-id", "x-refers-to-page-id"))
            fixed = (fields["warc-record-id"], fields["warc-type"], page, refers_to, fields.get("warc-target-uri"))
            declared = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
            left = int(fields["content-length"])
            http = source.until(b"\r\n\r\n")
            left -= len(http) + 4
            if fields["warc-type"] == "revisit":
                source.skip(left)
                yield (*fixed, 0, True, None, int(fields["x-payload-length"]), declared)
            else:
                digest, size, number, held = hashlib.sha1(), 0, 0, b""
                while True:
                    while left and len(held) < chunk_bytes:
                        got = source.take(min(left, chunk_bytes - len(held)))
                        held, left = held + got, left - len(got)
                    digest.update(held)
                    size += len(held)
                    yield (*fixed, number, not left, held if with_data else None, size, digest.hexdigest())
                    number, held = number + 1, b""
                    if not left:
                        break
                if digest.hexdigest() != declared:
                    raise ValueError(f"payload of {fixed[0]} does not match its digest")
            source.skip(4)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                rows: list[tuple] = []
                for row in records(uri):
                    rows.append(row)
                    if len(rows) >= (64 if with_data else 4096):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def read_chunks(spark: SparkSession, manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table of a manifest's archives.

    A row for each chunk of each record: number from 0, its data, and size and
    digest of the payload so far; in the row marked ``last`` these are the whole
    payload's.  Revisit records have one row without data, with the size and
    digest of the payload that they refer to.
    """
    archives = manifest.select("archive").repartition(max(1, min(10_000, manifest.count())), "archive")
    return archives.mapInArrow(reader(chunk_bytes, with_data), CHUNK_SCHEMA)


def records(chunks: DataFrame) -> DataFrame:
    """A row for each record, without its payload."""
    return chunks.where("last").select("record_id", "record_type", "page_id", "refers_to", "url", "payload_bytes", "payload_digest")
