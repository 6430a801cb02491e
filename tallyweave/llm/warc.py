"""WARC records in ZIP-packaged web archives, written by executors and read by range.

A package is a ZIP file whose members are stored, not compressed: `archive/data.warc` with the records and
`indexes/index.cdxj` with the offset and length of each. The reader looks for the end-of-central-directory record,
follows it (or its ZIP64 form) to the central directory, locates a member's bytes through its local header, and
reads single records by range; nothing is extracted and no member is read whole except the index.

Of records with equal payloads of REVISIT_BYTES or more, the one of the largest page_id is the response and the
others are revisits that refer to it. Which one that is comes from a combinable maximum by payload digest and
length, so a payload that a third of all pages share stays spread over all tasks.

Packages are files in the shared folder (an executor can lose its own disk), written under a name of the task's
attempt and listed by a table, so that only those of finished tasks are read. `FileRanges` reads them by offset
through Arrow's file systems, block by block. If the shared folder is in a store that Arrow cannot open, the listing
holds the packages themselves, and their ranges are slices. `PackageReader` takes any function that reads a range.

Defined results: null html is an empty payload; a null url leaves the header out; a null page_id is a response;
rows are packed each for itself, so equal ones are all responses if they carry the largest page_id; payloads of any
length are whole, also over several blocks; a record that cannot be read, or whose payload has another digest than
its header tells, is a row of type `damaged` with the page of the index and nulls; a package without a directory is
one such row without a page; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.staging import fresh_path, mapped, written

REVISIT_BYTES = 1000
#: A package is closed once its records reach this size, so a task holds one package in memory.
PACKAGE_BYTES = 8 << 20
DATA, INDEX = "archive/data.warc", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Signatures of the ZIP format.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
#: An end record with the longest comment, and the ZIP64 locator before it.
LARGEST_END = 22 + 65_535 + 20
#: Bytes that a file is read in.
BLOCK = 1 << 20
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
#: Tasks that read packages at most.
MOST_READERS = 10_000


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow's file system of a path, and the path there."""
    scheme, _, rest = path.partition(":")
    if not rest or scheme == "file":
        return pa.fs.LocalFileSystem(), "/" + (rest or path).lstrip("/")
    try:
        return pa.fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as e:
        raise ValueError(f"no file system for {path}") from e


class FileRanges:
    """read(offset, length) over a file, through one block at a time, so that records in a row are few requests."""

    def __init__(self, path: str, block: int = BLOCK):
        fs, place = file_system(path)
        self.file, self.block, self.held, self.at = fs.open_input_file(place), block, b"", 0
        self.size = self.file.size()

    def __call__(self, offset: int, length: int) -> bytes:
        if offset < self.at or offset + length > self.at + len(self.held):
            self.at, self.held = offset, bytes(self.file.read_at(min(max(length, self.block), max(0, self.size - offset)), offset))
        return self.held[offset - self.at : offset - self.at + length]

    def close(self) -> None:
        self.file.close()


class PackageReader:
    """Stored members of a ZIP file, through a function read(offset, length)."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        self.members: dict[str, tuple[int, int]] = {}  # name: offset of the local header, stored bytes
        self.begins: dict[str, int] = {}  # name: offset of the stored bytes, once its local header was read
        tail_at = max(0, size - LARGEST_END)
        tail = read(tail_at, size - tail_at)
        at = tail.rfind(END)
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("no ZIP end record")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        if at >= 20 and tail[at - 20 : at - 16] == LOCATOR64:
            (where,) = struct.unpack_from("<Q", tail, at - 12)
            end64 = read(where, 56)
            if end64[:4] != END64:
                raise ValueError("no ZIP64 end record")
            count, length, start = struct.unpack_from("<QQQ", end64, 32)
        directory, at = read(start, length), 0
        for _ in range(count):
            if directory[at : at + 4] != ENTRY:
                raise ValueError("broken ZIP directory")
            method, packed, plain, name, extra, comment, local = struct.unpack_from("<10xH8xIIHHH8xI", directory, at)
            title = directory[at + 46 : at + 46 + name].decode()
            fields, k = directory[at + 46 + name : at + 46 + name + extra], 0
            while k + 4 <= len(fields):
                tag, width = struct.unpack_from("<HH", fields, k)
                if tag == 1:  # ZIP64: only the values that are full in the entry, in this order
                    wide, p = [], k + 4
                    for value in (plain, packed, local):
                        if value == 0xFFFFFFFF:
                            value = struct.unpack_from("<Q", fields, p)[0]
                            p += 8
                        wide.append(value)
                    plain, packed, local = wide
                k += 4 + width
            if method == 0:
                self.members[title] = (local, packed)
            at += 46 + name + extra + comment

    def range(self, member: str, start: int = 0, length: int | None = None) -> bytes:
        local, size = self.members[member]
        if member not in self.begins:
            head = self.read(local, 30)
            if head[:4] != LOCAL:
                raise ValueError("broken ZIP member")
            self.begins[member] = local + 30 + sum(struct.unpack_from("<HH", head, 26))
        return self.read(self.begins[member] + start, size - start if length is None else min(length, size - start))

    def index(self) -> Iterator[dict]:
        for line in self.range(INDEX).decode().splitlines():
            yield json.loads(line.partition(" ")[2])


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%"))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*lines, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record; names in lower case."""

    def headers(block: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode().split("\r\n")[1:])}

    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = headers(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, headers(http), payload


class PackageWriter:
    """A ZIP file of stored members, written in one pass; sizes, offsets and the directory's end are in ZIP64 fields."""

    def __init__(self, write: Callable[[bytes], object]):
        self._write, self.at, self.entries, self.n = write, 0, b"", 0

    def _out(self, data: bytes) -> None:
        self._write(data)
        self.at += len(data)

    def member(self, name: str, parts: Iterable[bytes]) -> None:
        """The parts are gone through once for length and checksum and once to be written."""
        parts = list(parts)
        size, crc, title, local = sum(map(len, parts)), 0, name.encode(), self.at
        for part in parts:
            crc = zlib.crc32(part, crc)
        common = struct.pack("<HHHHHIIIH", 45, 0x800, 0, 0, 0x21, crc, FULL32, FULL32, len(title))  # version, UTF-8 name, stored, 1980-01-01
        self._out(LOCAL + common + struct.pack("<H", 20) + title + struct.pack("<HHQQ", 1, 16, size, size))
        for part in parts:
            self._out(part)
        self.entries += ENTRY + struct.pack("<H", 45) + common + struct.pack("<HHHHII", 28, 0, 0, 0, 0, FULL32) + title + struct.pack("<HHQQQ", 1, 24, size, size, local)
        self.n += 1

    def close(self) -> int:
        """The directory; returns the file's size."""
        start, length = self.at, len(self.entries)
        self._out(self.entries)
        self._out(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, self.n, self.n, length, start))
        self._out(LOCATOR64 + struct.pack("<IQI", 0, start + length, 1))
        self._out(END + struct.pack("<HHHHIIH", 0, 0, FULL16, FULL16, FULL32, FULL32, 0))
        return self.at


def pack_records(write: Callable[[bytes], object], records: list[tuple[int | None, bytes]]) -> int:
    """A package of records and their index; returns its size."""
    lines, at = [], 0
    for page_id, raw in records:
        lines.append(f"{at:012d} {json.dumps({'page': page_id, 'offset': at, 'length': len(raw)})}\n".encode())
        at += len(raw)
    package = PackageWriter(write)
    package.member(DATA, (raw for _, raw in records))
    package.member(INDEX, lines)
    return package.close()


def write_package(path: str, records: list[tuple[int | None, bytes]]) -> int:
    """A package of records at a path; returns its size."""
    fs, place = file_system(path)
    fs.create_dir(place.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(place) as out:
        return pack_records(out.write, records)


def planned(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is the response's page_id for revisits, else null."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"], F.coalesce(pages["html"], F.lit("")).alias("html"))
    rows = rows.select("*", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("size"))
    last = written(rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "size", "last"), "payloads")
    return rows.join(last, ["digest", "size"], "left").select("page_id", "url", "html", F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers_to"))


def packages(pages: DataFrame, folder: str | None) -> DataFrame:
    """(path, size, package): ZIP-packaged archives of all pages, written to a folder that all executors share; without
    a folder, in the column package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/pages-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        n, held, size = 0, [], 0

        def closed() -> pa.RecordBatch:
            if folder is None:
                out = io.BytesIO()
                row = (None, pack_records(out.write, held), out.getvalue())
            else:
                path = f"{name}-{n:05d}.wacz"
                row = (path, write_package(path, held), None)
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, (pa.string(), pa.int64(), pa.binary()))], names=["path", "size", "package"])

        for b in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                held.append((page_id, record("response" if refers_to is None else "revisit", page_id, url, html.encode(), refers_to)))
                size += len(held[-1][1])
                if size >= PACKAGE_BYTES:
                    yield closed()
                    n, held, size = n + 1, [], 0
        if held:
            yield closed()

    return mapped(planned(pages), run, "path string, size long, package binary")


ROW = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string())]


def read_record(raw: bytes, page_id: int | None) -> tuple:
    """The row of a record. The payload digest of a response is computed anew."""
    try:
        warc, http, payload = parsed(raw)
        told = base64.b32decode(warc["warc-payload-digest"].partition(":")[2]).hex()
        kind, refers = warc["warc-type"], warc.get("warc-refers-to", "<urn:page:>")[10:-1]
        digest = hashlib.sha1(payload).hexdigest() if kind == "response" else told
        if digest == told:
            return page_id, int(http["content-length"]) if kind == "revisit" else len(payload), digest, kind, int(refers) if refers else None, warc.get("warc-target-uri")
    except (KeyError, ValueError):
        pass
    return page_id, None, None, "damaged", None, None


def read_package(read: Callable[[int, int], bytes], size: int) -> Iterator[tuple]:
    """A row for each record that a package's index names, read by its range alone, in the order of the ranges."""
    try:
        reader = PackageReader(read, size)
        entries = sorted(reader.index(), key=lambda e: e["offset"])
    except (KeyError, ValueError, struct.error):
        yield None, None, None, "damaged", None, None
        return
    for entry in entries:
        yield read_record(reader.range(DATA, entry["offset"], entry["length"]), entry["page"])


def records(listed: DataFrame) -> DataFrame:
    """Every record of the listed packages, found through their directories and indexes."""

    def rows(path: str | None, package: pa.Scalar) -> list[tuple]:
        if path is None:
            view = memoryview(package.as_buffer())
            return list(read_package(lambda at, n: bytes(view[at : at + n]), len(view)))
        ranges = FileRanges(path)
        try:
            return list(read_package(ranges, ranges.size))
        finally:
            ranges.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, package in zip(b.column(0).to_pylist(), b.column(1)):
                out = rows(path, package)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out) if out else [[]] * len(ROW), ROW)], names=[n for n, _ in ROW])

    return mapped(listed.select("path", "package"), run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")


def round_trip(pages: DataFrame) -> DataFrame:
    """All records of all pages, written to packages and read back from them."""
    folder: str | None = fresh_path(pages.sparkSession, "packages")
    try:
        file_system(folder)
    except ValueError:
        folder = None
    listed = written(packages(pages, folder), "listed")
    return records(listed.repartition(max(1, min(listed.count(), MOST_READERS))) if folder else listed)  # a task reads package after package
