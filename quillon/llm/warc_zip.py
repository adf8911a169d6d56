"""WARC archives in ZIP packages: written, and read back by ranges without unpacking.

A package (one file) holds two stored members: ``archive/data.warc.gz``, whose records are gzip members of their own,
and ``indexes/index.cdxj``, a line per record: the reversed host and path of its URL, its time, and a JSON object with its
offset and length in the archive, sorted by the first two. The reader takes the end of the
file, follows the directory (ZIP64 included) to the members, reads the index and then each record by its range.

Packages lie in the folder that driver and executors share, reached by its URI (file, hdfs, s3 and what else pyarrow's
file systems know). Each task attempt writes files of its own, and only those of the attempts that succeeded are in the
manifest, so lost executors and repeated tasks do no harm.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import col, new_path, slices, small_side, stored

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payload bytes after which a task starts another package.
ROLL = 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
LEVEL = 1


# -- records ----------------------------------------------------------------------------------------------------


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(record: int | None) -> str:
    return f"<urn:x-page:{'' if record is None else record}>"


def escaped(url: str) -> str:
    """The URL as a header bears it: what isn't printable ASCII as its UTF-8 bytes, percent-encoded."""
    return quote(url, safe="".join(chr(c) for c in range(0x21, 0x7F)))


def sort_key(url: str | None) -> str:
    """The key of an index line: host parts last to first, then path and query, in lower case; "-" without a URL."""
    parts = urlsplit(escaped(url or "").lower(), allow_fragments=False) if "[" not in (url or "") else None
    if parts is None or not parts.netloc:
        return escaped(url or "-").lower()
    host = parts.netloc.rpartition("@")[2].removeprefix("www.")
    return ",".join(reversed(host.partition(":")[0].split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def record_bytes(record: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, digest: str | None = None) -> bytes:
    """One WARC record, not compressed. A revisit holds the HTTP header, which states the payload's length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(record)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest or payload_digest(payload)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {escaped(url)}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes

    @property
    def number(self) -> int | None:
        return _number(self.headers["warc-record-id"])

    @property
    def refers_to(self) -> int | None:
        return _number(self.headers["warc-refers-to"]) if "warc-refers-to" in self.headers else None


def _number(text: str) -> int | None:
    digits = text.removeprefix("<urn:x-page:").removesuffix(">")
    return int(digits) if digits else None


def parse_record(raw: bytes) -> Record:
    """The headers, HTTP headers and payload of one record; checks its lengths."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("no WARC record here")
    headers = _fields(lines)
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return Record(headers, _fields(http.decode().split("\r\n")[1:]), payload)


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


# -- packages ---------------------------------------------------------------------------------------------------


class PackageWriter:
    """Streams records to one ZIP package; the index, a short line per record of one package, is held until the end."""

    def __init__(self, stream):
        self.stream, self.zip = stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.at, self.index, self.taken = 0, [], 0

    def add(self, record: int | None, url: str | None, raw: bytes) -> None:
        packed = gzip.compress(raw, LEVEL, mtime=0)
        self.member.write(packed)
        entry = {"id": record, "url": url, "filename": ARCHIVE.rpartition("/")[2], "offset": str(self.at), "length": str(len(packed))}
        self.index.append(f"{sort_key(url)} {re.sub('[^0-9]', '', DATE)} {json.dumps(entry, separators=(',', ':'))}")
        self.at += len(packed)
        self.taken += len(raw)

    def close(self) -> int:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as member:
            member.write("\n".join(sorted(self.index)).encode())
        self.zip.close()
        self.stream.close()
        return len(self.index)


@dataclass
class Member:
    name: str
    header_at: int
    size: int
    stored: bool


class PackageReader:
    """Finds members by the central directory and reads ranges of stored ones. ``source`` has size() and read_at()."""

    def __init__(self, source):
        self.source, self.size = source, source.size()
        self.members = {m.name: m for m in self._directory()}

    def _read(self, at: int, size: int) -> bytes:
        got = self.source.read_at(size, at)
        got = got if isinstance(got, bytes) else bytes(got)
        if len(got) != size:
            raise ValueError("the package ends too early")
        return got

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.size - 65_557)
        tail = self._read(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory")
        _, _, _, _, count, size, at, _ = struct.unpack("<4s4H2LH", tail[end : end + 22])
        if (count == 0xFFFF or size == 0xFFFFFFFF or at == 0xFFFFFFFF) and tail_at + end >= 20:
            locator = self._read(tail_at + end - 20, 20)
            if locator[:4] == b"PK\x06\x07":
                end64 = struct.unpack("<4sLQL", locator)[2]
                count, size, at = struct.unpack("<3Q", self._read(end64, 56)[32:])
        listing, i = self._read(at, size), 0
        for _ in range(count):
            fields = struct.unpack("<4s6H3L5H2L", listing[i : i + 46])
            method, packed, whole, n, extra, note, header_at = fields[4], fields[8], fields[9], fields[10], fields[11], fields[12], fields[16]
            name, more = listing[i + 46 : i + 46 + n].decode(), listing[i + 46 + n : i + 46 + n + extra]
            while len(more) >= 4:
                kind, length = struct.unpack("<2H", more[:4])
                if kind == 1:  # ZIP64: only the fields that did not fit, in this order
                    wide = list(struct.unpack(f"<{length // 8}Q", more[4 : 4 + length // 8 * 8]))
                    whole = wide.pop(0) if whole == 0xFFFFFFFF else whole
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    header_at = wide.pop(0) if header_at == 0xFFFFFFFF else header_at
                more = more[4 + length :]
            yield Member(name, header_at, packed, method == 0)
            i += 46 + n + extra + note

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin in the file."""
        member = self.members[name]
        if not member.stored:
            raise ValueError(f"{name} is compressed in its package")
        header = self._read(member.header_at, 30)
        if header[:4] != b"PK\x03\x04":
            raise ValueError("no member where the directory says")
        n, extra = struct.unpack("<2H", header[26:30])
        return member.header_at + 30 + n + extra

    def member(self, name: str) -> bytes:
        return self._read(self.start(name), self.members[name].size)

    def records(self) -> Iterator[bytes]:
        """Every record of the archive, read by the ranges of the index."""
        start = self.start(ARCHIVE)
        for line in filter(None, self.member(INDEX).decode().split("\n")):
            entry = json.loads(line.split(" ", 2)[2])
            yield zlib.decompress(self._read(start + int(entry["offset"]), int(entry["length"])), 31)


class _Source:
    """pyarrow's random-access file as a source of ranges."""

    def __init__(self, file):
        self.size, self.read_at = file.size, file.read_at


# -- Spark ------------------------------------------------------------------------------------------------------

MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType())])
READ = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())])


def decided(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Rows (page_id, url, payload, refers_to) of all pages: of equal payloads the largest page_id is the response, others refer to it.

    Payloads under ``least_bytes`` never refer. The lookup has only digests that occur on several pages; it is broadcast
    if few enough, else joined by digest.
    """
    # the digest decides; null counts as empty
    rows = pages.select(col(pages, "page_id").cast("long").alias("page_id"), col(pages, "url").alias("url"), F.coalesce(col(pages, "html"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("digest", F.sha1("payload"))
    several = keyed.select("page_id", "digest", F.octet_length("payload").alias("n")).filter(F.col("n") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = stored(several.select(F.col("digest").alias("d"), "keeper"))
    refers = F.when(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return keyed.join(small_side(several), F.col("digest") == F.col("d"), "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_packages(rows: DataFrame, uri: str, *, roll: int = ROLL) -> DataFrame:
    """Write the rows of ``decided`` as packages under ``uri``; returns the manifest (path, records), stored.

    A null url leaves its header out; an empty table writes no package."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(MANIFEST)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(uri)
        fs.create_dir(base, recursive=True)
        writer, path, done = None, "", []
        for batch in batches:
            for part in slices(batch):
                for page, url, payload, refers in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                    if writer is None:
                        path = f"{base}/{uuid.uuid4().hex}.wacz"
                        writer = PackageWriter(fs.open_output_stream(path))
                    writer.add(page, url, record_bytes(page, url, payload, "response" if refers is None else "revisit", refers))
                    if writer.taken >= roll:
                        done.append((path, writer.close()))
                        writer = None
        if writer is not None:
            done.append((path, writer.close()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([n for _, n in done], pa.int64())], schema=schema)

    return stored(rows.select("page_id", "url", "payload", "refers_to").mapInArrow(write, MANIFEST))


def read_packages(manifest: DataFrame, uri: str) -> DataFrame:
    """A row per record of the manifest's packages; the digest of a response is computed from the payload that was read."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(READ)

    def described(raw: bytes) -> tuple:
        record = parse_record(raw)
        kind, stated = record.headers["warc-type"], record.headers["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and payload_digest(record.payload) != stated:
            raise ValueError(f"the payload of record {record.number} is damaged")
        # a revisit has no payload of its own, but states that of the response it refers to
        size = len(record.payload) if kind == "response" else int(record.http["content-length"])
        return record.number, size, stated, kind, record.refers_to

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[tuple] = []
                with contextlib.closing(fs.open_input_file(path)) as file:
                    for raw in PackageReader(_Source(file)).records():
                        rows.append(described(raw))
                        if len(rows) == 8192:
                            yield _rows(rows, schema)
                            rows = []
                if rows:
                    yield _rows(rows, schema)

    packages = manifest.count()
    return manifest.repartition(max(1, packages)).mapInArrow(read, READ)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def round_trip(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Write all pages as WARC packages in the shared folder and read them back: a row per page.

    A null html is an empty payload; a null url leaves its header out; rows that agree in page_id and payload with the
    response are responses too; an empty table writes no package and gives an empty result.
    """
    uri = new_path(pages.sparkSession, "warc")
    return read_packages(write_packages(decided(pages, least_bytes=least_bytes), uri), uri)
