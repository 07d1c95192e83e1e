"""WARC records in ZIP-packaged archives: writer, directory reader and range reads.

An archive is a ZIP file with two stored (not deflated) members: ``archive/data.warc.gz``,
one gzip member for each WARC record, and ``indexes/index.cdxj``, one line for each record
with its place inside the first member. A reader parses the ZIP's central directory (also
in its ZIP64 form), locates the members, reads the index and then reads ranges of the
archive; nothing is extracted to disk. Records with a payload that an earlier record
holds are ``revisit`` records: they carry the HTTP header and the payload's digest only.

Archives are written to and read from the folder that driver and executors share, by any
URI that Arrow's file systems open. A writer task names its files by a random id and
returns their paths; these are kept in a table, so what a failed attempt left is not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import urllib.parse
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, fresh_path, hot_keys, spread_join, written

#: Equal payloads of fewer bytes are stored again rather than referred to.
REVISIT_FROM_BYTES = 100
#: A writer begins another archive after this many packed bytes ...
ARCHIVE_BYTES = 32 << 20
#: ... and a reader reads ranges of about this many.
RANGE_BYTES = 1 << 20
#: Date that records carry: captures have none here.
CAPTURED = "1970-01-01T00:00:00Z"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RESULT = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


# ---- records ----


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit holds no payload but the length and digest of the full one."""
    page = "null" if page_id is None else str(page_id)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {CAPTURED}"]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """Headers and payload of one record. Raises ValueError where lengths or the digest disagree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    names = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(names["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or len(block) != int(names["Content-Length"]):
        raise ValueError("a record's length disagrees with its header")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest, kind = names["WARC-Payload-Digest"].removeprefix("sha256:"), names["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload disagrees with its digest")
    number = lambda urn: None if urn is None or urn == "<urn:page:null>" else int(urn[len("<urn:page:") : -1])
    return {
        "page_id": number(names["WARC-Record-ID"]), "url": names.get("WARC-Target-URI"), "payload": payload if kind == "response" else None,
        "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(names.get("WARC-Refers-To")),
    }


# ---- ZIP directories ----


@dataclass(frozen=True)
class Member:
    """A stored member: where its local header begins and how many bytes it has."""

    name: str
    header: int
    size: int


def _zip64(extra: bytes, values: list[int], sizes: list[int]) -> list[int]:
    """Replaces values that are all ones by those of the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            spot = at + 4
            for i, (v, width) in enumerate(zip(values, sizes, strict=True)):
                if v == (1 << 8 * width) - 1:
                    values[i] = struct.unpack_from("<Q", extra, spot)[0]
                    spot += 8
        at += 4 + length
    return values


def directory(source, size: int) -> list[Member]:
    """Members of the ZIP file by its central directory. ``source`` is an open Arrow input file."""
    tail_at = max(0, size - 65_557)
    tail = source.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("no ZIP file: it has no end-of-directory record")
    count, length, begin = struct.unpack_from("<10xHII", tail, end)
    locator = end - 20
    if locator >= 0 and tail[locator : locator + 4] == b"PK\6\7":
        (at64,) = struct.unpack_from("<8xQ", tail, locator)
        record64 = source.read_at(56, at64)
        if record64[:4] != b"PK\6\6":
            raise ValueError("the ZIP64 end-of-directory record is not where its locator says")
        count, length, begin = struct.unpack_from("<32xQQQ", record64)
    raw, at, members = source.read_at(length, begin), 0, []
    for _ in range(count):
        if raw[at : at + 4] != b"PK\1\2":
            raise ValueError("the central directory is broken")
        method, packed, full, n, m, k, header = struct.unpack_from("<10xH8xIIHHH8xI", raw, at)
        name = raw[at + 46 : at + 46 + n].decode()
        full, packed, header = _zip64(raw[at + 46 + n : at + 46 + n + m], [full, packed, header], [4, 4, 4])
        if method != 0 or packed != full:
            raise ValueError(f"{name} is not stored, so its ranges can't be read")
        members.append(Member(name, header, full))
        at += 46 + n + m + k
    return members


def data_begin(source, member: Member) -> int:
    """Where a member's data begin, by its local header (whose name and extra field have lengths of their own)."""
    head = source.read_at(30, member.header)
    if head[:4] != b"PK\3\4":
        raise ValueError("a local header is not where the directory says")
    n, m = struct.unpack_from("<26xHH", head)
    return member.header + 30 + n + m


def read_archive(path: str, range_bytes: int = RANGE_BYTES) -> Iterator[dict]:
    """All records of an archive in the order of its index, by reads of ranges of consecutive records."""
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as source:
        members = {m.name: m for m in directory(source, source.size())}
        index = members[INDEX]
        lines = source.read_at(index.size, data_begin(source, index)).splitlines()
        base, data = data_begin(source, members[DATA]), members[DATA]
        places = [(int(x["offset"]), int(x["length"])) for x in map(json.loads, lines)]
        if any(o + n > data.size for o, n in places):
            raise ValueError("the index points beyond the data")
        k = 0
        while k < len(places):
            end, first = k + 1, places[k][0]
            while end < len(places) and places[end][0] == sum(places[end - 1]) and sum(places[end]) - first <= range_bytes:
                end += 1
            block = source.read_at(sum(places[end - 1]) - first, base + first)
            for offset, length in places[k:end]:
                yield parsed(zlib.decompress(block[offset - first : offset - first + length], 31))
            k = end


class ArchiveWriter:
    """Writes records to ZIP files below ``folder``; ``paths`` are those that are complete."""

    def __init__(self, folder: str, limit: int = ARCHIVE_BYTES):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.uri, self.limit, self.paths = folder, limit, []
        self.zip = None

    def add(self, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> None:
        if self.zip is None:
            self.name = f"{uuid.uuid4().hex}.zip"
            self.store.create_dir(self.folder, recursive=True)
            self.out = self.store.open_output_stream(f"{self.folder}/{self.name}")
            self.zip = zipfile.ZipFile(_Stream(self.out), "w", zipfile.ZIP_STORED, allowZip64=True)
            self.data, self.at, self.lines = self.zip.open(DATA, "w", force_zip64=True), 0, []
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = packer.compress(record(page_id, url, payload, digest, refers_to)) + packer.flush()
        self.data.write(packed)
        self.lines.append(json.dumps({"page_id": page_id, "digest": digest, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)
        if self.at >= self.limit:
            self.close()

    def close(self) -> None:
        if self.zip is not None:
            self.data.close()
            self.zip.writestr(INDEX, "\n".join(self.lines))
            self.zip.close()
            self.out.close()
            self.paths.append((f"{self.uri}/{self.name}", len(self.lines)))
            self.zip = None


class _Stream:
    """What zipfile needs of a file that can only be appended to."""

    def __init__(self, out):
        self.out = out

    def write(self, data) -> int:
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        self.out.flush()


# ---- operators ----


def with_references(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and refers_to of every row.

    Of rows with equal payloads of REVISIT_FROM_BYTES or more, the smallest page_id (null
    ids come last) is the response; the others refer to it. Rows that repeat that page_id
    are responses too. A null html counts as empty. The ids of each digest are
    pre-aggregated before the shuffle; shorter payloads, and rows of a digest that many
    share, are dealt over many tasks.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= REVISIT_FROM_BYTES, F.col("digest")))
    first = written(rows.where("same IS NOT NULL").groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "first-pages")
    return spread_join(rows, first, "same", hot_keys(first, "same", pages.count()), [F.col("page_id"), F.col("url")], "left").select(
        "page_id", "url", "payload", "digest", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of with_references() below ``folder``; path and number of records of each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(folder, limit)
        for b in batches:
            for row in zip(*b.columns, strict=True):
                writer.add(*(x.as_py() for x in row))
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in writer.paths], pa.string()), pa.array([n for _, n in writer.paths], pa.int64())], ["path", "records"])

    return rows.mapInArrow(run, "path string, records long")


def read_archives(archives: DataFrame, payloads: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every record of the archives in column ``path``; without ``payloads`` that column is null."""
    types = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                held: list[dict] = []
                for x in read_archive(path, range_bytes):
                    held.append(x if payloads else x | {"payload": None})
                    if len(held) >= 512:
                        yield pa.RecordBatch.from_pylist(held, schema=types)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema=types)

    return archives.select("path").mapInArrow(run, RESULT)


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None, payloads: bool = False) -> DataFrame:
    """Writes every row of ``pages`` to archives in ``folder`` (the shared folder by default) and reads them back."""
    folder = folder or fresh_path(bounded_batches(spark), "warc")
    archives = written(write_archives(with_references(pages), folder), "warc-paths")
    return read_archives(archives.repartition(max(1, archives.count())), payloads)
