"""WARC records in ZIP-packaged archives, written by executors and read back by range.

An archive is a ZIP file whose members are stored, not compressed: ``archive/data.warc.gz``, where every record
is a gzip member of its own, and ``indexes/index.cdxj``, one line per record with offset and length. The reader
parses the central directory (ZIP64 where needed) from the end of the file, locates the members, reads the index
and then each record by its range; nothing is extracted. ``locate`` and ``read_records`` are two Spark steps, so
the records of one huge archive are read by many tasks.

Paths are URIs of any file system that pyarrow knows.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, shared_dir

ARCHIVE_BYTES = 32 << 20  # of compressed records in an archive, about
LEAST = 100  # bytes of a payload from which repeats become revisits
DUPLICATES = 200_000  # broadcast bound, in rows of a digest and an id
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ARCHIVES = "archive string, bytes long, records long"
LOCATORS = "archive string, offset long, length long"
RECORDS = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())]


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file://{uri}")


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def from_urn(text: str | None) -> int | None:
    inner = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


def header_value(text: str) -> str:
    """A URI on one line: control characters and blanks are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response, or a revisit that keeps the HTTP header alone (with the length of the full payload)."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", header_value(url)))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if revisit:
        fields += [("WARC-Refers-To", urn(refers_to)), ("WARC-Profile", PROFILE), ("WARC-Truncated", "length")]
    else:
        block += payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """page_id, url, record_type, digest (of the payload read, or as a revisit states it), bytes, refers_to, payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    page_id, url = from_urn(fields["warc-record-id"]), fields.get("warc-target-uri")
    if fields["warc-type"] == "revisit":
        length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        return page_id, url, "revisit", fields["warc-payload-digest"].removeprefix("sha256:"), length, from_urn(fields.get("warc-refers-to")), None
    digest = hashlib.sha256(payload).hexdigest()
    if f"sha256:{digest}" != fields["warc-payload-digest"]:
        raise ValueError(f"payload of {fields['warc-record-id']} doesn't fit its digest")
    return page_id, url, fields["warc-type"], digest, len(payload), None, payload


class Window:
    """Bytes of a file by range, through anything with size() and read_at(length, offset)."""

    def __init__(self, file):
        self.file, self.size = file, file.size()

    def read(self, offset: int, length: int) -> bytes:
        got = self.file.read_at(length, offset)
        if len(got) != length:
            raise ValueError(f"{length} bytes at {offset} reach over the end of the file")
        return got


def central_directory(file: Window) -> dict[str, tuple[int, int, int]]:
    """{member: (method, offset of its local header, compressed size)}, from the end record of a ZIP file and,
    where a field is full, the ZIP64 records."""
    tail_at = max(0, file.size - 65_557)
    tail = file.read(tail_at, file.size - tail_at)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and (len(tail) < at + 22 or struct.unpack_from("<H", tail, at + 20)[0] != len(tail) - at - 22):  # a comment may hold the mark
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, offset = struct.unpack_from("<HII", tail, at + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (size, offset):
        mark, _, there = struct.unpack("<4sIQ", file.read(tail_at + at - 20, 20)[:16])
        if mark != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        end = file.read(there, 56)
        if end[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory")
        count, size, offset = struct.unpack_from("<QQQ", end, 32)
    raw, members, p = file.read(offset, size), {}, 0
    for _ in range(count):
        mark, method, packed, plain, n, m, k, header = struct.unpack_from("<4s6xH8xIIHHH8xI", raw, p)
        if mark != b"PK\1\2":
            raise ValueError("broken central directory")
        extra, q = raw[p + 46 + n : p + 46 + n + m], 0
        while q + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, q)
            if kind == 1:  # eight bytes for each field that is full, in this order
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, q + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            q += 4 + length
        members[raw[p + 46 : p + 46 + n].decode()] = (method, header, packed)
        p += 46 + n + m + k
    return members


def stored_at(file: Window, member: tuple[int, int, int]) -> tuple[int, int]:
    """Where the bytes of a stored member lie: (offset, length)."""
    method, header, size = member
    if method != 0:
        raise ValueError("member is compressed; only stored ones can be read by range")
    mark, n, m = struct.unpack("<4s22xHH", file.read(header, 30))
    if mark != b"PK\3\4":
        raise ValueError("no local header")
    return header + 30 + n + m, size


def with_digests(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest and first: the smallest page_id of the pages with an equal payload of at
    least so many bytes, null if there is no other."""
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256))
    groups = base.filter(F.length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = cut(groups.filter("n > 1 and first is not null").select("digest", "first"))
    if groups.limit(DUPLICATES + 1).count() <= DUPLICATES:
        return base.join(F.broadcast(groups), "digest", "left")
    # One payload may fill a third of the pages: its rows are dealt over salts.
    salts = 32
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return base.withColumn("salt", F.pmod(F.hash("page_id"), F.lit(salts))).join(salted, ["digest", "salt"], "left").drop("salt")


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns the archives: path, bytes, records.

    A null html is an empty payload, a null url has no target URI, a null page_id an id of its own that never is
    the first of a group. Of equal payloads of at least ``least`` bytes, rows with the smallest page_id are
    responses (all of them, if it repeats), others revisits of it. An empty table writes no archive. A task that
    is repeated writes the same files again under the same names, each moved into place when whole."""
    rows = with_digests(pages, least).select("page_id", "url", "payload", "digest", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        data, index, number = [], [], 0
        fs, base = filesystem(folder)

        def flush() -> pa.RecordBatch:
            name = f"{base}/part-{part:06d}-{number:04d}.wacz"
            with fs.open_output_stream(f"{name}.{attempt}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                for member, content in ((DATA, b"".join(data)), (INDEX, "".join(index).encode())):
                    z.writestr(zipfile.ZipInfo(member, (2024, 1, 1, 0, 0, 0)), content)
            fs.move(f"{name}.{attempt}", name)
            uri = f"{folder}/part-{part:06d}-{number:04d}.wacz"
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([fs.get_file_info(name).size]), pa.array([len(index)], pa.int64())], names=["archive", "bytes", "records"])

        size, stamp = 0, datetime.fromisoformat(DATE).astimezone(timezone.utc).strftime("%Y%m%d%H%M%S")
        for b in batches:
            for page_id, url, payload, digest, first in zip(*(c for c in b.columns)):
                page_id, url, payload, digest, first = (x.as_py() for x in (page_id, url, payload, digest, first))
                record = gzip.compress(warc_record(page_id, url, payload, digest, first, first is not None and page_id != first), 5, mtime=0)
                index.append(f"{header_value(url or '-')} {stamp} {json.dumps({'offset': size, 'length': len(record), 'filename': DATA, 'digest': digest})}\n")
                data.append(record)
                size += len(record)
                if size >= archive_bytes:
                    yield flush()
                    data, index, size, number = [], [], 0, number + 1
        if index:
            yield flush()

    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)
    return cut(rows.mapInArrow(run, ARCHIVES))


def locate(archives: DataFrame) -> DataFrame:
    """The place of every record that the indexes of archives (column archive) list: archive, offset, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, base = filesystem(path)
                with fs.open_input_file(base) as f:
                    file = Window(f)
                    members = central_directory(file)
                    start = {}
                    for line in file.read(*stored_at(file, members[INDEX])).decode().splitlines():
                        entry = json.loads(line.split(" ", 2)[2])
                        name = entry["filename"]
                        if name not in start:
                            start[name] = stored_at(file, members[name])[0]
                        entry["at"] = start[name] + int(entry["offset"])
                        start.setdefault("", []).append((path, entry["at"], int(entry["length"])))
                if rows := start.get(""):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["archive", "offset", "length"])

    return archives.select("archive").mapInArrow(run, LOCATORS)


def read_records(locators: DataFrame, keep_payload: bool = True) -> DataFrame:
    """The records at given places: page_id, url, record_type, payload_digest, payload_bytes, refers_to and, if
    asked for, payload (null for revisits). A payload that doesn't fit its digest is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple = ("", None)
        for b in batches:
            rows = []
            for path, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if path != opened[0]:
                    if opened[1]:
                        opened[1].file.close()
                    fs, base = filesystem(path)
                    opened = (path, Window(fs.open_input_file(base)))
                row = parse_record(gzip.decompress(opened[1].read(offset, length)))
                rows.append(row if keep_payload else (*row[:-1], None))
                if len(rows) >= 500:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), RECORDS)], names=[n for n, _ in RECORDS])

    return locators.mapInArrow(run, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def op3_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    archives = write_archives(read(spark, sf_dir, "pages"), folder)
    places = cut(locate(archives)).repartition(max(spark.sparkContext.defaultParallelism, 1) * 2, "archive", F.floor(F.col("offset") / 4_000_000))
    return read_records(places.sortWithinPartitions("archive", "offset"), keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op3_warc_archives": op3_warc_archives}
SQL = {
    "op3_warc_archives": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM g
"""
}
