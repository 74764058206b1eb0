"""WARC archives as a Python data source: format "warc", for batch reads and writes.

Writing makes one gzip member a record, files of about `file_mb`, and a manifest once all tasks
have committed, so that files of lost or repeated attempts are never read. Each member's
extra field says how long it is (the "sl" field that the WARC standard describes).
Reading plans a partition a file. A record's headers are parsed first, from the first bytes of its
member; record-type and header predicates that Spark pushes down are applied to them, and the rest
of a member that isn't wanted is neither read nor inflated. Option payload=false skips all payloads.
Members without that field and plain archives are read too.

Null values leave their header out, a null payload is empty. Control characters in header values
are percent-encoded. Empty tables make a manifest without files. Other columns of the input are not
written, whatever their names; repeated rows make a record each. Payloads may be as long as a binary value;
members too long for the extra field go without it. Python workers have no Hadoop, so files are opened
through pyarrow's file systems by the path's scheme: local files, hdfs and viewfs, s3 (also as s3a and s3n),
gs, abfs and abfss; any other scheme is an error that says so.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

MANIFEST = "_manifest.json"
#: Column -> header of what is read and may be pushed down.
HEADERS = {
    "warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "payload_bytes": "Payload-Length", "refers_to": "WARC-Refers-To",
}
SCHEMA = "warc_type string, record_id string, target_uri string, warc_date string, payload_digest string, payload_bytes long, refers_to string, payload binary"
ARROW = pa.schema([(c, pa.int64() if c == "payload_bytes" else pa.binary() if c == "payload" else pa.string()) for c in [*HEADERS, "payload"]])
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD = 4096
#: What the extra field's numbers are below.
MOST_FIELD = 1 << 32
_WINDOW = 1 << 22


#: Hadoop's names of schemes that pyarrow has under another one.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), os.path.abspath(path)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    try:
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise ValueError(f"WARC files can't be opened at {path}: pyarrow has no file system for {scheme}:") from e


def _plain(value: object) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in str(value))


def record(row: dict) -> bytes:
    """A whole record, not compressed: headers, then an HTTP block; revisits have no payload in it."""
    payload = row.get("payload") or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    revisit = row["warc_type"] == "revisit"
    block = http if revisit else http + payload
    lines = ["WARC/1.1"]
    for column, header in HEADERS.items():
        if (value := row.get(column)) is not None:
            lines.append(f"{header}: {_plain(value)}")
    if revisit:
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field holds its own length and that of the data."""
    squeezer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeezer.compress(data) + squeezer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    fits = max(size, len(data)) < MOST_FIELD
    extra = struct.pack("<H2sHII", 12, b"sl", 8, size, len(data)) if fits else b""
    return b"\x1f\x8b\x08" + (b"\x04" if fits else b"\0") + b"\0\0\0\0\0\xff" + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.limit, self.overwrite = options["path"], int(float(options.get("file_mb", 64)) * 1e6), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = open_fs(self.path)
        system.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    if out is None:
                        files.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = system.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                    size += out.write(made := member(record(row))) or len(made)
                    if size >= self.limit:
                        out.close()
                        out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = open_fs(self.path)
        system.create_dir(root, recursive=True)
        files = sorted(f for m in messages if m for f in m.files)
        if not self.overwrite and system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_stream(f"{root}/{MANIFEST}") as f:
                files = json.loads(f.read()) + files
        with system.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps(files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, root = open_fs(self.path)
        for name in (f for m in messages if m for f in m.files):
            system.delete_file(f"{root}/{name}")


@dataclass
class Archive(InputPartition):
    path: str


class _Window:
    """Ranges of a file, read some megabytes at a time."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.at, self.data = file, file.size(), 0, b""

    def get(self, start: int, n: int) -> bytes:
        n = min(n, self.size - start)
        if start < self.at or start + n > self.at + len(self.data):
            self.at, self.data = start, self.file.read_at(min(max(n, _WINDOW), self.size - start), start)
        return self.data[start - self.at : start - self.at + n]


def _parsed(head: bytes) -> tuple[dict[str, str], int] | None:
    """Headers and where the block starts; None if the headers go on."""
    if (end := head.find(b"\r\n\r\n")) < 0:
        return None
    lines = head[:end].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


def records(file: pa.NativeFile, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers, and the block of those records for which wanted(headers) is true."""
    view, at = _Window(file), 0
    while at < view.size:
        start = view.get(at, _HEAD)
        if start[:2] != b"\x1f\x8b":  # plain
            if not start.strip(b"\r\n"):
                at += len(start)
                continue
            skip = len(start) - len(start.lstrip(b"\r\n"))
            at, n = at + skip, _HEAD
            while (found := _parsed(view.get(at, n))) is None:
                if at + n >= view.size:
                    return
                n *= 2
            headers, body = found
            length = int(headers.get("content-length", 0))
            yield headers, view.get(at + body, length) if wanted(headers) else None
            at += body + length + 4
            continue
        known = struct.unpack("<I", start[16:20])[0] if len(start) >= 24 and start[3] & 4 and start[12:14] == b"sl" else 0
        inflate, text, pos, n = zlib.decompressobj(31), b"", at, _HEAD
        while (found := _parsed(text)) is None and pos < view.size and not inflate.eof:
            data = view.get(pos, n)
            pos += len(data)
            text += inflate.decompress(data, 0)
        if found is None:
            return
        headers, body = found
        if (want := wanted(headers)) or not known:  # without a length, an unwanted member is inflated for its end, piece by piece
            parts = [text]
            while not inflate.eof and pos < view.size:
                data = view.get(pos, _WINDOW if not known else max(1, at + known - pos))
                pos += len(data)
                if want:
                    parts.append(inflate.decompress(data))
                    continue
                while data and not inflate.eof:
                    inflate.decompress(data, _WINDOW)
                    data = inflate.unconsumed_tail
            text = b"".join(parts)
        yield headers, text[body : body + int(headers.get("content-length", 0))] if want else None
        at = at + known if known else pos - len(inflate.unused_data)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], str(options.get("payload", "true")).lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Takes equality, IN, prefix and not-null predicates on header columns; leaves the rest to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if column in HEADERS and isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)):
                values = f.value if isinstance(f, In) else [getattr(f, "value", None)]
                self.tests.append((column, type(f).__name__, [str(v) for v in values if v is not None]))
            else:
                yield f

    def partitions(self) -> list[Archive]:
        system, root = open_fs(self.path)
        if system.get_file_info(root).type == fs.FileType.File:
            return [Archive(root)]
        if system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_stream(f"{root}/{MANIFEST}") as f:
                return [Archive(f"{root}/{x}") for x in json.loads(f.read())]
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        return [Archive(x.path) for x in found if x.path.endswith((".warc", ".warc.gz"))]

    def _wanted(self, headers: dict[str, str]) -> bool:
        for column, kind, values in self.tests:
            value = headers.get(HEADERS[column].lower())
            if value is None or kind in ("EqualTo", "In") and value not in values or kind == "StringStartsWith" and not value.startswith(values[0]):
                return False
        return True

    def read(self, partition: Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, _ = open_fs(self.path)
        rows: list[dict] = []
        held = 0
        keep = lambda h: self.payload and self._wanted(h)
        with system.open_input_file(partition.path) as file:
            for headers, block in records(file, keep):
                if not self._wanted(headers):
                    continue
                row: dict = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
                row["payload_bytes"] = int(row["payload_bytes"]) if row["payload_bytes"] else None
                row["payload"] = None
                if block is not None and row["warc_type"] != "revisit":
                    http = block.startswith(b"HTTP/")
                    row["payload"] = block[block.find(b"\r\n\r\n") + 4 :] if http else block
                    held += len(row["payload"])
                rows.append(row)
                if len(rows) >= 2000 or held > 1 << 23:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session. Pushdown to Python sources is switched on unless the session says otherwise."""
    spark.dataSource.register(WarcDataSource)
    if "spark.sql.python.filterPushdown.enabled" not in spark.conf.getAll:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_warc(rows: DataFrame, path: str) -> None:
    """rows: columns of SCHEMA, payload binary; any may be missing."""
    register(rows.sparkSession)
    rows.write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def as_records(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """A record for each of pages (page_id, url, html): equal payloads of least_bytes or more are revisits of the smallest id.

    A null id is never the smallest; rows that repeat the smallest id are responses too. Only payloads with
    copies are joined back, once each; a payload that a third of all rows have is a skewed key of that join alone, which adaptive execution splits.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    firsts = rows.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").drop("n")
    rows = rows.join(firsts, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return rows.select(
        F.when(again, "revisit").otherwise("response").alias("warc_type"), name(F.col("page_id")).alias("record_id"), F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("warc_date"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.col("bytes").alias("payload_bytes"), F.when(again, name(F.col("first"))).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"),
    )


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """What the archives hold of each page: responses are measured anew, revisits by their headers, whose payloads are never inflated."""
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]*)>', 1) as bigint)")
    full = read_warc(spark, path).filter(F.col("warc_type") == "response")
    full = full.select(page("record_id").alias("page_id"), F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), F.col("warc_type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    again = read_warc(spark, path, payload=False).filter(F.col("warc_type") == "revisit")
    again = again.select(page("record_id").alias("page_id"), "payload_bytes", F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"))
    return full.unionByName(again)
