"""WARC: schemes, members without a length, clashing columns, long payloads."""

import gzip
import os

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from quarry.llm import warc


def test_schemes(monkeypatch):
    asked = []
    monkeypatch.setattr(warc, "fs", type("Fs", (), {"LocalFileSystem": fs.LocalFileSystem, "FileSystem": type("System", (), {"from_uri": staticmethod(lambda uri: asked.append(uri) or (None, uri))})}))
    for uri in ("s3a://bucket/a", "s3n://bucket/a", "hdfs://host/a", "abfss://c@host/a"):
        warc.open_fs(uri)
    assert asked == ["s3://bucket/a", "s3://bucket/a", "hdfs://host/a", "abfss://c@host/a"]
    assert [warc.open_fs(p)[1] for p in ("file:/a/b", "file:///a/b", "/a/b", "a:b/c"[2:])] == ["/a/b", "/a/b", "/a/b", os.path.abspath("b/c")]


def test_unknown_scheme():
    with pytest.raises(ValueError, match="nosuch"):
        warc.open_fs("nosuch://host/a")


def test_members_without_length(spark, tmp_path, monkeypatch):
    """Unwanted members are passed by in pieces; what is too long for the extra field is written without it."""
    monkeypatch.setattr(warc, "_WINDOW", 1 << 12)
    rows = [{"warc_type": k, "record_id": k, "payload": os.urandom(n)} for k, n in (("a", 300_000), ("b", 5), ("c", 70_000))]
    made = b"".join(gzip.compress(warc.record(r)) for r in rows)
    (tmp_path / "x.warc.gz").write_bytes(made)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "x.warc.gz")) as f:
        assert [(h["warc-record-id"], b is not None) for h, b in warc.records(f, lambda h: h["warc-type"] == "c")] == [("a", False), ("b", False), ("c", True)]
    monkeypatch.setattr(warc, "MOST_FIELD", 10_000)
    made = b"".join(warc.member(warc.record(r)) for r in rows)
    assert gzip.decompress(made) == b"".join(map(warc.record, rows))
    (tmp_path / "y.warc.gz").write_bytes(made)
    got = warc.read_warc(spark, f"{tmp_path}/y.warc.gz").collect()
    assert [(r["record_id"], r["payload"]) for r in got] == [(r["record_id"], r["payload"]) for r in rows]


def test_clashing_columns_and_long_pages(spark, tmp_path):
    rows = [(1, "u", "x" * 3_000_000, "d", 5, "f"), (2, "u", "x" * 3_000_000, "e", 6, "g"), (3, "u", "é" * 60, "d", 7, "h"), (3, "u", "é" * 60, "d", 7, "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, bytes long, first string")
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.as_records(pages), path)
    got = sorted(tuple(r)[:2] + (r["record_type"], r["refers_to"]) for r in warc.read_back(spark, path).collect())
    assert got == [(1, 3_000_000, "response", None), (2, 3_000_000, "revisit", 1), (3, 120, "response", None), (3, 120, "response", None)]
    assert warc.read_warc(spark, path).filter(F.col("warc_type") == "revisit").select("payload").first()[0] is None
