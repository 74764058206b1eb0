"""Fingerprints against plain loops; rows of one id and rows without an id over many ranges."""

import hashlib
import math

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import fingerprint
from quarry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_counts(data: bytes) -> list[int]:
    """Each window of five bytes gives its first byte with every two of the next ones; at the end, what is left of them. Hashed in plain integers."""
    counts = [0] * 128
    if not data:
        return counts
    data = data.ljust(3, b"\0")
    mask = (1 << 32) - 1
    last = len(data) - 4 if len(data) > 4 else None
    for salt, (i, j, k) in enumerate(((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))):
        for at in range(last if last is not None else max(0, len(data) - k)):
            h = (data[at + i] * 0x9E3779B1 + data[at + j] * 0x85EBCA77 + data[at + k] * 0xC2B2AE3D + salt) & mask
            h ^= h >> 15
            h = h * 0x2C1B3C6D & mask
            counts[h >> 25] += 1
    return counts


def plain_codes(data: bytes) -> list[int]:
    counts = plain_counts(data)
    ordered = sorted(counts)
    return [sum(c > ordered[q] for q in (31, 63, 95)) for c in counts]


def plain_digest(text: str) -> str:
    data = text.encode()
    codes = plain_codes(data)
    out = f"{min(255, round(12 * math.log2(1 + len(data)))):02x}"
    for i in range(0, 128, 4):
        a, b, c, d = codes[i : i + 4]
        out += f"{a * 64 + b * 16 + c * 4 + d:02x}"
    return out


def plain_likeness(x: str, y: str) -> float:
    if plain_digest(x) == plain_digest(y):
        return 1.0
    a, b = plain_codes(x.encode()), plain_codes(y.encode())
    m, n = (int(plain_digest(t)[:2], 16) for t in (x, y))
    return max(0.0, 1 - (sum(abs(p - q) for p, q in zip(a, b, strict=True)) + min(64, 2 * abs(m - n))) / (sum(map(max, a, b)) + 64))


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=300), st.text(max_size=300))
def test_digest_and_likeness(x, y):
    assert fingerprint.digest(x) == plain_digest(x)
    assert fingerprint.likeness(fingerprint.digest(x), fingerprint.digest(y)) == pytest.approx(plain_likeness(x, y))


def test_whole_query(spark):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    want = {}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(t) // 3
        changed = t[: len(t) - n] + following[:n]
        want[i] = (len(t), hashlib.sha256(changed.encode()).hexdigest(), plain_digest(t), plain_digest(changed))
        if k % 10 == 0:
            want[i] += (plain_likeness(t, changed), plain_likeness(t, following))
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op1_fingerprints"](spark, SF).collect()}
    assert len(got) == len(rows)
    for i, w in want.items():
        assert got[i][:4] == w[:4] and got[i][4:][: len(w) - 4] == pytest.approx(w[4:])


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_hot_ids(spark, parts):
    """Half of all rows have no id, a third has one id: they are cut into ranges by their texts' hashes, and the order holds over all of them."""
    rows = [(None if i % 2 else 7 if i % 3 else i, f"text number {i} of the hot rows {i * i}", "k", 1) for i in range(240)] + [(7, "same", "k", 2)] * 3
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string, key string, range int")
        placed = fingerprint.beside_next(df).filter("not context").groupBy("range").count().collect()
        got = fingerprint.fingerprints(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    hashed = lambda t: ((h := xxhash.xxh64_intdigest(t.encode(), seed=42)) ^ (1 << 63)) - (1 << 63)
    ordered = sorted(((i, t) for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashed(r[1])), reverse=True)
    want = [(i, hashlib.sha256(fingerprint.edited(t, ordered[(k + 1) % len(ordered)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(ordered)]
    assert sorted(((r["doc_id"], r["edited_sha256"]) for r in got), key=str) == sorted(want, key=str)
    if parts == 40:
        assert max(r["count"] for r in placed) < 60


def test_long_text(spark):
    df = spark.createDataFrame([(1, "ab" * 1_500_000, 5), (2, "c", 6)], "doc_id long, text string, fingerprint int")
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(df).collect()}
    assert got[1]["n_chars"] == 3_000_000 and got[1]["fingerprint"] == fingerprint.digest("ab" * 1_500_000)
    assert df.filter(F.col("doc_id") == 2).count() == 1
