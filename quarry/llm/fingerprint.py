"""Document fingerprints: quartile bucket digests of hashed byte triplets.

Triplets of bytes from a sliding window are hashed into buckets and counted. A bucket's code says
between which quartiles of all counts its own lies; the digest holds the text's length on a
logarithmic scale and two bits a bucket. Two digests are compared by how far their codes lie apart,
as a share of how far they could: a score between 0 (nothing shared) and 1 (equal codes).

Null texts count as empty; texts of under three bytes are padded by zero bytes, and empty texts
have the digest of no triplets, which is like itself only. Documents follow each other by
descending id, nulls last, equal ids by descending hash of the text; repeated rows keep a row each.
A single document is its own next one. Texts may be of any length. Other columns of the input are not looked at, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BUCKETS = 128
#: Which bytes of a five-byte window make a triplet.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
_CHUNK = 1 << 20
#: Bytes of input for which the texts are dealt to one more range, and how many ranges there are at most.
RANGE_BYTES, MOST_RANGES = 128 << 20, 50_000
_FACTORS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def bucket_counts(data: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """How many of the text's triplets fall in each bucket; long texts are taken in pieces that overlap."""
    counts = np.zeros(buckets, np.int64)
    if not data:
        return counts
    data = data.ljust(3, b"\0")
    shift = np.uint32(32 - buckets.bit_length() + 1)
    for at in range(0, max(len(data) - 4, 1), _CHUNK):
        part = np.frombuffer(data[at : at + _CHUNK + 4], np.uint8).astype(np.uint32)
        scaled = [part * x for x in _FACTORS]
        starts = len(part) - 4 if len(part) > 4 else 0
        for salt, (i, j, k) in enumerate(TRIPLETS):
            n = starts or len(part) - k
            if n > 0:
                h = scaled[0][i : i + n] + scaled[1][j : j + n] + scaled[2][k : k + n] + np.uint32(salt)
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x2C1B3C6D)
                counts += np.bincount(h >> shift, minlength=buckets)
    return counts


def digest(text: str, buckets: int = BUCKETS) -> str:
    """Two hex digits of length, then four buckets' codes in every two digits."""
    data = text.encode("utf-8", "surrogatepass")
    counts = bucket_counts(data, buckets)
    ordered = np.sort(counts)
    quartiles = ordered[[buckets // 4 - 1, buckets // 2 - 1, 3 * buckets // 4 - 1]]
    codes = (counts[:, None] > quartiles).sum(1).astype(np.uint8).reshape(-1, 4)
    packed = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    length = min(255, round(12 * np.log2(1 + len(data))))
    return f"{length:02x}" + packed.astype(np.uint8).tobytes().hex()


def _codes(fingerprint: str) -> tuple[int, np.ndarray]:
    packed = np.frombuffer(bytes.fromhex(fingerprint[2:]), np.uint8)
    return int(fingerprint[:2], 16), np.stack([packed >> 6, packed >> 4 & 3, packed >> 2 & 3, packed & 3], 1).ravel().astype(np.int16)


def likeness(a: str, b: str) -> float:
    """1 less the bounded difference of two digests: 1 for equal ones, 0 at most apart."""
    if a == b:
        return 1.0
    (m, x), (n, y) = _codes(a), _codes(b)
    most = int(np.maximum(x, y).sum()) + 64
    # a twelfth of a doubling a step: lengths add their own part, which is bounded too
    apart = int(np.abs(x - y).sum()) + min(64, 2 * abs(m - n))
    return max(0.0, 1.0 - apart / most)


def edited(text: str, following: str) -> str:
    """The last third's code points replaced by the first as many, or all, of another text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


KEY = "struct<known:int,id:bigint,hash:bigint>"


def _literal(values: list, kind: str) -> Column:
    """An array literal; Spark folds it once."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _range_of(bounds: list[tuple[int, int, int]]) -> Column:
    """The number of bounds below a row's key, by binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    array, step, steps = _literal([dict(zip(("known", "id", "hash"), b, strict=True)) for b in bounds], KEY), 1, []
    while step <= len(bounds):
        steps.insert(0, step)
        step *= 2
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, s: F.when((low + s <= len(bounds)) & (F.get(array, low + s - 1) < F.col("key")), low + s).otherwise(low))


def _bounds(rows: DataFrame, parts: int) -> list[tuple[int, int, int]]:
    """Keys that cut rows into about so many equal ranges. An id with the rows of several ranges, or the rows without one, are cut by the texts' hashes."""
    total, known = rows.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    share = round(parts * (total - known) / max(total, 1))
    found = Counter(int(x) for x in rows.select("doc_id").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)) if parts > 1 else {}
    inside = lambda n: [-(1 << 63) + i * ((1 << 64) // n) for i in range(1, n)]
    out = [(0, 0, h) for h in inside(share)] + [(0, 0, (1 << 63) - 1)] * (share > 0)
    for v, n in sorted(found.items()):
        out += [(1, v, h) for h in inside(n)] + [(1, v, (1 << 63) - 1)]
    return out


def beside_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, text, range, context: each range's rows by descending id, then the row that follows its last one.

    One shuffle of the texts. There is a range for so many bytes of input, and for each shuffle partition at least;
    only each range's highest row goes to two ranges.
    """
    spark = docs.sparkSession
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    size = 0 if size >= 1 << 60 else size  # Spark's guess for inputs of unknown size
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, size // range_bytes))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.struct(F.col("doc_id").isNotNull().cast("int").alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("hash"))
    bounds = _bounds(rows, parts)
    placed = rows.withColumn("key", key).withColumn("range", _range_of(bounds))
    tops = {r["range"]: r["top"] for r in placed.groupBy("range").agg(F.max("key").alias("top")).collect()}
    if not tops:
        return placed.select("doc_id", "text", "range", F.lit(False).alias("context"))
    order = sorted(tops)
    target = dict(zip(order, order[1:] + order[:1], strict=True))
    span = range(order[-1] + 1)
    top_of = F.get(_literal([tops[i].asDict() if i in tops else None for i in span], KEY), F.col("range"))
    goes_to = F.get(_literal([target.get(i) for i in span], "int"), F.col("range"))
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("context"))
    places = F.when(F.col("key").eqNullSafe(top_of), F.array(own, F.struct(goes_to.alias("range"), F.lit(True).alias("context")))).otherwise(F.array(own))
    dealt = placed.withColumn("place", F.explode(places)).select("doc_id", "text", "key", "place.range", "place.context")
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("range").cast("int")).sortWithinPartitions("range", "context", F.col("key").desc(), "text")
    return dealt.select("doc_id", "text", "range", "context")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The digest of every whole text and of its edited text, and both likenesses."""
    out = StructType.fromDDL(SCHEMA)
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next one is still to come
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                made = []
                for doc_id, text, place, context in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True):
                    if context and (held is None or held[2] != place):
                        continue
                    own = digest(text)
                    if held is not None and held[2] == place:
                        before, was, _, print_ = held
                        changed = edited(was, text)
                        other = digest(changed)
                        sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                        made.append((before, len(was), sha, print_, other, likeness(print_, other), likeness(print_, own)))
                    held = None if context else (doc_id, text, place, own)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*made, strict=True) if made else [[]] * len(schema), schema, strict=True)], schema=schema)

    return beside_next(docs).mapInArrow(run, out)
