"""Byte-level BPE encoding and decoding by a rank file.

`encode_words` folds ranked merges over the bytes of a table of distinct words, in Spark's
higher-order functions with a literal rank map. `encode` encodes whole texts in Arrow batches with
the same rank file, and decoding concatenates the ids' byte pieces. The query takes the second
form; README gives the figures that rule the first one out for whole corpora.

Null and empty texts have no ids. Repeated rows are encoded alike, each on its own. Texts may be of any length; runs
of white space that are too long for the library's pattern matcher are split off first. Other columns of the input
are not looked at, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from functools import lru_cache

import numpy as np
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_rows

#: Runs of white space (Unicode's) that the library's matcher isn't given: it recurses once a character.
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{20000,}")


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte piece -> rank of a rank file: a base64 piece and a number a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, filter(bytes.strip, lines))}


@lru_cache(2)
def _ranks(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    ranks = read_ranks(path)
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return ranks, pieces


class Encoder:
    """Encodes and decodes with one rank file."""

    def __init__(self, path: str, pattern: str):
        ranks, self.pieces = _ranks(path)
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers.

        The pattern takes a run of white space whole at the text's end, else all but its last character.
        """
        ids: list[int] = []
        at = 0
        for run in _LONG_RUN.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += self.bpe.encode_ordinary(text[at : run.start()])
            ids += self.bpe._encode_single_piece(text[run.start() : end])
            at = end
        return np.array(ids + self.bpe.encode_ordinary(text[at:]), "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


SCHEMA = "doc_id long, ids binary, decoded binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and the bytes that they decode to, for every whole text."""

    def start():
        encoder = Encoder(path, pattern)

        def f(doc_ids, texts):
            ids = [encoder.encode(t or "") for t in texts]
            return {"doc_id": doc_ids, "ids": ids, "decoded": [encoder.decode(x) for x in ids]}

        return f

    return map_rows(docs, [F.col("doc_id").cast("long"), F.col("text")], SCHEMA, start)


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """As encode, with counts and digests in place of the bytes: these need not leave the worker."""

    def start():
        encoder = Encoder(path, pattern)

        def f(doc_ids, texts):
            ids = [encoder.encode(t or "") for t in texts]
            return {"doc_id": doc_ids, "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids]}

        return f

    return map_rows(docs, [F.col("doc_id").cast("long"), F.col("text")], DIGESTS, start)


def rank_map(path: str, slots: int = 65536) -> Column:
    """The rank file as a literal: an array of small maps from hex digits to rank, placed by crc32."""
    maps: list[dict[str, int]] = [{} for _ in range(slots)]
    for piece, rank in read_ranks(path).items():
        digits = piece.hex().upper()
        maps[zlib.crc32(digits.encode()) % slots][digits] = rank
    return F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), "array<map<string,int>>")


def encode_words(words: DataFrame, path: str, column: str = "word") -> DataFrame:
    """word -> ids of a table of distinct words, by a fold in higher-order functions; for vocabularies of short words."""
    slots, none = 65536, 2**31 - 1
    table = rank_map(path, slots)
    rank = lambda h: F.element_at(F.get(table, F.pmod(F.crc32(h.cast("binary")), F.lit(slots)).cast("int")), h)

    def step(parts: Column, _: Column) -> Column:
        pair = lambda i: F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))
        low = F.array_min(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(F.coalesce(rank(pair(i)), F.lit(none)).alias("rank"), i.alias("i"))))
        joined = lambda b: F.when(b["rank"] == none, parts).otherwise(F.concat(F.slice(parts, 1, b["i"] - 1), F.array(pair(b["i"])), F.slice(parts, b["i"] + 2, F.size(parts))))
        return F.when(F.size(parts) < 2, parts).otherwise(F.element_at(F.transform(F.array(low), joined), 1))

    digits = F.hex(F.col(column).cast("binary"))
    n = F.octet_length(F.col(column))
    byte = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(digits, i * 2 - 1, F.lit(2)))
    parts = F.when(n < 2, byte).when(rank(digits).isNotNull(), F.array(digits)).otherwise(F.aggregate(F.sequence(F.lit(2), n), byte, step))
    return words.select(column, F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(parts, rank)).alias("ids"))


def vocabulary(texts: DataFrame, pattern: str, column: str = "text") -> DataFrame:
    """The distinct words of all texts."""
    return texts.select(F.explode(F.regexp_extract_all(F.col(column), F.lit("(?U)(" + pattern + ")"))).alias("word")).distinct()
