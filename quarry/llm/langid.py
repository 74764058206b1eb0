"""Language ID: string-kernel classification with Nystroem landmarks and kernel ridge regression.

The kernel of two texts is the number of n-grams of one to three code points that both have (each
counts once: a blended-spectrum presence kernel), over the geometric mean of their own numbers.
n-grams are hashed into a fixed number of slots. A few landmark texts stand for the kernel's space;
one-versus-rest ridge regression is fitted in it. Batches are scored by two matrix products.

Fitting takes about `per_language` texts of each language, chosen by a hash of the id, and fewer where there
are so many languages that these would be more than `most_rows`; every language with a text that has a
letter is learned, however many there are. Landmarks grow with the languages. Only the sample's
packed presence bits (one KB each) and languages reach the driver.

A text that is null or has no letter (Unicode's categories L) is `und` with score 0; so is every text if there is
nothing to learn from. Rows without a language or a letter aren't learned from. Repeated rows are scored alike. Long
texts are read whole, in pieces. Other columns of the input are not looked at, whatever their names. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_rows, unit

SLOTS = 8192
LENGTHS = (1, 2, 3)
PER_LANGUAGE, MOST_ROWS = 500, 20_000
#: Landmarks at least, and at most: two a language between them.
LANDMARKS, MOST_LANDMARKS = 256, 2048
RIDGE = 1e-3
UNKNOWN = "und"
#: Shares of so many languages are broadcast at most (a few MB); more are joined by a shuffle.
BROADCAST_LANGUAGES = 50_000
_PIECE = 1 << 20
_BLOCK = 1024


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def presence(text: str) -> np.ndarray:
    """Which slots the text's n-grams fall into; texts are lower-cased, long ones taken in overlapping pieces."""
    out = np.zeros(SLOTS, bool)
    low, shift = text.lower(), np.uint32(32 - SLOTS.bit_length() + 1)
    for at in range(0, len(low), _PIECE):
        points = np.frombuffer(low[at : at + _PIECE + max(LENGTHS) - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        rolled, length = points, 1
        for want in LENGTHS:
            while length < want and len(rolled) > 1:
                rolled = rolled[:-1] * np.uint32(0x01000193) + points[length:]
                length += 1
            if length == want:
                out[(rolled * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15 * want & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B) >> shift] = True
    return out


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # packed bits, a row each
    weights: np.ndarray  # landmark x language
    bias: np.ndarray

    def scorer(self):
        """A function from presence rows (n x SLOTS) to decisions (n x languages)."""
        marks = np.unpackbits(self.landmarks, axis=1)[:, :SLOTS].astype(np.float32)
        norms = np.sqrt(np.maximum(marks.sum(1), 1))
        turned = np.ascontiguousarray(marks.T)

        def f(rows: np.ndarray) -> np.ndarray:
            rows = rows.astype(np.float32)
            kernel = rows @ turned / norms / np.sqrt(np.maximum(rows.sum(1), 1))[:, None]
            return kernel @ self.weights + self.bias

        return f


def fit_rows(languages: list[str], bits: np.ndarray, landmarks: int | None = None, ridge: float = RIDGE) -> Model | None:
    """One-versus-rest kernel ridge regression in the space of the landmarks. Rows of packed bits come in a fixed order."""
    names = sorted(set(languages))
    if not names:
        return None
    number = {name: i for i, name in enumerate(names)}
    label = np.array([number[name] for name in languages])
    seen: dict[str, int] = {}
    turn = []
    for name in languages:  # landmarks take turns among languages
        seen[name] = seen.get(name, -1) + 1
        turn.append(seen[name])
    chosen = np.argsort(np.array(turn), kind="stable")[: landmarks or min(MOST_LANDMARKS, max(LANDMARKS, 2 * len(names)))]
    marks = np.unpackbits(bits[chosen], axis=1)[:, :SLOTS].astype(np.float32)
    mark_norms, kernel = np.sqrt(np.maximum(marks.sum(1), 1)), np.empty((len(bits), len(chosen)))
    for at in range(0, len(bits), _BLOCK):
        x = np.unpackbits(bits[at : at + _BLOCK], axis=1)[:, :SLOTS].astype(np.float32)
        kernel[at : at + _BLOCK] = x @ marks.T / np.sqrt(np.maximum(x.sum(1), 1))[:, None] / mark_norms
    values, vectors = np.linalg.eigh(kernel[chosen])
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    mapped = kernel @ root
    target = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = 1 / np.bincount(label)[label]
    weight *= len(weight) / weight.sum()
    bias = (target * weight[:, None]).mean(0)
    left = (mapped * weight[:, None]).T @ mapped + ridge * len(languages) * np.eye(mapped.shape[1])
    beta = np.linalg.solve(left, (mapped * weight[:, None]).T @ (target - bias))
    return Model(names, bits[chosen], (root @ beta).astype(np.float32), bias.astype(np.float32))


def fit(train: DataFrame, per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> Model | None:
    """train: doc_id, text, lang. A language with more texts than its share of the sample gives that many, about, by hash of the id."""
    train = train.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    train = train.withColumn("place", unit("doc_id", "langid"))
    counts = train.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.min("place").alias("first"))
    languages = counts.count()
    if not languages:
        return None
    each = max(1, min(per_language, most_rows // languages))
    shares = counts.select("lang", F.least(F.lit(1.0), each / F.col("texts")).alias("share"), "first")
    sample = train.join(F.broadcast(shares) if languages <= BROADCAST_LANGUAGES else shares, "lang").filter((F.col("place") < F.col("share")) | (F.col("place") == F.col("first")))

    def start():
        def f(ids, langs, texts):
            keep = [has_letter(t) for t in texts]
            return {"doc_id": [i for i, k in zip(ids, keep, strict=True) if k], "lang": [x for x, k in zip(langs, keep, strict=True) if k], "bits": [np.packbits(presence(t)).tobytes() for t, k in zip(texts, keep, strict=True) if k]}

        return f

    rows = map_rows(sample, [F.col("doc_id"), F.col("lang"), F.col("text")], "doc_id long, lang string, bits binary", start).distinct().collect()
    rows.sort(key=lambda r: (str(r["doc_id"]).zfill(20)[::-1], r["lang"], bytes(r["bits"])))
    if not rows:
        return None
    return fit_rows([r["lang"] for r in rows], np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(rows), -1))


def judge(texts: list[str | None], model: Model | None, scorer) -> tuple[list[str], list[float]]:
    """Languages and scores of a batch: a score is the winner's share of the decisions' soft maximum."""
    known = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if known:
        made = scorer(np.stack([presence(texts[i]) for i in known]))
        best = made.argmax(1)
        sure = 1 / np.exp(4 * (made - made.max(1, keepdims=True))).sum(1)
        for i, b, s in zip(known, best, sure, strict=True):
            langs[i], scores[i] = model.languages[b], float(min(1.0, max(0.0, s)))
    return langs, scores


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""

    def start():
        scorer = model and model.scorer()

        def f(ids, texts):
            langs, scores = judge(texts, model, scorer)
            return {"doc_id": ids, "lang_pred": langs, "score": scores}

        return f

    return map_rows(docs, [F.col("doc_id").cast("long"), F.col("text")], "doc_id long, lang_pred string, score double", start, rows=256)


def language_column(text: Column, model: Model | None) -> Column:
    """The predicted language beside a document's other columns."""

    @F.arrow_udf("string")
    def languages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = model and model.scorer()
        for batch in batches:
            made = [x for at in range(0, len(batch), 256) for x in judge(batch.slice(at, 256).to_pylist(), model, scorer)[0]]
            yield pa.array(made, pa.string())

    return languages(text)
