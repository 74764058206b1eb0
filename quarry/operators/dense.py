"""Dense search: exact top-k, metadata predicates, neighbours, pools and diversity.

vectors: gid, vector and whatever payload; questions: query_id, vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Questions that are sent to the tasks at once, a few MB; more are taken in turns of about as many.
BLOCK = 16_384
#: Questions and vectors whose products are held at once.
QUESTIONS, VECTORS = 1024, 1024


def predicate(section_in: list[str] | None = None, paper_id_in: list[str] | None = None, strict: bool = False, **equal) -> Column:
    """Equal values are all asked for; of the two lists one is enough unless strict. An empty list asks for nothing."""
    lists = [F.col(c).isin(v) for c, v in (("section", section_in), ("paper_id", paper_id_in)) if v]
    out = F.lit(True)
    for c, v in equal.items():
        out = out & (F.col(c) == v)
    if lists:
        any_ = lists[0]
        for x in lists[1:]:
            any_ = (any_ & x) if strict else (any_ | x)
        out = out & any_
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row by score, then by id; columns are cut to those that may be among them first."""
    if scores.shape[1] > 2 * k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        may = (scores >= least[:, None]).any(0)
        ids, scores = ids[:, may], scores[:, may]
    top = np.lexsort((ids, -scores))[:, :k]
    return np.take_along_axis(ids, top, 1), np.take_along_axis(scores, top, 1)


def dense_topk(vectors: DataFrame, questions: DataFrame, k: int = 120, where: Column | None = None) -> DataFrame:
    """query_id, gid, score, pos: the k most alike by cosine of unit vectors, exactly.

    A block of questions meets all vectors, a small product at a time; each task holds its k best a question
    and passes them on once, at its end.
    """
    rows = (vectors.filter(where) if where is not None else vectors).select(F.col("gid").cast("long"), "vector")
    asked = questions.select(F.col("query_id").cast("long"), "vector")
    turns = max(1, -(-asked.count() // BLOCK))
    out = None
    for turn in range(turns):
        block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn).collect()
        ids = np.array([r["query_id"] for r in block], np.int64)
        matrix = np.array([r["vector"] for r in block], np.float64)

        def run(batches: Iterator[pa.RecordBatch], ids=ids, matrix=matrix) -> Iterator[pa.RecordBatch]:
            parts = [slice(at, at + QUESTIONS) for at in range(0, len(ids), QUESTIONS)]
            held = [(np.zeros((len(ids[p]), 0), np.int64), np.zeros((len(ids[p]), 0))) for p in parts]
            for batch in batches:
                for at in range(0, batch.num_rows, VECTORS):
                    piece = batch.slice(at, VECTORS)
                    gids = piece.column(0).to_numpy(zero_copy_only=False)
                    values = np.array(piece.column(1).to_pylist(), np.float64)
                    for i, p in enumerate(parts):
                        scores = np.round(matrix[p] @ values.T, 6) + 0.0
                        held[i] = _best(np.c_[held[i][0], np.broadcast_to(gids, scores.shape)], np.c_[held[i][1], scores], k)
            for p, (gids, scores) in zip(parts, held, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[p], gids.shape[1])), pa.array(gids.ravel()), pa.array(scores.ravel())], names=["query_id", "gid", "score"])

        part = rows.mapInArrow(run, "query_id long, gid long, score double")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "gid"))).filter(F.col("pos") <= k)


def candidates(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """query_id, gid, first: the union of both lists, dense hits first."""
    both = dense.select("query_id", "gid", F.col("pos").alias("first")).unionByName(lexical.select("query_id", "gid", (F.col("pos") + 1_000_000).alias("first")))
    return both.groupBy("query_id", "gid").agg(F.min("first").alias("first"))


def expand_neighbors(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """query_id, gid: hits and the text chunks of the same paper and section up to window places away: an equi-join per offset."""
    text = chunks.filter("chunk_type = 'text' and chunk_index >= 0")
    here = hits.join(text.select("gid", "paper_id", "section", "chunk_index"), "gid").withColumn("chunk_index", F.explode(F.array(*[F.col("chunk_index") + d for d in range(-window, window + 1) if d]) if window else F.array().cast("array<int>")))
    near = here.select("query_id", "paper_id", "section", "chunk_index").join(text.select("paper_id", "section", "chunk_index", "gid"), ["paper_id", "section", "chunk_index"]).select("query_id", "gid")
    return hits.select("query_id", "gid").unionByName(near).distinct()


def pool(candidates_: DataFrame, vectors: DataFrame, questions: DataFrame, top_k: int = 8) -> DataFrame:
    """query_id, gid, score, vector: candidates by cosine, at most max(25 top_k, 150) a question."""
    dot = F.aggregate(F.zip_with("vector", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    scored = candidates_.join(vectors.select("gid", "vector"), "gid").join(questions.select("query_id", F.col("vector").alias("q")), "query_id").select("query_id", "gid", F.round(dot, 6).alias("score"), "vector")
    return scored.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "gid"))).filter(F.col("pos") <= max(25 * top_k, 150))


def mmr(pooled: DataFrame, k: int = 8, weight: float = 0.7) -> DataFrame:
    """query_id, rank, gid, score: greedy choice by likeness to the question less that to what was chosen. Pools are bounded."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        vectors = np.array(rows["vector"].tolist(), np.float64)
        gain, worst = weight * rows["score"].to_numpy(), np.zeros(len(rows))
        chosen: list[int] = []
        free = np.ones(len(rows), bool)
        while free.any() and len(chosen) < k:
            value = np.where(free, gain - (1 - weight) * worst, -np.inf)
            best = int(value.argmax())
            likeness = vectors @ vectors[best]
            worst = likeness if not chosen else np.maximum(worst, likeness)
            chosen.append(best)
            free[best] = False
        out = rows.iloc[chosen]
        return pd.DataFrame({"query_id": out["query_id"], "rank": range(len(out)), "gid": out["gid"], "score": out["score"]})

    return pooled.select("query_id", "pos", "gid", "score", "vector").groupBy("query_id").applyInPandas(choose, "query_id long, rank int, gid long, score double")
