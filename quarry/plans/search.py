"""Search end to end: hybrid candidates, pool, diversity, prompts and answers, for many questions in one plan."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import dense as D
from quarry.operators import lexical as L

#: Rows of hits that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
# Fixed value: the answer without hits.
NO_HITS = "No relevant chunks were retrieved; I don't have enough information to answer."


_models: dict[str, object] = {}


def model_of(name: str, load: Callable[[], object]) -> object:
    """The model of this name in this Python worker: loaded when it is first asked for, then kept."""
    if name not in _models:
        _models[name] = load()
    return _models[name]


def lazy_model(name: str, load: Callable[[], object], run: Callable[[object, list], list], kind: str, rows: int = 32) -> Callable[..., Column]:
    """A function of Columns that runs a model in Arrow batches: load() once a worker, run(model, inputs) for `rows` rows at a time.

    inputs are the values of one Column, or tuples of the values of several; kind is the type of the result.
    """

    def apply(*columns: Column) -> Column:
        @F.pandas_udf(kind)
        def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                values = list(batch)
                yield pd.Series([x for at in range(0, len(values), rows) for x in run(model_of(name, load), values[at : at + rows])], dtype=object if "array" in kind or kind == "string" else None)

        @F.pandas_udf(kind)
        def made_of_all(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for batch in batches:
                values = list(zip(*batch, strict=True))
                yield pd.Series([x for at in range(0, len(values), rows) for x in run(model_of(name, load), values[at : at + rows])], dtype=object if "array" in kind or kind == "string" else None)

        return (made if len(columns) == 1 else made_of_all)(*columns)

    return apply


@dataclass
class Providers:
    """Models by name: each takes Columns and gives one, lazy_model makes such. None: that step is left out, or has a plain stand-in."""

    embed: Callable[[Column], Column] | None = None
    rerank: Callable[[Column, Column], Column] | None = None
    generate: Callable[[Column], Column] | None = None

    def embedder(self) -> Callable[[Column], Column]:
        return self.embed or hashed_embedding

    def generator(self) -> Callable[[Column], Column]:
        return self.generate or extractive


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """The stand-in for an embedding model, in Arrow batches: token counts by hashed place with a hashed sign, at unit length."""

    @F.pandas_udf("array<float>")
    def embed(tokens: pd.Series) -> pd.Series:
        out = np.zeros((len(tokens), dim))
        for row, words in zip(out, tokens, strict=True):
            for word in words:
                h = zlib.crc32(word.encode())
                row[h % dim] += 1 if h >> 16 & 1 else -1
        return pd.Series(list((out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-12)).astype(np.float32)))

    return embed(T.search_tokens(text))


def sent(hits: DataFrame, most: int) -> DataFrame:
    """hits, of which there are at most `most`, to be joined: few are sent to where the other rows are read."""
    return F.broadcast(hits) if most <= BROADCAST_ROWS else hits


def with_rows(hits: DataFrame, most: int, rows: DataFrame) -> DataFrame:
    """hits joined with rows by gid."""
    return rows.join(sent(hits, most), "gid")


def hybrid_search(chunks: DataFrame, vectors: DataFrame, questions: DataFrame, top_k: int = 8, dense_k: int = 120, bm25_k: int = 120, window: int = 1, where: Column | None = None, use_bm25: bool = True, strict_filter: bool = False, rerank: Callable[[Column, Column], Column] | None = None, weight: float = 0.7, lexical: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """query_id, rank, score, chunk_id, paper_id, title, chunk_type, page_start, page_end, section, text.

    chunks: gid and chunk columns; vectors: gid, vector; questions: query_id, text, vector. `where` limits
    dense candidates only, or with strict_filter all of them. lexical: the lexical search of a kept index.
    """
    asked = questions.count()
    known = chunks.drop("text").join(vectors, "gid")
    dense = D.dense_topk(known, questions, dense_k, where)
    both = D.candidates(dense, lexical(questions, bm25_k) if lexical else L.bm25_topk(chunks, questions, bm25_k)) if use_bm25 else dense.select("query_id", "gid")
    most = asked * (dense_k + (bm25_k if use_bm25 else 0))
    wide = D.expand_neighbors(sent(both.select("query_id", "gid"), most), chunks, window)
    if strict_filter and where is not None:
        wide = wide.join(chunks.filter(where).select("gid"), "gid", "left_semi")
    pooled = D.pool(sent(wide, most * (1 + 2 * window)), vectors, questions, top_k)
    if rerank is not None:  # permutes the pool; only ties can change the choice
        judged = pooled.join(chunks.select("gid", "text"), "gid").join(questions.select("query_id", F.col("text").alias("question")), "query_id").withColumn("r", rerank(F.col("question"), F.substring("text", 1, 2000)))
        pooled = judged.withColumn("pos", F.row_number().over(D.W.partitionBy("query_id").orderBy(F.desc("r"), "pos"))).select(*pooled.columns)
    chosen = D.mmr(pooled, top_k, weight)
    return with_rows(chosen, asked * top_k, chunks).select("query_id", "rank", "score", "chunk_id", "paper_id", "title", "chunk_type", "page_start", "page_end", "section", "text")


def build_prompts(hits: DataFrame, questions: DataFrame, most_chars: int = 1800, instruction: str = "Use only the context below, and cite its tags.") -> DataFrame:
    """query_id, prompt, tags: each question with its hits in order. The instruction is a parameter."""
    tag = F.concat(F.lit("[Paper_"), "title", F.lit("]"))
    block = F.concat(tag, F.lit(" type="), "chunk_type", F.lit(" pages="), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string"), F.lit(" section="), "section", F.lit("\n"), F.substring(F.coalesce("text", F.lit("")), 1, most_chars))
    made = hits.select("query_id", "rank", tag.alias("tag"), block.alias("block")).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda s: s["block"]), "\n\n---\n\n").alias("context"), F.array_join(F.array_sort(F.collect_set("tag")), " ").alias("tags"))
    return questions.join(made, "query_id", "left").select("query_id", F.when(F.col("context").isNotNull(), F.concat(F.lit(instruction + "\n\nContext:\n\n"), "context", F.lit("\n\nQuestion:\n"), "text", F.lit("\n\nTags: "), "tags")).alias("prompt"), "tags")


def extractive(prompt: Column) -> Column:
    """The stand-in for a text generator, not a model: the first three sentences of the first block."""
    body = F.regexp_extract(prompt, r"(?s)Context:\n\n[^\n]*\n(.*?)(?:\n\n---\n\n|\n\nQuestion:\n)", 1)
    return F.array_join(F.slice(T.sentences(body), 1, 3), " ")


def answers(prompts: DataFrame, generate: Callable[[Column], Column] = extractive) -> DataFrame:
    """query_id, answer: generated text without the prompt's echo and numeric citations; a fixed sentence without hits."""
    said = generate(F.col("prompt"))
    said = F.when(said.startswith(F.col("prompt")), F.substring(said, F.length("prompt") + 1, F.length(said))).otherwise(said)
    return prompts.select("query_id", F.when(F.col("prompt").isNull(), NO_HITS).otherwise(T.without_numeric_citations(T.stripped(said))).alias("answer"))
