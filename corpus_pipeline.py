"""A corpus pipeline of five stages; each works on the documents that the one before kept.

Null texts and texts without a letter go at the first stage, so that the next ones see none of them. Empty tables
pass through. Repeated rows are judged alike until the third stage, which keeps one of them. All stages but the last
carry every column of documents, whatever further ones there are and however they are named. Texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, jaccard, langid, mixing, toxicity
from quarry.llm.common import crc_mod, discard, table, written
from quarry.llm.queries import RANKS


def _kept(docs: DataFrame, test) -> DataFrame:
    """The rows of docs for which test (a function of the text's column) is true; a row is carried as one struct, so that no name can clash."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").alias("text"))
    return rows.filter(test(F.col("text"))).select("row.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: null texts and texts without a letter."""
    model = langid.fit(docs.filter(crc_mod("doc_id", 4) != 2))
    return _kept(docs, lambda text: langid.language_column(text, model) != langid.UNKNOWN)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is 0.5 or more."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 5) != 0))
    return _kept(docs, lambda text: toxicity.score_column(text, model) < 0.5)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    return jaccard.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents up to its target, some of them twice."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) of each document of the mix."""
    made = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return made.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("language_id", known_language), ("toxicity", not_toxic), ("near_copies", without_near_copies), ("mixing", mixed), ("bpe", encoded)]

#: Two stages are learned and one is a set-similarity join: SQL has no form for them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; a stage's table goes once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
