"""The analysis of a corpus as one plan: clean, embed, group by paper, cluster, describe."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import cluster
from quarry.plans import search


@dataclass
class Analysis:
    papers: DataFrame  # paper_id, title, place, n, vector, cluster
    centroids: DataFrame
    membership: DataFrame
    report: DataFrame
    representatives: DataFrame
    keywords: DataFrame
    subclusters: DataFrame
    outliers: DataFrame


def embedded(chunks: DataFrame, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """chunks with vector, made from their cleaned text."""
    return chunks.withColumn("vector", (embed or search.hashed_embedding)(T.clean_text(F.coalesce("text", F.lit("")))))


def analyse(chunks: DataFrame, k: int = 8, embed: Callable[[Column], Column] | None = None, top: int = 3, sub_k: int = 6, stop_words: list[str] | None = None, least_chunks: int = 1, **outliers) -> Analysis:
    """chunks: gid, paper_id, title, text."""
    known = embedded(chunks, embed)
    papers = cluster.paper_vectors(known.select("paper_id", "vector"), least_chunks).join(cluster.first_titles(chunks), "paper_id").join(chunks.groupBy("paper_id").agg(F.min("gid").alias("place")), "paper_id").persist()
    placed, centroids = cluster.kmeans(papers.withColumn("id", F.col("place")), k)
    soft = cluster.soft_membership(placed.select("id", "vector"), centroids, top)
    own = placed.select("paper_id", "cluster")
    words = chunks.join(own, "paper_id").select(F.col("cluster").alias("grp"), F.col("gid").alias("id"), T.clean_text(F.coalesce("text", F.lit(""))).alias("text"))
    return Analysis(
        placed.select("paper_id", "title", "place", "n", "vector", "cluster"), centroids, soft, cluster.membership_report(soft, placed.select("id", F.col("place").alias("seen"))), cluster.representatives(placed.select("id", "cluster", "vector"), centroids),
        cluster.keywords(words, stop_words=stop_words), cluster.subclusters(placed.select("id", "cluster", "vector"), sub_k), cluster.anomalies(placed.select("id", "vector"), **outliers),
    )
