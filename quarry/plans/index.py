"""An index that is built once, kept, and searched by many batches of questions.

A folder holds vectors with their chunks' payload, postings, vocabulary, and one row of what they were made
from. An index is used again if the corpus digest, the number of chunks and the model are still the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import chunking, lexical
from quarry.plans import search


#: What the tables look like; an index of another form is built anew.
FORMAT = "postings in arrays"


@dataclass
class Index:
    """The tables of a built index."""

    chunks: DataFrame
    vectors: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    stats: DataFrame

    def bm25(self, questions: DataFrame, k: int = 120) -> DataFrame:
        return lexical.scored(self.postings, self.vocabulary, self.stats, questions, k)

    def search(self, questions: DataFrame, providers: search.Providers | None = None, **options) -> DataFrame:
        """Hybrid search over the kept tables; questions without a vector are embedded."""
        providers = providers or search.Providers()
        asked = questions if "vector" in questions.columns else questions.withColumn("vector", providers.embedder()(F.col("text")))
        return search.hybrid_search(self.chunks, self.vectors, asked, lexical=self.bm25, rerank=providers.rerank, **options)


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def collection_exists(spark: SparkSession, path: str) -> bool:
    """Whether an index was built to its end there."""
    return _exists(spark, f"{path}/meta/_SUCCESS")


def build_index(chunks: DataFrame, path: str, embed: Callable[[Column], Column] | None = None, model: str = "hashed-64", recreate: bool = False) -> Index:
    """The index of chunks (gid and chunk columns) at path: the one that is there if it is of the same corpus and model, else a new one.

    Chunks are numbered and written first; everything else is made from what was written. The row of what
    it was made from comes last, so that half an index is never taken for one.
    """
    spark = chunks.sparkSession
    model = f"{model}, {FORMAT}"
    digest = chunking.corpus_digest(chunks, model)
    if not recreate and collection_exists(spark, path):
        kept, now = spark.read.parquet(f"{path}/meta").first(), digest.first()
        if (kept["digest"], kept["n"], kept["model"]) == (now["digest"], now["n"], now["model"]):
            return open_index(spark, path)
    meta = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    meta.getFileSystem(spark._jsc.hadoopConfiguration()).delete(meta, True)
    write = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}")
    write(chunks, "chunks")
    held = spark.read.parquet(f"{path}/chunks")
    write(held.select("gid", (embed or search.hashed_embedding)(F.col("text")).alias("vector")), "vectors")
    write(lexical.postings(held), "postings")
    kept = spark.read.parquet(f"{path}/postings")
    write(lexical.vocabulary(kept), "vocabulary")
    write(lexical.corpus_stats(kept), "stats")
    write(chunking.corpus_digest(held, model), "meta")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("chunks", "vectors", "postings", "vocabulary", "stats")))
