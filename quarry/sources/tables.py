"""Sources and sinks: chunks as JSON lines, PDF files, vector tables, caches, ingest lists."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from quarry.functions import text as T

CHUNKS = "chunk_id string, paper_id string, title string, text string, chunk_type string, page_start int, page_end int, chunk_index int, section string, start_word int, end_word int"


def upgraded(chunks: DataFrame) -> DataFrame:
    """Older chunks: a missing place is read from the id of text chunks, a missing section is UNKNOWN, missing pages are -1."""
    from_id = F.when(F.coalesce("chunk_type", F.lit("text")) == "text", F.expr("try_cast(nullif(regexp_extract(chunk_id, '_textchunk_([0-9]+)$', 1), '') as int)"))
    return chunks.select("chunk_id", "paper_id", "title", "text", F.coalesce("chunk_type", F.lit("text")).alias("chunk_type"), F.coalesce("page_start", F.lit(-1)).alias("page_start"), F.coalesce("page_end", F.lit(-1)).alias("page_end"), F.coalesce("chunk_index", from_id, F.lit(-1)).alias("chunk_index"), F.coalesce("section", F.lit("UNKNOWN")).alias("section"), F.coalesce("start_word", F.lit(0)).alias("start_word"), F.coalesce("end_word", F.lit(0)).alias("end_word"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return upgraded(spark.read.schema(CHUNKS).json(path))


def chunks_from_lines(lines: Column) -> Column:
    return F.from_json(lines, CHUNKS)


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path, ignoreNullFields=False)


def read_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """path, title, paper_id, content, is_pdf of a folder's PDF files; is_pdf tells by the first four bytes. A folder that isn't there, or has none, is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no PDF files in {folder}")
    title = T.title_of(F.col("path"))
    return files.select("path", title.alias("title"), T.paper_id_of(title).alias("paper_id"), "content", is_pdf(F.col("content")).alias("is_pdf"))


def is_pdf(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.lit(b"%PDF")


def parse_pdfs(files: DataFrame, parser, schema: str) -> DataFrame:
    """Rows that parser (a function of bytes -> list of dicts) makes of each file, beside its paper_id and title. Files that it can't read make none."""

    def run(parts):
        for part in parts:
            for paper, title, content in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    rows = [{"paper_id": paper, "title": title} | r for r in parser(content)]
                except Exception as e:  # whatever a parser raises on a broken file
                    print(f"{title}: {e!r}", file=sys.stderr)
                    continue
                yield pa.RecordBatch.from_pylist(rows, arrow)

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return files.filter("is_pdf").select("paper_id", "title", "content").mapInArrow(run, schema)


def write_parsed(rows: DataFrame, path: str) -> None:
    """Parsed rows (paper_id, ...), a folder a paper; papers that are there are written anew, others stay."""
    # "_" keeps ids of digits from being read back as numbers
    rows.withColumn("_paper", F.concat(F.lit("_"), "paper_id")).repartition("_paper").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_paper").parquet(path)


def read_parsed(spark: SparkSession, path: str, papers: list[str] | None = None) -> DataFrame:
    """The parsed rows of all papers, or of some; of papers that aren't there, none. Only their folders are read."""
    rows = spark.read.parquet(path)
    return (rows.filter(F.col("_paper").isin([f"_{p}" for p in papers])) if papers is not None else rows).drop("_paper")


def pdf_link(xml: Column) -> Column:
    """The first link to a PDF in an article's record, or null."""
    found = F.regexp_extract(xml, r"(?i)(?:^|\s)href=\"([^\"\s]+\.pdf)", 1)
    return F.when(found != "", found)


def new_ids(wanted: DataFrame, present: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Ids that aren't there yet, at most so many: what an ingest still has to fetch."""
    out = wanted.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")
    return out.orderBy(key).limit(most) if most is not None else out


def upserted(old: DataFrame, new: DataFrame, key: str = "gid") -> DataFrame:
    """old with the rows of new in place of those with the same key; of rows with one key, the one with the highest hash of its values, so that reruns agree."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = F.xxhash64(*(c for c in old.columns))
    return both.withColumn("_at", F.row_number().over(W.partitionBy(key).orderBy(F.desc("_new"), last.desc()))).filter("_at = 1").drop("_new", "_at")
