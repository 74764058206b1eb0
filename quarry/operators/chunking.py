"""Overlapping chunks of whole sentences, table chunks, and what belongs to all chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.functions import text as T


def chunk_segments(segments: DataFrame, max_words: int = 450, overlap: int = 4, trim_tails: bool = False, despace: bool = True) -> DataFrame:
    """Chunks of segments (paper_id, title, seg_idx, section, text, page_start, page_end).

    A chunk takes sentences while they hold at most max_words words, one at least. The next one starts
    `overlap` sentences before its end; trim_tails leaves out those that lie in a chunk's tail. Where a
    chunk ends depends only on where it starts, by prefix sums; a fold follows the starts. Texts that
    begin in spaced letters are despaced first, unless despace is false.
    """
    text = F.when(T.looks_spaced(F.substring("text", 1, 500)), T.despaced(F.col("text"))).otherwise(F.col("text")) if despace else F.col("text")
    rows = segments.withColumn("sents", T.sentences(text)).withColumn("n", F.size("sents"))
    sums = F.aggregate(F.col("sents"), F.array(F.lit(0)), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + F.size(F.split(s, " ")))))
    rows = rows.filter("n > 0").withColumn("sums", sums)
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(a, i):
        end = F.greatest(i + 1, F.size(F.filter(F.col("sums"), lambda p: p <= F.element_at(F.col("sums"), i + 1) + max_words)) - 1)
        last = F.lit(trim_tails) & (end >= F.col("n"))
        follow = F.struct(F.when(last, F.col("n")).otherwise(F.greatest(end - overlap, i + 1)).alias("next"), F.concat(a["out"], F.array(F.struct(i.alias("s"), end.alias("e")))).alias("out"))
        return F.when(a["next"] == i, follow).otherwise(a)

    spans = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), start, step)["out"]
    made = rows.select("paper_id", "title", "seg_idx", "section", "page_start", "page_end", "sents", F.posexplode(spans).alias("k", "span"))
    made = made.withColumn("text", F.array_join(F.slice("sents", F.col("span.s") + 1, F.col("span.e") - F.col("span.s")), " "))
    made = made.filter(~((F.col("section") == "REFERENCES") & T.looks_like_references(F.col("text"))))
    made = made.withColumn("chunk_index", (F.row_number().over(W.partitionBy("paper_id").orderBy("seg_idx", "k")) - 1).cast("int"))
    return made.select(T.chunk_id(F.col("paper_id"), "textchunk", F.col("chunk_index")).alias("chunk_id"), "paper_id", "title", "text", F.lit("text").alias("chunk_type"), "page_start", "page_end", "chunk_index", "section", F.col("span.s").alias("first_sentence"), F.col("span.e").alias("end_sentence"))


def page_sections(segments: DataFrame) -> DataFrame:
    """paper_id, page, section: of the last segment on each page."""
    return segments.select("paper_id", "seg_idx", "section", F.explode(F.sequence("page_start", "page_end")).alias("page")).groupBy("paper_id", "page").agg(F.max_by("section", "seg_idx").alias("section"))


def chunk_tables(tables: DataFrame, segments: DataFrame) -> DataFrame:
    """A chunk for each table (paper_id, title, page, table_index, cells) that has text; its section is its page's."""
    at = W.partitionBy("paper_id").orderBy("page", "table_index")
    rows = tables.withColumn("i", F.row_number().over(at) - 1).withColumn("text", T.table_markdown(F.col("cells"))).filter("text != ''").join(page_sections(segments), ["paper_id", "page"], "left")
    return rows.select(T.chunk_id(F.col("paper_id"), "table", F.col("i")).alias("chunk_id"), "paper_id", "title", "text", F.lit("table").alias("chunk_type"), F.col("page").alias("page_start"), F.col("page").alias("page_end"), F.lit(-1).alias("chunk_index"), F.coalesce("section", F.lit("UNKNOWN")).alias("section"))


def numbered(chunks: DataFrame) -> DataFrame:
    """Adds gid, from 0 by paper, text chunks before tables, and their numbers.

    Chunks are numbered inside their papers. Where a paper's numbers begin is a running sum over one row a paper,
    which one task adds up; the chunks themselves never meet in one task.
    """
    parts = chunks.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))
    before = parts.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("paper_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("paper_id", "before")
    inside = F.row_number().over(W.partitionBy("paper_id").orderBy((F.col("chunk_type") != "text").cast("int"), "chunk_index", "chunk_id")) - 1
    return chunks.withColumn("inside", inside).join(before, "paper_id").withColumn("gid", F.col("before") + F.col("inside")).drop("before", "inside")


def all_chunks(text_chunks: DataFrame, table_chunks: DataFrame) -> DataFrame:
    columns = ["chunk_id", "paper_id", "title", "text", "chunk_type", "page_start", "page_end", "chunk_index", "section"]
    return numbered(text_chunks.select(*columns).unionByName(table_chunks.select(*columns)))


def section_profile(chunks: DataFrame) -> DataFrame:
    """section, n, share of the chunks."""
    total = chunks.agg(F.count(F.lit(1)).alias("total"))
    return chunks.groupBy("section").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("section", "n", (F.col("n") / F.col("total")).alias("share"))


def unknown_sections(chunks: DataFrame) -> DataFrame:
    """One row: sections (sorted, without repeats), n, unknown, share of chunks whose section is UNKNOWN."""
    unknown = F.sum((F.coalesce("section", F.lit("UNKNOWN")) == "UNKNOWN").cast("long"))
    sections = F.array_sort(F.collect_set(F.coalesce("section", F.lit("UNKNOWN"))))
    return chunks.agg(F.array_join(sections, " ").alias("sections"), F.count(F.lit(1)).alias("n"), F.coalesce(unknown, F.lit(0)).alias("unknown"), (unknown / F.count(F.lit(1))).alias("share"))


def record_fingerprint(chunks: DataFrame, prefix: int = 200) -> DataFrame:
    """One row: SHA-256 over the chunks' records in order of gid. It gathers a digest a chunk; corpus_digest does not."""
    record = F.concat_ws("|", "chunk_id", "paper_id", "chunk_type", "page_start", "page_end", "section", F.length("text"), F.substring("text", 1, prefix))
    return chunks.select("gid", F.sha2(record, 256).alias("h")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gid", "h"))), lambda s: s["h"]), "\n"), 256).alias("fingerprint"), F.count(F.lit(1)).alias("n"))


def corpus_digest(chunks: DataFrame, model: str) -> DataFrame:
    """One row (digest, n, model) that changes with any chunk's id, text or place: sums of hashes, so any size will do."""
    h = F.xxhash64("gid", "chunk_id", "paper_id", "chunk_type", "page_start", "page_end", "chunk_index", "section", "text")
    return chunks.agg(F.sha2(F.concat_ws(":", F.sum(h.cast("decimal(38,0)")), F.bit_xor(h), F.count(F.lit(1)), F.lit(model)), 256).alias("digest"), F.count(F.lit(1)).alias("n")).withColumn("model", F.lit(model))
