"""From lines to sections: repeated lines, headings, blocks, segments.

page_lines: paper_id, page, line_no, line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.functions import text as T

PAGE = ["paper_id", "page"]


def repeated_lines(lines: DataFrame, pages: DataFrame | None = None, least_share: float = 0.30) -> DataFrame:
    """paper_id, line: running heads and feet, on many of a paper's pages. pages (paper_id, page) adds empty ones."""
    n_pages = (pages if pages is not None else lines).select(*PAGE).distinct().groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_pages"))
    once = lines.select(*PAGE, T.stripped(F.col("line")).alias("line")).filter("length(line) between 3 and 140").distinct()
    return once.groupBy("paper_id", "line").agg(F.count(F.lit(1)).alias("n")).join(n_pages, "paper_id").filter(F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("n_pages") * least_share))).select("paper_id", "line")


def body_lines(lines: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Lines that aren't empty or repeated, spaced-out ones put right first."""
    clean = lines.select(*PAGE, "line_no", T.despaced_line(T.stripped(F.coalesce("line", F.lit("")))).alias("line")).filter("line != ''")
    return clean.join(blacklist, ["paper_id", "line"], "left_anti").select(*PAGE, "line_no", "line")


def section_blocks(lines: DataFrame, blacklist: DataFrame, least_body: int = 200) -> DataFrame:
    """paper_id, page, block_no, section, text.

    A heading is a line, or a line and the next one; it counts if enough text follows it on the page
    and at the start of the next one. Only whether a heading's second line is used up depends on the
    lines before, so that is all that a fold over a page decides.
    """
    first = lines.filter("line_no < 20").groupBy("paper_id", (F.col("page") - 1).alias("page")).agg(F.length(T.stripped(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: F.coalesce(s["line"], F.lit(""))), " "))).alias("preview"))
    at = W.partitionBy(*PAGE).orderBy("line_no")
    rest = W.partitionBy(*PAGE).orderBy("line_no").rowsBetween(1, W.unboundedFollowing)
    rest2 = W.partitionBy(*PAGE).orderBy("line_no").rowsBetween(2, W.unboundedFollowing)
    left = lambda w: F.greatest(F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)) - 1, F.lit(0)) + F.coalesce("preview", F.lit(0))
    rows = body_lines(lines, blacklist).join(first, PAGE, "left").withColumn("own", T.section_of(F.col("line")))
    rows = rows.withColumn("with_next", F.when(F.col("own").isNull(), T.section_of(F.concat("line", F.lit(" "), F.lead("line").over(at)))))
    rows = rows.withColumn("opens", F.when(F.col("own").isNotNull() & (left(rest) >= least_body), F.col("own"))).withColumn("opens_two", F.when(F.col("with_next").isNotNull() & (left(rest2) >= least_body), F.col("with_next")))
    kind = "array<struct<line_no:bigint,line:string,section:string,skip:boolean>>"

    def step(a, r):
        used = F.exists(F.filter(a, lambda x, i: i == F.size(a) - 1), lambda x: x["skip"])
        row = lambda section, line, skip: F.array(F.struct(r["line_no"].cast("bigint").alias("line_no"), line.alias("line"), section.alias("section"), skip.alias("skip")))
        none, no = F.lit(None).cast("string"), F.lit(False)
        return F.concat(a, F.when(used, row(none, none, no)).when(r["opens"].isNotNull(), row(r["opens"], none, no)).when(r["opens_two"].isNotNull(), row(r["opens_two"], none, F.lit(True))).otherwise(row(none, r["line"], no)))

    folded = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("line_no", "line", "opens", "opens_two"))).alias("rows")).withColumn("row", F.explode(F.aggregate("rows", F.array().cast(kind), step))).select(*PAGE, "row.*")
    order = W.partitionBy("paper_id").orderBy("page", "line_no")
    named = folded.withColumn("in", F.coalesce(F.last("section", True).over(order), F.lit("UNKNOWN"))).withColumn("block_no", F.sum(F.col("section").isNotNull().cast("int")).over(W.partitionBy(*PAGE).orderBy("line_no")))
    blocks = named.filter("line is not null").groupBy(*PAGE, "block_no", F.col("in").alias("section")).agg(T.stripped(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n")).alias("text"))
    return blocks.filter("text != ''")


def stitch_segments(blocks: DataFrame) -> DataFrame:
    """paper_id, seg_idx, section, text, page_start, page_end: neighbouring blocks of one section on the same or the next page are one segment."""
    at = W.partitionBy("paper_id").orderBy("page", "block_no")
    new = F.when((F.col("section") == F.lag("section").over(at)) & (F.col("page") - F.lag("page").over(at)).isin(0, 1), 0).otherwise(1)
    marked = blocks.withColumn("new", new).withColumn("seg_idx", F.sum("new").over(at) - 1)
    return marked.groupBy("paper_id", "seg_idx").agg(F.first("section").alias("section"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "block_no", "text"))), lambda s: s["text"]), "\n\n").alias("text"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))


def full_text(lines: DataFrame) -> DataFrame:
    """paper_id, text: lines joined by line ends, pages by empty lines."""
    pages = lines.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("text"))
    return pages.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda s: s["text"]), "\n\n").alias("text"))


def parse_papers(lines: DataFrame, least_share: float = 0.30, least_body: int = 200) -> DataFrame:
    """page_lines to segments: repeated lines out, sections found, blocks stitched."""
    return stitch_segments(section_blocks(lines, repeated_lines(lines, None, least_share), least_body))
