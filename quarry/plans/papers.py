"""From a folder of PDF files to chunks: parser plug-in, lines with their fallback, sections, a store of parsed papers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import chunking, layout, sections
from quarry.sources import tables

#: What a parser gives for each page: its size, its words, its plain text and its tables' cells.
PAGE = "page int, page_width double, page_height double, words array<struct<text:string,x0:double,x1:double,top:double,bottom:double>>, page_text string, tables array<array<array<string>>>"


def parsed_pages(files: DataFrame, parser: Callable[[bytes], list[dict]]) -> DataFrame:
    """paper_id, title and the columns of PAGE for each page of each file."""
    return tables.parse_pdfs(files, parser, f"paper_id string, title string, {PAGE}")


def page_lines(pages: DataFrame, top: float = 60, bottom: float = 60) -> DataFrame:
    """paper_id, page, line_no, line; a page without usable lines gives those of its plain text."""
    words = pages.select("paper_id", "page", "page_width", "page_height", F.explode("words").alias("w")).select("paper_id", "page", "page_width", "page_height", "w.*")
    return layout.page_lines(words, pages.select("paper_id", "page", F.col("page_text").alias("text")), top, bottom)


def segments(pages: DataFrame, least_share: float = 0.30, least_body: int = 200, top: float = 60, bottom: float = 60) -> DataFrame:
    """paper_id, title, seg_idx, section, text, page_start, page_end."""
    lines = page_lines(pages, top, bottom)
    blocks = sections.section_blocks(lines, sections.repeated_lines(lines, pages, least_share), least_body)
    return sections.stitch_segments(blocks).join(pages.select("paper_id", "title").distinct(), "paper_id")


def page_tables(pages: DataFrame) -> DataFrame:
    """paper_id, title, page, table_index, cells."""
    return pages.select("paper_id", "title", "page", F.posexplode("tables").alias("table_index", "cells"))


def parse_folder(spark: SparkSession, folder: str, parser: Callable[[bytes], list[dict]], store: str, with_tables: bool = True) -> DataFrame:
    """Chunks, with gid, of all PDF files of a folder; pages and segments are kept in the store, a folder a paper."""
    tables.write_parsed(parsed_pages(tables.read_pdfs(spark, folder), parser), f"{store}/pages")
    pages = tables.read_parsed(spark, f"{store}/pages")
    tables.write_parsed(segments(pages), f"{store}/segments")
    found = tables.read_parsed(spark, f"{store}/segments")
    texts = chunking.chunk_segments(found)
    return chunking.all_chunks(texts, chunking.chunk_tables(page_tables(pages if with_tables else pages.limit(0)), found))


def full_texts(pages: DataFrame) -> DataFrame:
    """paper_id, title, text of each paper."""
    return sections.full_text(page_lines(pages)).join(pages.select("paper_id", "title").distinct(), "paper_id").select("paper_id", "title", "text")
