"""Mixing sources to target weights: an exact cut through hash-random order, as DataFrame expressions.

Each document gets a hash-random key. A source's documents are ordered by it; a prefix sum of their
sizes says where each one starts, and the source's budget is cut there, after as many whole epochs
as it holds. The prefix sum is distributed: keys fall into equal ranges, the ranges' sums are
accumulated a source, and within a range of a source a window adds up the rest. A range of a source
has a bounded number of rows however large the source is.

A null text has size 0, a null source is a source of its own that comes last. Repeated rows count
each on its own; equal keys are ordered by id and size, so that reruns agree. A source of size 0
has target 0. Texts may be of any length. Other columns of the input keep their values, whatever their names. An
empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.llm.common import WORD, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
ROWS_PER_RANGE = 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(doc_id: Column, seed: int) -> Column:
    """13 hex digits of a hash: as text they are in the order of the number."""
    return F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")), 1, 13)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size -> target. Sources get the level times their weight, or at most `most` times their size.

    Sources are put in the order in which a rising level fills them; the level is what remains for
    those that aren't full. One row a source.
    """
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source")))
    at = W.orderBy("fills_at", "rank").rowsBetween(W.unboundedPreceding, -1)
    ranked = sizes.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("most", F.col("source_size").cast("double") * float(most)).withColumn("fills_at", F.col("most") / F.col("weight"))
    level = (F.sum("source_size").over(every).cast("double") * share - F.coalesce(F.sum("most").over(at), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(at), F.lit(0.0)))
    open_ = ranked.withColumn("level", level).withColumn("open", F.col("fills_at") >= F.col("level"))
    final = F.min(F.when(F.col("open"), F.struct("fills_at", "rank", "level"))).over(every)["level"]
    return open_.select("source", "source_size", F.when(F.col("open"), final * F.col("weight")).otherwise(F.col("most")).alias("target"))


def placed_rows(sized: DataFrame, n_rows: int) -> DataFrame:
    """Adds range and of (the source, never null) to rows of source, size, key."""
    ranges = max(1, math.ceil(n_rows / ROWS_PER_RANGE))
    unit = F.conv("key", 16, 10).cast("double") / F.lit(float(16**13))
    return sized.withColumn("range", F.floor(unit * ranges).cast("int")).withColumn("of", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))


def taken_of(rows: DataFrame, narrow: DataFrame, weights, share: float, most: int) -> DataFrame:
    """rows (of, range, key, doc_id, size, ...) with source_size, target and taken; narrow has the same rows, for the sums."""
    sums = narrow.groupBy("of", "source", "range").agg(F.sum("size").alias("range_size"))
    aims = targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most)
    aims = aims.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("of"), "source_size", "target")
    earlier = F.coalesce(F.sum("range_size").over(W.partitionBy("of").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("of", "range", earlier.alias("offset")).join(aims, "of")
    inside = F.coalesce(F.sum("size").over(W.partitionBy("of", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(offsets, ["of", "range"]).withColumn("start", F.col("offset") + inside)
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * F.col("source_size") - F.col("start")))
    return rows.withColumn("taken", (epochs * F.col("size") + rest).cast("long"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, taken for each document; taken counts its words in the mix."""
    sized = written(docs.select(F.col("doc_id").cast("long"), F.col("source"), size_of(F.col("text")).alias("size"), key_of(F.col("doc_id"), seed).alias("key")), "sizes")
    rows = placed_rows(sized, sized.count())
    return taken_of(rows, rows, weights, share, most).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, seed: int = 42) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time that a document is taken whole.

    The one document a source at which the budget is cut comes with the beginning of its text, up to the end of the
    last word that is taken; its n_chars, if docs has that column, is that beginning's. All other values stay as they are.
    """
    kept = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    sized = docs.select(kept, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), size_of(F.col("text")).alias("size"), key_of(F.col("doc_id"), seed).alias("key"))
    narrow = written(sized.drop("row"), "sizes")
    n = narrow.count()
    made = taken_of(placed_rows(sized, n), placed_rows(narrow, n), weights, share, most).filter("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    rest = (F.col("taken") - whole * F.col("size")).cast("int")
    cut = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), rest), "")
    short = F.col("row").withField("text", cut)
    if "n_chars" in docs.columns:
        short = short.withField("n_chars", F.length(cut).cast(docs.schema["n_chars"].dataType))
    copies = F.concat(F.array_repeat("row", whole), F.when(rest > 0, F.array(short)).otherwise(F.array_repeat("row", F.lit(0))))
    return made.select(F.explode(copies).alias("row")).select("row.*")


def oracle_sql(seed: int = 42) -> str:
    """The same mix by plain windows."""
    return rf"""
    WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
                          substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{seed}'), 1, 13) AS k FROM documents),
    sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
    ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS r FROM sums),
    weighed AS (SELECT *, CAST([5, 2, 1][CAST((r - 1) % 3 + 1 AS INT)] AS DOUBLE) AS w, CAST(source_size AS DOUBLE) * 2.0::DOUBLE AS most FROM ranked),
    filled AS (SELECT *, most / w AS fills_at FROM weighed),
    levels AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(most) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lv
               FROM filled WINDOW b AS (ORDER BY fills_at, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    aims AS (SELECT source, source_size, CASE WHEN fills_at >= lv THEN first_value(lv) OVER (ORDER BY fills_at < lv, fills_at, r) * w ELSE most END AS target FROM levels),
    starts AS (SELECT d.*, a.source_size, a.target, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
               FROM sized d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source),
    cut AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM starts)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
           CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - start)) AS BIGINT) AS taken FROM cut"""
