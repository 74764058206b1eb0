"""From the words of a page to its lines.

words: paper_id, page, page_width, page_height, text, x0, x1, top, bottom. A page's words are
gathered for the steps that depend on what came before; everything else is a filter or a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.functions import text as T

PAGE = ["paper_id", "page"]


def inside_margins(words: DataFrame, top: float = 60, bottom: float = 60) -> DataFrame:
    return words.filter((F.col("top") >= top) & (F.col("bottom") <= F.col("page_height") - bottom))


def lines_from_words(words: DataFrame, keys: list[str] = PAGE, y_tol: float = 2.0, gap: float = 1.2) -> DataFrame:
    """keys, top, text: a word starts a line if its top lies more than y_tol under the line's first word's."""
    in_order = F.array_sort(F.collect_list(F.struct(F.col("top"), F.col("x0"), F.col("x1"), F.col("text"))))
    anchored = lambda a, w: F.when(F.size(a).eqNullSafe(0) | (w["top"] - F.element_at(a, -1)["anchor"] > y_tol), F.concat(a, F.array(F.struct(w["top"].alias("anchor"), w.alias("word"))))).otherwise(F.concat(a, F.array(F.struct(F.element_at(a, -1)["anchor"].alias("anchor"), w.alias("word")))))
    kind = "array<struct<anchor:double,word:struct<top:double,x0:double,x1:double,text:string>>>"
    placed = words.select(*keys, *[F.col(c).cast("double") for c in ("top", "x0", "x1")], "text").groupBy(*keys).agg(in_order.alias("w")).withColumn("placed", F.explode(F.aggregate("w", F.array().cast(kind), anchored)))
    rows = placed.select(*keys, F.col("placed.anchor").alias("anchor"), "placed.word.*").withColumn("text", T.stripped(F.coalesce("text", F.lit(""))))
    line = W.partitionBy(*keys, "anchor").orderBy("x0", "top", "x1", "text")
    rows = rows.withColumn("line_top", F.first("top").over(line)).filter("text != ''")
    rows = rows.withColumn("glue", F.when(F.col("x0") - F.lag("x1").over(line) <= gap, "").otherwise(" "))
    joined = rows.groupBy(*keys, "anchor").agg(F.first("line_top").alias("top"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", F.struct("top", "x1", "text").alias("k"), "glue", "text"))), lambda s: F.concat(s["glue"], s["text"])), "").alias("text"))
    return joined.select(*keys, "top", T.despaced_line(T.stripped(F.col("text"))).alias("text"))


def column_split(words: DataFrame, least: int = 80, candidates: int = 31) -> DataFrame:
    """paper_id, page, split_x: the gutter of pages in two columns; no row for others.

    Each of some evenly spaced places is scored by the words that cross it, then by the centres near it; every word,
    crossing or not, counts for the side that its centre is on.
    """
    x = F.explode(F.transform(F.sequence(F.lit(0), F.lit(candidates - 1)), lambda i: F.col("page_width") * (F.lit(0.35) + F.lit(0.30) * i / (candidates - 1)))).alias("sx")
    sized = words.filter("page_width > 0").withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*PAGE))).filter(F.col("n") >= least).withColumn("mid", (F.col("x0") + F.col("x1")) / 2)
    tried = sized.select("*", x)
    cross = (F.col("x0") < F.col("sx")) & (F.col("x1") > F.col("sx"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    scored = tried.groupBy(*PAGE, "sx").agg(F.max("n").alias("n"), one(cross).alias("crossing"), one(F.abs(F.col("mid") - F.col("sx")) <= 10).alias("near"), one(F.col("mid") < F.col("sx")).alias("left"), one(F.col("mid") >= F.col("sx")).alias("right"))
    best = scored.groupBy(*PAGE).agg(F.min_by(F.struct("sx", "n", "crossing", "left", "right"), F.struct(F.col("crossing") * 10000 + F.col("near"), F.col("sx"))).alias("b")).select(*PAGE, "b.*")
    quarter = F.floor(F.col("n") * 0.25)
    return best.filter((F.col("crossing") <= F.greatest(F.lit(3), F.floor(F.col("n") * 0.02))) & (F.col("left") >= quarter) & (F.col("right") >= quarter)).select(*PAGE, F.col("sx").alias("split_x"))


def routed(words: DataFrame, splits: DataFrame) -> DataFrame:
    """Adds side: left, span or right of the page's gutter; span on pages without one."""
    mid = (F.col("x0") + F.col("x1")) / 2
    crossing = (F.col("x0") < F.col("split_x")) & (F.col("x1") > F.col("split_x"))
    return words.join(splits, PAGE, "left").withColumn("side", F.when(F.col("split_x").isNull() | crossing, "span").when(mid < F.col("split_x"), "left").otherwise("right"))


def page_lines(words: DataFrame, page_text: DataFrame | None = None, top: float = 60, bottom: float = 60, worst: float = 0.25) -> DataFrame:
    """paper_id, page, line_no, line: left column and spanning lines by place, then the right column.

    page_text (paper_id, page, text) stands in where there are no lines, or too many spaced-out ones.
    """
    kept = inside_margins(words, top, bottom)
    lines = lines_from_words(routed(kept, column_split(kept)), [*PAGE, "side"])
    at = W.partitionBy(*PAGE).orderBy((F.col("side") == "right").cast("int"), "top", "side", "text")
    lines = lines.filter("text != ''").select(*PAGE, (F.row_number().over(at) - 1).alias("line_no"), F.col("text").alias("line"))
    if page_text is None:
        return lines
    bad = lines.groupBy(*PAGE).agg(F.avg(T.looks_spaced(F.col("line")).cast("double")).alias("bad"))
    judged = page_text.join(bad, PAGE, "left").filter(F.col("bad").isNull() | (F.col("bad") > worst))
    raw = judged.select(*PAGE, F.posexplode(F.filter(F.transform(F.split("text", "[\r\n]"), lambda x: T.despaced_line(T.stripped(x))), lambda x: x != "")).alias("line_no", "line"))
    return lines.join(judged.select(*PAGE), PAGE, "left_anti").unionByName(raw)
