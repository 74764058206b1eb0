"""Operators on hand-written rows; expected values were written by hand."""

import numpy as np
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking, cluster, dense, layout, sections
from quarry.plans import search
from quarry.sources import tables
from quarry.streaming import ingest


def values(spark, column, texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(column(F.col("t"))).collect()]


def test_headings(spark):
    lines = ["1. Introduction", "1 Introduction", "mix. results", "R E S U L T S", "Materials & Methods:", "x" * 161, None, "Results,"]
    assert values(spark, T.section_of, lines) == ["INTRODUCTION", None, "RESULTS", None, "METHODS", None, None, "RESULTS"]


def test_despaced(spark):
    assert values(spark, T.despaced, ["M a t e r i a l s a n d", "R E S U L T S", "( a b c d e f g ) , x"]) == ["Materialsand", "R E S U L T S", "(abcdefg), x"]


def test_sentences(spark):
    assert values(spark, T.sentences, ["One, e.g. Two. Three? (Four)  5. six", "", None, "a et al. B. C<DOT>d"]) == [["One, e.g. Two.", "Three?", "(Four)  5. six".replace("  ", " ")], [], [], ["a et al. B.", "C.d"]]


def test_clean_and_citations(spark):
    assert values(spark, T.clean_text, ["A­b  Figure 3 c\nReceived on Monday", "see doi:10.1/x Page 4 z"]) == ["ab c", "see z"]
    assert values(spark, T.without_numeric_citations, ["a [1, 2-4] b (12) (2020) [Paper_x.pdf]"]) == ["a b [Paper_x.pdf]"]
    assert values(spark, lambda c: T.snippet(c, 5), ["ab cd ef", "ab"]) == ["ab cd ...", "ab"]


def test_lines_are_anchored(spark):
    words = [("p", 0, 600.0, 800.0, t, x, x + 10, top, top + 5) for t, x, top in (("a", 10.0, 100.0), ("b", 21.0, 101.5), ("c", 40.0, 102.5), ("d", 10.0, 60.0), ("e", 10.0, 59.9))]
    df = spark.createDataFrame(words, "paper_id string, page int, page_width double, page_height double, text string, x0 double, x1 double, top double, bottom double")
    assert [r["line"] for r in layout.page_lines(df).orderBy("line_no").collect()] == ["d", "ab", "c"]


def test_section_guard_and_merge(spark):
    body = "word " * 60
    lines = [("p", 0, 0, "Materials and"), ("p", 0, 1, "Methods"), ("p", 0, 2, body), ("p", 0, 3, "Results"), ("p", 0, 4, "short"), ("p", 1, 0, "Discussion"), ("p", 1, 1, body)]
    df = spark.createDataFrame(lines, "paper_id string, page int, line_no int, line string")
    none = spark.createDataFrame([], "paper_id string, line string")
    got = [(r["page"], r["section"], r["text"].split("\n")[0][:9]) for r in sections.section_blocks(df, none).orderBy("page", "block_no").collect()]
    assert got == [(0, "METHODS", "word word"), (0, "RESULTS", "short"), (1, "DISCUSSION", "word word")]
    got = sections.section_blocks(df, none, 400).select("section").distinct().collect()
    assert {r[0] for r in got} == {"METHODS"}  # only the first has 400 characters behind it


def test_chunk_tails(spark):
    text = " ".join(f"Sentence {i}." for i in range(10))
    seg = spark.createDataFrame([("p", "p.pdf", 0, "RESULTS", text, 0, 3), ("q", "q.pdf", 0, "REFERENCES", "references", 0, 0)], "paper_id string, title string, seg_idx int, section string, text string, page_start int, page_end int")
    assert [r["first_sentence"] for r in chunking.chunk_segments(seg).orderBy("chunk_index").collect()] == [0, 6, 7, 8, 9]
    assert [r["first_sentence"] for r in chunking.chunk_segments(seg, trim_tails=True).collect()] == [0]
    small = [(r["first_sentence"], r["end_sentence"]) for r in chunking.chunk_segments(seg, max_words=6, overlap=1).orderBy("chunk_index").collect()]
    assert small == [(0, 3), (2, 5), (4, 7), (6, 9), (8, 10), (9, 10)]


def test_predicate_and_topk(spark):
    rows = [(i, [float(i == 0), float(i != 0)], "A" if i < 2 else "B", f"p{i}") for i in range(4)]
    df = spark.createDataFrame(rows, "gid long, vector array<float>, section string, paper_id string")
    q = spark.createDataFrame([(7, [0.0, 1.0])], "query_id long, vector array<float>")
    get = lambda where: [r["gid"] for r in dense.dense_topk(df, q, 3, where).orderBy("pos").collect()]
    assert get(None) == [1, 2, 3]
    assert get(dense.predicate(["A"], ["p3"])) == [1, 3, 0]
    assert get(dense.predicate(["A"], ["p3"], strict=True)) == []
    assert get(dense.predicate([], [])) == [1, 2, 3]


def test_mmr_prefers_others(spark):
    rows = [(1, 1, 10, 1.0, [1.0, 0.0]), (1, 2, 11, 1.0, [1.0, 0.0]), (1, 3, 12, 0.7, [0.5, 0.86])]
    df = spark.createDataFrame(rows, "query_id long, pos int, gid long, score double, vector array<double>")
    assert [r["gid"] for r in dense.mmr(df, 2, 0.5).orderBy("rank").collect()] == [10, 12]


def test_clusters(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(5 * (i % 2), 0.1, 3).tolist()) for i in range(80)] + [(99, [50.0, -50.0, 9.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    made, cents = cluster.kmeans(df.filter("id < 99"), 2)
    assert sorted(r["count"] for r in made.groupBy("cluster").count().collect()) == [40, 40]
    assert cents.count() == 2
    soft = cluster.soft_membership(made.select("id", "vector"), cents, 2).groupBy("id").agg(F.sum("weight").alias("w")).collect()
    assert all(abs(r["w"] - 1) < 1e-5 for r in soft)
    assert cluster.anomalies(df, trees=40, show=1).collect()[0]["id"] == 99
    assert not cluster.anomalies(df.limit(10)).collect()


def test_forest_draws_from_all_rows(spark, monkeypatch):
    """Each tree has its own rows of the whole table; the registered query grows the operator's 300 trees."""
    import inspect

    import pandas as pd

    from quarry.plans import queries

    keys = np.arange(5000, dtype=np.int64)
    parts = [pd.DataFrame({"key": k}) for k in np.array_split(keys, 7)]
    got = pd.concat(cluster._lowest(iter(parts), 60, 16))
    whole = pd.concat(cluster._lowest(iter([pd.DataFrame({"key": keys[::-1]})]), 60, 16))
    assert (got.groupby("tree").key.nunique() == 16).all() and got.key.nunique() > 16 * 16
    assert set(map(tuple, got.values.tolist())) == set(map(tuple, whole.values.tolist()))
    asked, real = [], cluster.outlier_scores
    monkeypatch.setattr(cluster, "outlier_scores", lambda rows, **kw: asked.append(kw) or real(rows, **{**kw, "trees": 20}))
    assert queries.anomalies(spark, "/root/testdata/sf0.001").count() == 8
    assert asked[0].get("trees", inspect.signature(real).parameters["trees"].default) == 300


def test_answers(spark):
    q = spark.createDataFrame([(1, "what?"), (2, "none?")], "query_id long, text string")
    hits = spark.createDataFrame([(1, 0, "t.pdf", "text", 0, 1, "RESULTS", "It is so [3]. Yes.")], "query_id long, rank int, title string, chunk_type string, page_start int, page_end int, section string, text string")
    got = {r["query_id"]: r["answer"] for r in search.answers(search.build_prompts(hits, q)).collect()}
    assert got == {1: "It is so . Yes.", 2: search.NO_HITS}


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"nope")
    got = {r["paper_id"]: r["is_pdf"] for r in tables.read_pdfs(spark, str(tmp_path)).collect()}
    assert got == {"a": True, "b": False}
    rows = spark.createDataFrame([("c_textchunk_1", "x"), ("c_textchunk_1", "x"), ("d", "y")], "chunk_id string, text string")
    rows.write.json(str(tmp_path / "in"))
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["chunk_id"], r["chunk_index"]) for r in got.collect()) == [("c_textchunk_1", 1), ("d", -1)]
    tables.write_chunks(tables.upgraded(spark.createDataFrame([("é_textchunk_2", "t")], "chunk_id string, text string").selectExpr("chunk_id", "text", "null as paper_id", "null as title", "'text' as chunk_type", "1 as page_start", "1 as page_end", "cast(null as int) as chunk_index", "cast(null as string) as section", "0 as start_word", "0 as end_word")), str(tmp_path / "chunks"))
    assert tables.read_chunks(spark, str(tmp_path / "chunks")).select("chunk_index", "section").collect() == [(2, "UNKNOWN")]
