"""Plans: a kept index, PDF folders with a stub parser, models held by workers, a whole analysis; invariants of k-means and outliers."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking, dense, layout, lexical
from quarry.plans import analytics, index, papers, queries, search
from quarry.sources import tables

SF = "/root/testdata/sf0.001"


def test_index_is_kept(spark, tmp_path):
    chunks, asked = queries.doc_chunks(spark, SF), queries.questions(spark, SF)
    at = f"{tmp_path}/index"
    assert not index.collection_exists(spark, at)
    made = index.build_index(chunks, at)
    assert index.collection_exists(spark, at)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(made.bm25(asked)) == rows(lexical.bm25_topk(chunks, asked))
    stamp = lambda: sorted((p.stat().st_mtime_ns, p.name) for p in (tmp_path / "index" / "postings").iterdir())
    before = stamp()
    again = index.build_index(chunks.withColumn("text", F.col("text")), at)
    assert stamp() == before and rows(again.bm25(asked)) == rows(made.bm25(asked))
    index.build_index(chunks.withColumn("text", F.concat("text", F.lit(" more"))), at)
    assert stamp() != before
    before = stamp()
    last = index.build_index(chunks.withColumn("text", F.concat("text", F.lit(" more"))), at, model="another")
    assert stamp() != before
    found = last.search(asked.limit(2), top_k=3).collect()
    assert len(found) == 6


def page(number, lines, text="", cells=()):
    words = [{"text": w, "x0": 40.0 + 60 * k, "x1": 90.0 + 60 * k, "top": 100.0 + 12 * i, "bottom": 110.0 + 12 * i} for i, line in enumerate(lines) for k, w in enumerate(line.split())]
    return {"page": number, "page_width": 600.0, "page_height": 4000.0, "words": words, "page_text": text, "tables": list(cells)}


def test_folder_of_papers(spark, tmp_path):
    def stub(content: bytes) -> list[dict]:
        if b"broken" in content:
            raise KeyError("broken")
        return json.loads(content[4:])

    body = lambda k: [f"Some words of body {k} and line {i} that are long enough to count." for i in range(6)]
    one = [page(0, ["Introduction", *body(0)]), page(1, [], "Results\n" + "\n".join(body(1)) + "\r\n"), page(2, ["a b c d 1 e f g h"] * 8, "plain lines instead\rand more"), page(3, ["Conclusions", *body(3)], cells=[[["a", "b"], ["1", None]]])]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "007.pdf").write_bytes(b"%PDF" + json.dumps(one).encode())
    (tmp_path / "in" / "Two.PDF").write_bytes(b"%PDF" + json.dumps([page(0, ["Abstract", *body(9)])]).encode())
    (tmp_path / "in" / "bad.pdf").write_bytes(b"%PDFbroken")
    (tmp_path / "in" / "none.pdf").write_bytes(b"<html>")
    got = papers.parse_folder(spark, f"{tmp_path}/in", stub, f"{tmp_path}/store").orderBy("gid").collect()
    assert [r["gid"] for r in got] == list(range(len(got)))
    assert {(r["paper_id"], r["title"]) for r in got} == {("007", "007.pdf"), ("Two", "Two.PDF")}
    mine = [(r["section"], r["chunk_type"]) for r in got if r["paper_id"] == "007"]
    assert list(dict.fromkeys(mine)) == [("INTRODUCTION", "text"), ("RESULTS", "text"), ("CONCLUSION", "text"), ("CONCLUSION", "table")]
    assert any("plain lines instead and more" in r["text"] for r in got), [r["text"][-160:] for r in got]
    kept = tables.read_parsed(spark, f"{tmp_path}/store/segments", ["007", "missing"])
    assert {r["paper_id"] for r in kept.collect()} == {"007"}
    assert tables.read_parsed(spark, f"{tmp_path}/store/segments", ["missing"]).collect() == []
    texts = {r["paper_id"]: r["text"] for r in papers.full_texts(tables.read_parsed(spark, f"{tmp_path}/store/pages")).collect()}
    assert texts["Two"].startswith("Abstract\nSome words")


def test_folders_without_papers(spark, tmp_path):
    (tmp_path / "x.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        tables.read_pdfs(spark, str(tmp_path))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        tables.read_pdfs(spark, f"{tmp_path}/missing").count()


def test_models_are_loaded_once_a_worker(spark):
    def load():
        import os

        return os.getpid(), [0]

    def run(model, values):
        model[1][0] += 1
        return [f"{model[0]}:{v}" for v in values]

    made = search.lazy_model("stub", load, run, "string", rows=4)
    got = [r[0] for r in spark.range(40).repartition(2).select(made(F.col("id").cast("string")).alias("x")).collect()]
    assert sorted(int(x.split(":")[1]) for x in got) == list(range(40))
    both = search.lazy_model("stub2", load, lambda m, v: [f"{a}-{b}" for a, b in v], "string")
    assert [r[0] for r in spark.range(2).select(both(F.col("id").cast("string"), F.lit("y")).alias("x")).collect()] == ["0-y", "1-y"]


def test_search_with_providers(spark, tmp_path):
    chunks, asked = queries.doc_chunks(spark, SF), queries.questions(spark, SF).limit(2)
    given = search.Providers(rerank=lambda question, text: F.length(text).cast("double"), generate=lambda prompt: F.concat(prompt, F.lit("said [1, 2] so")))
    found = index.build_index(chunks, f"{tmp_path}/i").search(asked, given, top_k=4)
    prompts = search.build_prompts(found, asked)
    assert {r["answer"] for r in search.answers(prompts, given.generator()).collect()} == {"said so"}


def test_columns_split_counts_crossing_words(spark):
    """The centre of a word that crosses the gutter counts for its side: with three of them, 22 words make a quarter of 97 and without them don't."""
    splits = {(r["page"]) for r in layout.column_split(layout.inside_margins(queries.page_words(spark))).collect()}
    assert 0 in splits and 1 not in splits


def test_term_counts(spark):
    rows = [(1, ["b", "a", "b", "b", "c"]), (2, []), (3, None), (4, ["x"])]
    got = {r["id"]: [tuple(x) for x in r["t"] or []] for r in spark.createDataFrame(rows, "id int, w array<string>").select("id", lexical.term_counts(F.col("w")).alias("t")).collect()}
    assert got == {1: [("a", 1), ("b", 3), ("c", 1)], 2: [], 3: [], 4: [("x", 1)]}


def test_dense_in_turns(spark, monkeypatch):
    """Blocks of questions, of vectors, and turns give what one product gives, ties by id."""
    vectors, asked = queries.vectors(spark, SF), queries.vector_questions(spark, SF)
    twice = vectors.unionByName(vectors.withColumn("gid", F.col("gid") + 10_000))
    want = sorted(map(tuple, dense.dense_topk(twice, asked, 7).collect()))
    for name, value in (("BLOCK", 10), ("QUESTIONS", 3), ("VECTORS", 16)):
        monkeypatch.setattr(dense, name, value)
    assert sorted(map(tuple, dense.dense_topk(twice, asked, 7).collect())) == want


def test_analysis(spark):
    chunks = queries.doc_chunks(spark, SF).withColumn("paper_id", F.concat(F.lit("p"), F.floor(F.col("gid") / 3)))
    made = analytics.analyse(chunks, k=4, sub_k=2, trees=20)
    n = chunks.select("paper_id").distinct().count()
    assert made.papers.count() == made.report.count() == n
    sums = made.membership.groupBy("id").agg(F.sum("weight").alias("w")).collect()
    assert all(abs(r["w"] - 1) < 1e-4 for r in sums)
    assert made.keywords.count() > 0 and made.subclusters.count() == n and made.outliers.count() == 8
    assert {r["cluster"] for r in made.representatives.collect()} == {r["cluster"] for r in made.papers.select("cluster").distinct().collect()}


def test_kmeans_and_subclusters_invariants(spark):
    rows = queries.table(spark, SF, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    sizes = queries.QUERIES["kmeans_sizes"](spark, SF).collect()
    assert len(sizes) == 8 and sum(r["n"] for r in sizes) == rows.count()
    subs = queries.QUERIES["subclusters"](spark, SF).collect()
    assert len(subs) == rows.count() and len({r["id"] for r in subs}) == len(subs)
    by = {}
    for r in subs:
        by.setdefault(r["cluster"], []).append(r["sub"])
    assert all(set(v) == {None} if len(v) < 10 else set(v) <= {0, 1, 2} for v in by.values())


def test_unknown_sections(spark):
    df = spark.createDataFrame([("METHODS",), ("UNKNOWN",), (None,), ("METHODS",)], "section string")
    assert tuple(chunking.unknown_sections(df).first()) == ("METHODS UNKNOWN", 4, 2, 0.5)
