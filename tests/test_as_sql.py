"""Queries against their SQL on hand-made tables that the given ones don't have at their smallest size."""

import duckdb
import pytest

from quarry.operators import chunking, lexical
from quarry.plans import index, queries
from quarry.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string"


def differing(spark, name: str, folder, **tables) -> list:
    """Rows that only the query or only its SQL gives, over tables written to folder."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    made, want = QUERIES[name](spark, str(folder)), con.sql(SQL[name])
    return sorted(set(map(tuple, made.select(*want.columns).collect())) ^ set(want.fetchall()), key=repr)


def test_chunks_of_spaced_letters(spark, tmp_path):
    docs = [(0, "Ö " * 300 + "word " * 20 + "End. Next one.", "de", "a"), (1, "Plain text. And more.", "en", "a")]
    assert differing(spark, "chunks", tmp_path, documents=spark.createDataFrame(docs, DOCUMENTS)) == []


def test_keywords_count_all_terms(spark, tmp_path):
    """60,000 terms in a group, each twice as often as those that follow the cut of the vectoriser."""
    often = " . ".join(f"often{i}" for i in range(26_000))
    docs = [(i, f"{often} {often}", "en", "a") for i in (0, 1)] + [(i, " ".join(f"rare{j}" for j in range(3_000)), "en", "a") for i in (2, 3)]
    assert differing(spark, "keywords", tmp_path, documents=spark.createDataFrame(docs, DOCUMENTS)) == []


ASKED = [(0, "alpha beta beta"), (1, "common"), (2, ""), (3, None), (4, "nowhere at-all"), (5, "ALPHA common gamma"), (6, "delta"), (7, "word7 word9 Δ")]


def searched(spark):
    """Documents with copies beyond the 120 that are kept, long, empty and null ones, and questions."""
    docs = [(i, f"alpha beta word{i % 10} common", "en", "a") for i in range(400)] + [(400 + i, "gamma " * (i + 1) + "delta Δ common", "en", "b") for i in range(150)]
    docs += [(900, None, "en", "a"), (901, "", "en", "a"), (902, " ?! ", "en", "a")]
    return spark.createDataFrame(docs, DOCUMENTS).repartition(7), spark.createDataFrame(ASKED, "item_id long, text string")


def test_bm25_in_small_blocks(spark, tmp_path, monkeypatch):
    for name, value in (("BLOCK", 3), ("DOCUMENTS", 16), ("QUESTIONS", 2)):
        monkeypatch.setattr(lexical, name, value)
    docs, asked = searched(spark)
    assert differing(spark, "bm25_topk", tmp_path, documents=docs, benchmark=asked) == []


def test_bm25_moves_no_postings(spark, tmp_path):
    """Only each task's best meet by question; documents and their tokens stay where they are read."""
    docs, asked = searched(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    asked.write.parquet(f"{tmp_path}/benchmark.parquet")
    plan = queries.bm25_topk(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange" in line]
    assert dealt and all("hashpartitioning(query_id" in line for line in dealt), dealt


def test_bm25_without_documents(spark, tmp_path):
    docs, asked = searched(spark)
    assert differing(spark, "bm25_topk", tmp_path, documents=docs.filter("false"), benchmark=asked) == []


def joins(spark, name: str, folder) -> list[str]:
    """The joins in a query's plan, the last one first, if no table is small enough to be sent unasked."""
    docs, asked = searched(spark)
    docs.write.parquet(f"{folder}/documents.parquet")
    asked.write.parquet(f"{folder}/benchmark.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return [line for line in plan.splitlines() if "Join" in line]


def test_prompt_leaves_texts_in_place(spark, tmp_path):
    found = joins(spark, "prompt", tmp_path)
    assert any("BroadcastHashJoin [gid" in j for j in found) and not any("SortMergeJoin [gid" in j for j in found), found


@pytest.mark.parametrize("name", ["hybrid_search", "answer"])
def test_hybrid_search_leaves_texts_in_place(spark, tmp_path, name):
    """The chosen hits go to the texts, and the candidates to the vectors; only vectors and ids of chunks are joined by a shuffle."""
    found = [j for j in joins(spark, name, tmp_path) if "[gid" in j]
    assert "BroadcastHashJoin [gid" in found[0] and "BroadcastHashJoin [gid" in found[1], found


def test_hybrid_candidates_in_small_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 3)
    docs, asked = searched(spark)
    assert differing(spark, "hybrid_candidates", tmp_path, documents=docs, benchmark=asked) == []


def test_an_index_of_another_form_is_built_anew(spark, tmp_path):
    chunks = queries.doc_chunks(spark, SF)
    at = str(tmp_path / "index")
    index.build_index(chunks, at)
    asked = queries.questions(spark, SF)
    want = sorted(map(tuple, index.open_index(spark, at).bm25(asked).collect()))
    spark.read.parquet(f"{at}/chunks").selectExpr("gid", "1 as dl", "text as token", "1L as tf").write.mode("overwrite").parquet(f"{at}/postings")
    chunking.corpus_digest(chunks, "hashed-64").write.mode("overwrite").parquet(f"{at}/meta")
    assert sorted(map(tuple, index.build_index(chunks, at).bm25(asked).collect())) == want
