"""The pipeline on odd rows, and each of its decisions against plain code."""

from pathlib import Path

import numpy as np
import public_tokenizers
import tiktoken
from test_llm import brute_components

import corpus_pipeline
from quarry.llm import bpe, langid, toxicity
from quarry.llm.common import crc_mod, shared_dir
from quarry.llm.queries import RANKS


def test_odd_rows(spark, tmp_path):
    """Null, empty, repeated and long texts, equal ids of different texts, null ids and labels, clashing columns, and an empty table."""
    plain = [f"the words of document number {i} are w{i} x{i} y{i} z{i} and some more a{i} b{i}" for i in range(60)]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t), "score", 1.5, "row") for i, t in enumerate(plain)]
    rows += [(100, None, "en", "s0", 0, "a", 0.0, "b"), (101, "", "en", "s0", 0, "a", 0.0, "b"), (102, " \n", "en", "s0", 2, "a", 0.0, "b"), (103, "½ 1 2 3", "en", "s0", 7, "a", 0.0, "b"), rows[5], rows[5]]
    rows += [(7, "another text of id seven with words that are its own entirely here", "en", "s1", 5, "c", 0.0, "d"), (None, "no id but words enough to be kept by all of the stages", None, None, 1, "e", 0.0, "f"), (110, "long " + "word " * 300_000, "en", "s2", 9, "g", 0.0, "h")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _lang string, _score double, row string"
    docs = spark.createDataFrame(rows, schema)
    for name, df in (("full", docs), ("none", docs.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 0, 1), (2, 1, 0), (None, None, None), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    sf, got = f"{tmp_path}/full", spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, got, sf)
        assert got.columns == docs.columns
    kept = sorted(map(tuple, got.collect()), key=str)
    assert kept == sorted({r for r in rows if r[1] and any(map(str.isalpha, r[1]))}, key=str)
    mixed = corpus_pipeline.mixed(spark, got, sf)
    assert mixed.columns == docs.columns
    assert {(r["doc_id"], r["_lang"], r["_score"], r["row"]) for r in mixed.collect()} <= {(r[0], *r[5:]) for r in rows}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    assert corpus_pipeline.run(spark, sf).count() == mixed.count()


def test_decisions(spark):
    """Each stage on sf0.001 by the scorers' functions, all pairs' shingles, and the library's tokens."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    model = langid.fit(docs.filter(crc_mod("doc_id", 4) != 2))
    langs = langid.judge([r["text"] for r in rows], model, model.scorer())[0]
    first = [r for r, lang in zip(rows, langs, strict=True) if lang != "und"]
    got = corpus_pipeline.known_language(spark, docs, sf)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, first))
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(crc_mod("doc_id", 5) != 0)
    found = toxicity.fit(got, labels)
    score = found.scorer() if found else lambda _: 0.0
    second = [r for r in first if score(r["text"]) < 0.5]
    got = corpus_pipeline.not_toxic(spark, got, sf)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, second))
    heads = {c for *_, c in brute_components([(r["doc_id"], r["text"]) for r in second])}
    got = corpus_pipeline.without_near_copies(spark, got, sf)
    third = [r for r in second if r["doc_id"] in heads]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, third))
    mixed = corpus_pipeline.mixed(spark, got, sf).collect()
    words = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in third}
    taken: dict = {}
    for r in mixed:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(r["text"].encode().split())
    assert all(n <= 2 * words[i] for i, n in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(words.values())) <= len({r["source"] for r in third}) + 1
    path = public_tokenizers.path(RANKS)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("quarry-*"))
    done = corpus_pipeline.run(spark, sf).collect()
    left = {p.name.split("-")[1] for p in set(folder.glob("quarry-*")) - before}
    assert left <= {"mixing", "measured", "named", "sizes"}
    key = lambda ids: np.frombuffer(ids, "<u4").tolist()
    assert sorted((r["doc_id"], r["n_tokens"], key(r["ids"])) for r in done) == sorted((r["doc_id"], len(ids := lib.encode_ordinary(r["text"])), ids) for r in mixed)
