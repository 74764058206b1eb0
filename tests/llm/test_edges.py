"""Odd inputs of the operators: clashing columns by value, very long texts, many languages, no letters."""

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quarry.llm import bpe, langid, mixing
from quarry.llm.queries import RANKS


def test_mixed_documents_keep_columns(spark):
    """Columns named as the operator's own keep their values; the cut text is a beginning, with its line ends."""
    rows = [(i, f"one\n\ttwo  three\r\nfour {i}", "ab"[i % 2], 77, 99, 5, 6, "o", 8, 9, "k") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, range int, offset int, target int, of string, start int, n_chars int, key string")
    made = mixing.mixed_documents(docs, weights=(3, 1), share=0.33)
    assert made.schema.simpleString() == docs.schema.simpleString()
    texts = {r[0]: r[1] for r in rows}
    got = made.collect()
    short = 0
    for r in got:
        assert texts[r["doc_id"]].startswith(r["text"]) and tuple(r)[3:9] == (77, 99, 5, 6, "o", 8) and r["key"] == "k"
        if r["text"] != texts[r["doc_id"]]:
            short += 1
            assert r["n_chars"] == len(r["text"]) and r["text"][-1:].strip()
        else:
            assert r["n_chars"] == 9
    assert 0 < short <= 2
    assert made.select(F.sum(mixing.size_of(F.col("text")))).first()[0] == mixing.mix(docs, weights=(3, 1), share=0.33).agg(F.sum("taken")).first()[0]


@pytest.mark.parametrize("text", [" " * 3_000_000, "\n" * 1_000_000, "x" + " \t" * 600_000 + "y z", "a" * 1_000_000, "漢" * 1_000_000, "!" * 1_000_000, "word " + "　" * 30_000 + "end", "\x1c" * 30_000])
def test_bpe_long_runs(text):
    """Long runs come back whole, and where the library can take the run its ids are the library's."""
    encoder = bpe.Encoder(public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    assert encoder.decode(encoder.encode(text)) == text.encode()
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(RANKS)), special_tokens={})
    for run in (" ", "\n", " \t", "\t ", "　"):
        for shape in ("{}", "a{}", "{}a", "a{}b c", "{}!", "{}1{}", "a {} b"):
            t = shape.replace("{}", run * 20_000)
            assert np.frombuffer(encoder.encode(t), "<u4").tolist() == lib.encode_ordinary(t)


def test_language_without_letters(spark):
    none = spark.createDataFrame([(1, "½ ² 123", "en"), (2, "...", "de")], "doc_id long, text string, lang string")
    assert langid.fit(none) is None
    some = none.unionByName(spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 20)], none.schema))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(none, langid.fit(some)).collect()}
    assert got == {1: ("und", 0.0), 2: ("und", 0.0)}


def test_many_languages(spark):
    """250 languages, some of two texts only, are all learned, from a bounded sample."""
    rng = np.random.default_rng(1)
    rows = []
    for lang in range(250):
        abc = [chr(0x4E00 + 12 * lang + k) for k in range(12)]
        rows += [(len(rows) + i, "".join(rng.choice(abc, 40)), f"l{lang}") for i in range(2 if lang % 2 else 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, most_rows=1000)
    assert len(model.languages) == 250
    made = langid.predict(docs, model).join(docs, "doc_id").filter("lang = lang_pred").count()
    assert made > 0.95 * len(rows)
