"""Toxicity: contexts, features against a plain count, clashing columns, long texts."""

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import toxicity
from quarry.llm.toxicity import REPORTING, SECOND, Matcher, context_weight, features, quotations


def weight(text, hit="idiot"):
    at = text.index(hit)
    return context_weight(text, at, at + len(hit), any(a <= at and at + len(hit) <= b for a, b in quotations(text)))


def test_quotations_are_paired():
    assert weight('"hi" to that idiot person and "bye"') == 1.0
    assert weight('someone wrote here "what an idiot that is" once') == 0.25
    assert weight('„was für ein idiot hier“ und') == weight('«quel idiot ici» et') == weight('“an idiot here” and') == 0.25
    assert weight('a line with " a mark\nan idiot here "') == 1.0
    assert quotations("") == [] and quotations('"') == []


def test_reporting_stands_before():
    assert weight("idiot called that thing") == 1.0
    assert weight("somebody called that idiot a thing") == 0.25
    assert weight("so idiot are you") == 1.5 and weight("are you an idiot") == 1.5


def test_contexts_are_parameters(spark):
    rows = [(i, f"some plain words about number {i} and a thing" + (" blargh" if i % 4 == 0 else "")) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(df, labels, reporting=frozenset(["zugt"]), second=frozenset())
    assert model.reporting == {"zugt"}
    score = model.scorer()
    assert score("a plain blargh") > score("a zugt blargh")


def brute_features(text, words, beginnings):
    """Hits by edit distance to each word, one by one."""
    low = text.lower()
    tokens = re.findall(r"[^\W_]+", low)

    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    exact = fuzzy = 0.0
    terms = set()
    for k, t in enumerate(tokens):
        found = next((("=", i) for i, w in enumerate(words) if w == t), None) or next((("^", b) for b in beginnings if t.startswith(b)), None)
        near = None if found else next((("=", i) for i, w in enumerate(words) if len(w) >= 5 and apart(w, t) <= 1), None)
        if found or near:
            w = 0.25 if REPORTING & set(tokens[max(0, k - 3) : k]) else 1.0
            w *= 1.5 if SECOND & set(tokens[max(0, k - 3) : k] + tokens[k + 1 : k + 4]) else 1.0
            exact, fuzzy = (exact + w, fuzzy) if found else (exact, fuzzy + w)
            terms.add(found or near)
    return [math.log1p(exact), math.log1p(fuzzy), math.log1p(len(terms)), 10 * min(0.1, (exact + fuzzy) / max(len(tokens), 1))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("idiot idiott idot Idiot scum scums clown clwn you said the a gorblak gorbl xgorbl word dido".split()), max_size=12))
def test_features(tokens):
    matcher = Matcher(["idiot", "scum", "clown"], ["gorb"], [], [])
    assert features(" ".join(tokens), matcher) == pytest.approx(brute_features(" ".join(tokens), ["idiot", "scum", "clown"], ["gorb"]))


def test_odd_columns_and_long_texts(spark):
    """Columns named as the operator's own, repeated rows, a text of two million characters and one of one letter."""
    rows = [(i, f"plain words about {i}" + (" you idiot" if i % 3 == 0 else ""), 0.5, "x", 1) for i in range(120)]
    rows += [(500, "word " * 400_000 + "idiot", 0.5, "x", 1), (501, "x" * 1_000_000, 0.5, "x", 1), (502, "", 0.5, "x", 1), (502, None, 0.5, "x", 1), (3, rows[3][1], 0.5, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, term string, toxic int")
    labels = df.filter("doc_id < 120").select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"), F.lit("y").alias("text"))
    model = toxicity.fit(df, labels)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert len(set(by[3])) == 1 and by[3][0] >= 0.5 > by[1][0] and by[501] == [by[1][0]] and by[502] == [by[1][0]] * 2
