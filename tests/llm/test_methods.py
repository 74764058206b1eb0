"""Language ID, repetition, chat and URL filters against plain counts; odd rows by value."""

import collections

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import chat, langid, repetition, urlfilter


def plain_slots(text: str) -> set[int]:
    out = set()
    points = [ord(c) for c in text.lower()]
    for n in (1, 2, 3):
        for at in range(len(points) - n + 1):
            h = 0
            for p in points[at : at + n]:
                h = (h * 0x01000193 + p) & 0xFFFFFFFF
            out.add(((h * 0x9E3779B1 + (0x7F4A7C15 * n & 0xFFFFFFFF)) * 0x85EBCA6B & 0xFFFFFFFF) >> 19)
    return out


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_presence(text):
    assert set(np.flatnonzero(langid.presence(text))) == plain_slots(text)


def test_presence_in_pieces(monkeypatch):
    text = "The quick brown fox, žluťoučký kůň. " * 50
    whole = langid.presence(text)
    monkeypatch.setattr(langid, "_PIECE", 7)
    assert (langid.presence(text) == whole).all()


def test_kernel_regression():
    """With every row a landmark, decisions are those of weighted kernel ridge regression solved over the rows themselves."""
    rng = np.random.default_rng(2)
    words = {"a": "the cat and dog of".split(), "b": "der die und das von".split(), "c": "le la et des chat".split()}
    langs = [x for x in "abc" for _ in range(6 + ord(x) - 97)]
    texts = [" ".join(rng.choice(words[x], 8)) for x in langs]
    rows = np.stack([langid.presence(t) for t in texts])
    model = langid.fit_rows(langs, np.packbits(rows, axis=1), ridge=0.01)
    sets = [plain_slots(t) for t in texts]
    kernel = np.array([[len(x & y) / (len(x) * len(y)) ** 0.5 for y in sets] for x in sets])
    counts = collections.Counter(langs)
    weight = np.array([1 / counts[x] for x in langs])
    weight *= len(langs) / weight.sum()
    target = np.array([[1.0 if x == y else -1.0 for y in "abc"] for x in langs])
    bias = (target * weight[:, None]).mean(0)
    # (K W K + r n K) alpha = K W (y - bias): the same minimum in the rows' own span
    alpha = np.linalg.lstsq(kernel @ (weight[:, None] * kernel) + 0.01 * len(langs) * kernel, kernel @ (weight[:, None] * (target - bias)), rcond=1e-12)[0]
    assert model.scorer()(rows) == pytest.approx(kernel @ alpha + bias, abs=1e-3)


def plain_verdict(text: str | None) -> tuple:
    """Counts and verdict by comparing words, without hashes."""
    words = repetition._WORD.findall(text or "")
    chars = sum(map(len, words))
    lines = (text or "").split("\n")
    again = [x for i, x in enumerate(lines) if repetition._WORD.search(x) and x in lines[:i]]

    def inside(n):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        often = collections.Counter(grams)
        return {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + n)}, max((often[g] * len("".join(g)) for g in often if often[g] > 1), default=0)

    failed = len(words) < 10 or 100 * len(inside(5)[0]) > 20 * len(words)
    kept = not failed and sum(len(w) for x in again for w in repetition._WORD.findall(x)) <= repetition.LINE_LIMIT * max(chars, 1)
    kept = kept and all(sum(len(words[j]) for j in inside(n)[0]) <= most * max(chars, 1) + 1e-9 for n, most in repetition.LIMITS.items())
    kept = kept and all(inside(n)[1] <= most * max(chars, 1) + 1e-9 for n, most in repetition.TOP_LIMITS.items())
    return len(words), chars, sum(c in "#*$%&|<>" for c in text or ""), len(again), len(inside(5)[0]), failed, kept


KEPT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([f"w{i}" for i in range(40)] + ["buy it now", "\n", "same line here\n", "#$ x"]), max_size=90).map(" ".join))
def test_repetition_verdict(text):
    m = repetition.measure(text)
    assert tuple(m[k] for k in KEPT) == plain_verdict(text)


def test_repetition_by_value(spark):
    """Null, empty, repeated and long texts, beside columns named as the measures."""
    texts = [None, "", "a b c", "long " * 300_000, "z" * 1_000_000, " ".join(f"w{i}" for i in range(30))]
    rows = [(i, t, True, 5, "x") for i, t in enumerate(texts)] + [(5, texts[5], True, 5, "x")]
    got = repetition.repetition(spark.createDataFrame(rows, "doc_id long, text string, kept boolean, n_words int, line string")).collect()
    short = sorted((r["doc_id"], *(r[k] for k in KEPT)) for r in got if r["doc_id"] != 3)
    assert short == sorted((i, *plain_verdict(t)) for i, t, *_ in rows if i != 3)
    assert [(r["n_words"], r["n_repeat_words"], r["kept"]) for r in got if r["doc_id"] == 3] == [(300_000, 300_000, False)]


def test_chat_odd_rows(spark):
    """Repeated turns, clashing columns, long texts: all come back."""
    rows = [(1, 0, "user", "q", "seg", 1), (1, 0, "user", "q", "seg", 1), (1, 1, "assistant", "a" * 300_000, "seg", 2), (2, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string, formatted int")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.digests(chat.format_chats(df)).collect()}
    assert got == {1: (3, 300_000), 2: (1, 0)}


def test_urls_long_pages(spark):
    """A page of two million characters and thousands of links, beside a page that repeats."""
    html = "".join(f'<a href="http://h{i % 50}.io/">' for i in range(60_000))
    rows = [(1, "http://a.io/", html), (2, "http://b.net/x", "<p>"), (2, "http://b.net/x", "<p>"), (3, "http://c.io/" + "p" * 100_000, None)]
    got = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"], r["verdict"], len(r["path"])) for r in got) == [(1, "allow", 1), (2, "block", 2), (2, "block", 2), (3, "allow", 100_001)]
