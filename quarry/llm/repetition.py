"""Quality rules on repetition: how much of a text lies inside duplicated n-grams and lines.

Rolling hashes of several n-gram lengths are taken over a text's word numbers in numpy; the
characters of all words inside an n-gram found twice or more are measured against all characters
in words, and so are the characters of repeated lines. Of short n-grams, which any text repeats, only
the one with most characters in its occurrences counts.

Null and empty texts have no words: all counts are 0, base_failed is true and kept false. Repeated
rows are measured alike, each on its own. Texts are measured whole, however long. Other columns of the input are not
looked at, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from quarry.llm.common import map_rows

#: n-gram length: the largest share of word characters that may lie in duplicated n-grams. All are below
#: the base rule's 20% of words in those of length 5.
LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: n-gram length: the largest share of word characters that may lie in one n-gram's occurrences.
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
#: The largest share of word characters in repeated lines.
LINE_LIMIT = 0.30
_WORD = re.compile(r"[^ \t-\r]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_BASE = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_ngram_share double, dup_line_share double"


def _mixed(ids: np.ndarray) -> np.ndarray:
    """Spreads small numbers over 64 bits (splitmix64)."""
    z = ids.astype(np.uint64) * _BASE + _BASE
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def windows(ids: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Each length with the hashes of its n-grams, none if there is at most one; they roll from one length to the next."""
    words = _mixed(ids)
    rolled, length = words, 1
    for want in sorted(lengths):
        while length < want < len(ids):
            rolled = rolled[:-1] * _BASE + words[length:]
            length += 1
        yield want, rolled if want < len(ids) else rolled[:0]


def inside_repeated(hashes: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n words lie in an n-gram found twice or more."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    twice = np.zeros(len(hashes), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    if len(hashes):
        edge[: len(twice)] += twice
        edge[length : length + len(twice)] -= twice
    return np.cumsum(edge[:n]) > 0


def most_in_one(hashes: np.ndarray, length: int, sizes: np.ndarray) -> int:
    """The most characters in the occurrences of one n-gram found twice or more."""
    if not len(hashes):
        return 0
    order = np.argsort(hashes, kind="stable")
    first = np.flatnonzero(np.r_[True, hashes[order][1:] != hashes[order][:-1]])
    counts = np.diff(np.r_[first, len(hashes)])
    ends = np.r_[0, np.cumsum(sizes)]
    chars = (ends[length:] - ends[:-length])[order[first]]
    return int(np.where(counts > 1, counts * chars, 0).max())


def measure(text: str | None) -> dict:
    """The counts, shares and verdicts of one text."""
    text = text or ""
    words = _WORD.findall(text)
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    chars = int(sizes.sum())
    dup_lines = dup_chars = 0
    seen: set[str] = set()
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
            dup_chars += sum(map(len, _WORD.findall(line)))
        elif _WORD.search(line):
            seen.add(line)
    shares: dict[int, float] = {}
    top: dict[int, float] = {}
    repeated = 0
    for n, hashes in windows(ids, [*TOP_LIMITS, *LIMITS]):
        if n in TOP_LIMITS:
            top[n] = most_in_one(hashes, n, sizes) / max(chars, 1)
        else:
            inside = inside_repeated(hashes, n, len(ids))
            shares[n] = float(sizes[inside].sum()) / max(chars, 1)
            repeated = int(inside.sum()) if n == 5 else repeated
    line_share = dup_chars / max(chars, 1)
    failed = len(words) < 10 or 100 * repeated > 20 * len(words)
    return {
        "n_words": len(words), "word_chars": chars, "n_symbols": len(_SYMBOL.findall(text)), "n_dup_lines": dup_lines, "n_repeat_words": repeated, "base_failed": failed,
        "kept": not failed and line_share <= LINE_LIMIT and all(shares[n] <= most for n, most in LIMITS.items()) and all(top[n] <= most for n, most in TOP_LIMITS.items()), "dup_ngram_share": max(shares.values()), "dup_line_share": line_share,
    }


def repetition(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The measures of every whole text."""

    def start():
        def f(ids, texts):
            made = [measure(t) for t in texts]
            return {"doc_id": ids} | {k: [m[k] for m in made] for k in made[0]} if made else {}

        return f

    return map_rows(docs, [docs[id_column].cast("long"), docs[text_column]], SCHEMA, start)
