"""Toxicity: Levenshtein automata over a lexicon trie, and context windows.

The lexicon is learned from labelled documents: words, and word beginnings that stand for a whole
family of words, whose document frequency among toxic texts is too high for chance. It is held in a
trie. A text's distinct words are run through the trie together with a Levenshtein automaton, which
finds terms that are misspelled by one edit; of a beginning, it looks for the words of its family that
several toxic texts have. Words that clean texts have of their own aren't taken for misspelled. What
stands around a hit then tells abuse from quotation: a hit inside paired quotation marks or after a word
of reporting counts for less, one beside a second person for more. A logistic regression turns a text's hits into a score; it learns from each text as it is and as if
its hits were misspelled, since few texts of a sample show a misspelling.

Learning takes at most `per_class` texts of each label, by a hash of the id, and looks at equal ones once,
with their highest label; the lexicon ends where no term is telling enough any more. Null and empty texts
have no hits and get the score of a text without hits, and with nothing to learn from, or no telling term, every
score is 0. Texts
are read whole, however long. Other columns of the inputs are not looked at, whatever their names. A document labelled more than once has its highest
label, null labels don't count. Repeated rows are scored alike. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, map_rows, unit, written

PER_CLASS = 4000
#: A term's log-likelihood ratio must be at least this, and it must be this much likelier in toxic texts.
LEAST_RATIO, LEAST_LIFT = 18.0, 8.0
BEGINNINGS = (4, 5, 6)
#: Terms of at least this length are also found at one edit; the rest only as they are.
FUZZY_LENGTH = 5
#: A beginning's words are looked for at one edit if so many toxic texts have them, and a word of so many clean
#: texts can be no misspelling: what one text has may itself be one.
FAMILY_TEXTS = 2
CACHE_WORDS = 50_000
WINDOW = 3
# Words that report or mention speech, and second persons, in the languages of the tables.
REPORTING = frozenset("said says called calls wrote quote quoted word term dit disait mot sagte nannte wort dijo llamó palabra".split())
SECOND = frozenset("you your youre u du dein dich ihr euch tu toi ton vous votre usted tú ti".split())
_TOKEN = re.compile(r"[^\W_]+")
# Each opening quotation mark with the marks that close it.
QUOTES = {'"': '"', "\u201c": "\u201d", "\u201e": "\u201c\u201d", "\u00ab": "\u00bb", "\u00bb": "\u00ab", "\u201a": "\u2018\u2019", "\u2018": "\u2019"}
_MARK = re.compile("[\n" + "".join(sorted(set("".join(QUOTES) + "".join(QUOTES.values())))) + "]")


def quotations(text: str) -> list[tuple[int, int]]:
    """Where quotations begin and end: a mark that opens one is paired with the next that closes it in its line."""
    spans: list[tuple[int, int]] = []
    opened, at = "", 0
    for m in _MARK.finditer(text):
        mark = m[0]
        if mark == "\n":
            opened = ""
        elif opened and mark in QUOTES[opened]:
            spans.append((at, m.start()))
            opened = ""
        elif not opened and mark in QUOTES:
            opened, at = mark, m.end()
    return spans


def build_trie(terms: dict[str, int]) -> dict:
    """Nested dicts by character; the number of a term stands under the empty string."""
    root: dict = {}
    for term, number in terms.items():
        node = root
        for ch in term:
            node = node.setdefault(ch, {})
        node[""] = number
    return root


def within_one(trie: dict, word: str) -> list[int]:
    """The terms at most one edit from word.

    The automaton's state is the set of (position in word, edits so far); it walks the trie and drops
    a branch as soon as no state is left.
    """
    found: set[int] = set()
    n = len(word)
    stack = [(trie, 0, 0)]
    seen: set[tuple[int, int, int]] = set()
    while stack:
        node, at, edits = stack.pop()
        if (key := (id(node), at, edits)) in seen:
            continue
        seen.add(key)
        if "" in node and n - at + edits <= 1:
            found.add(node[""])
        if at < n and (below := node.get(word[at])) is not None:
            stack.append((below, at + 1, edits))
        if not edits:
            if at < n:
                stack.append((node, at + 1, 1))  # a character too many
            for ch, below in node.items():
                if ch:
                    stack.append((below, at, 1))  # one too few
                    if at < n:
                        stack.append((below, at + 1, 1))  # another one
    return sorted(found)


class Matcher:
    """word -> (term number, exact?) or None. Words that share neither half with a term are passed by: an edit leaves one half whole."""

    def __init__(self, words: list[str], beginnings: list[str], family: list[str], plain: list[str], reporting: frozenset[str] = REPORTING, second: frozenset[str] = SECOND):
        self.reporting, self.second = reporting, second
        self.exact = {w: i for i, w in enumerate(words)}
        self.beginnings = {b: len(words) + i for i, b in enumerate(beginnings)}
        self.sizes = sorted({len(b) for b in beginnings})
        self.fuzzy = {w: i for w in family if (i := self.begun(w)) is not None and len(w) >= FUZZY_LENGTH}
        self.fuzzy |= {w: i for w, i in self.exact.items() if len(w) >= FUZZY_LENGTH}
        self.plain = frozenset(plain)
        self.trie = build_trie(self.fuzzy)
        self.heads = {w[: len(w) // 2] for w in self.fuzzy}
        self.tails = {w[len(w) // 2 :] for w in self.fuzzy}
        self.head_sizes = sorted({len(x) for x in self.heads})
        self.tail_sizes = sorted({len(x) for x in self.tails})
        self.known: dict[str, tuple[int, bool] | None] = {}

    def begun(self, word: str) -> int | None:
        """The number of word's shortest beginning in the lexicon."""
        return next((i for k in self.sizes if (i := self.beginnings.get(word[:k])) is not None), None)

    def find(self, word: str) -> tuple[int, bool] | None:
        if (i := self.exact.get(word)) is not None or (i := self.begun(word)) is not None:
            return i, True
        if len(word) >= FUZZY_LENGTH - 1 and word not in self.plain and (any(word[:k] in self.heads for k in self.head_sizes) or any(word[-k:] in self.tails for k in self.tail_sizes)):
            near = within_one(self.trie, word)
            if near:
                return near[0], False
        return None

    def hits(self, words: set[str]) -> dict[str, tuple[int, bool]]:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in words.difference(known):
            known[w] = self.find(w)
        return {w: hit for w in words if (hit := known[w]) is not None}


def context_weight(text: str, start: int, end: int, quoted: bool, reporting: frozenset[str] = REPORTING, second: frozenset[str] = SECOND) -> float:
    """1 for a bare hit, a quarter in a quotation or after a word of reporting, half as much again beside a second person."""
    before = _TOKEN.findall(text[max(0, start - 60) : start])[-WINDOW:]
    after = _TOKEN.findall(text[end : end + 60])[:WINDOW]
    weight = 0.25 if quoted or not reporting.isdisjoint(before) else 1.0
    return weight * (1.0 if second.isdisjoint(before) and second.isdisjoint(after) else 1.5)


def features(text: str | None, matcher: Matcher, misspelled: bool = False) -> list[float]:
    """Logs of the text's weighted hits: words as they are, misspelled ones, distinct terms, hits a word.

    misspelled: as if each hit had an edit, where the automaton looks for its word.
    """
    low = (text or "").lower()
    words = set(_TOKEN.findall(low))
    hits = matcher.hits(words)
    if misspelled:
        hits = {w: (i, exact and w not in matcher.fuzzy) for w, (i, exact) in hits.items()}
    if not hits:
        return [0.0, 0.0, 0.0, 0.0]
    exact = fuzzy = 0.0
    total = 0
    spans = quotations(low)
    starts = [x for x, _ in spans]
    for m in _TOKEN.finditer(low):
        total += 1
        if (hit := hits.get(m[0])) is not None:
            span = bisect.bisect_right(starts, m.start()) - 1
            w = context_weight(low, m.start(), m.end(), span >= 0 and m.end() <= spans[span][1], matcher.reporting, matcher.second)
            exact, fuzzy = (exact + w, fuzzy) if hit[1] else (exact, fuzzy + w)
    terms = len({h[0] for h in hits.values()})
    return [math.log1p(exact), math.log1p(fuzzy), math.log1p(terms), 10 * min(0.1, (exact + fuzzy) / total)]


@dataclass
class Model:
    words: list[str]
    beginnings: list[str]
    family: list[str]
    plain: list[str]
    reporting: frozenset[str]
    second: frozenset[str]
    weights: list[float]
    bias: float

    def scorer(self):
        matcher, weights = Matcher(self.words, self.beginnings, self.family, self.plain, self.reporting, self.second), self.weights

        def f(text: str | None) -> float:
            z = self.bias + sum(a * b for a, b in zip(weights, features(text, matcher), strict=True))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return f


def ratio_column(n: int, m: int) -> Column:
    """likelihood_ratio of the columns a and b."""

    def part(k: Column, expected: Column) -> Column:
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)

    a, b = F.col("a"), F.col("b")
    rate = (a + b) / F.lit(float(n + m))
    return 2 * (part(a, n * rate) + part(b, m * rate) + part(n - a, n * (1 - rate)) + part(m - b, m * (1 - rate)))


def likelihood_ratio(a: int, b: int, n: int, m: int) -> float:
    """Of a in n toxic and b in m clean texts against one rate for both."""
    def part(k: float, expected: float) -> float:
        return k * math.log(k / expected) if k else 0.0

    rate = (a + b) / (n + m)
    return 2 * (part(a, n * rate) + part(b, m * rate) + part(n - a, n * (1 - rate)) + part(m - b, m * (1 - rate)))


def terms_of(word: str) -> list[str]:
    """The terms that a word can show: itself, and its beginnings."""
    return ([f"={word}"] if 3 <= len(word) <= 24 else []) + [f"^{word[:k]}" for k in BEGINNINGS if len(word) > k]


def covering(texts: list[list[str]], clean: dict[str, int], n: int, m: int) -> list[str]:
    """Terms picked one by one from the words of n toxic texts, the most telling one in the texts that are still open.

    A text is closed once two of its words are found. So the rare words that copies of one toxic text share
    aren't taken for the lexicon's: the terms that explain all toxic texts have closed these first. Counts
    only fall, and a term's ratio with them, so a heap of ratios, renewed as they come up, gives the best.
    """
    open_ = {i: set(t) for i, t in enumerate(texts)}
    found = [0] * len(texts)
    where: dict[str, list[int]] = defaultdict(list)

    def shown(words: set[str]) -> set[str]:
        return {x for w in words for x in terms_of(w) if x in clean}

    for i, words in open_.items():
        for x in shown(words):
            where[x].append(i)
    counts = {x: len(at) for x, at in where.items()}

    def entry(x: str, place: int) -> list[tuple[float, int, int, str]]:
        """x with its ratio, or nothing if it isn't telling enough, which it won't be again."""
        a, b = counts[x], clean[x]
        return [(-ratio, place, a, x)] if a and a * m >= b * n * LEAST_LIFT and (ratio := likelihood_ratio(a, b, n, m)) >= LEAST_RATIO else []

    heap = [e for place, x in enumerate(sorted(counts, key=lambda x: (x[0] == "=", len(x), x), reverse=True)) for e in entry(x, place)]
    heapq.heapify(heap)
    chosen: list[str] = []
    while heap:
        _, place, a, best = heapq.heappop(heap)
        if a != counts[best]:
            for e in entry(best, place):
                heapq.heappush(heap, e)
            continue
        chosen.append(best)
        for i in where[best]:
            if (words := open_.get(i)) is None or not (got := {w for w in words if best in terms_of(w)}):
                continue
            found[i] += len(got)
            before = shown(words)
            words -= got
            if found[i] >= 2:
                del open_[i]
            for x in before - (shown(words) if found[i] < 2 else set()):
                counts[x] -= 1
    return chosen


def _regression(x: np.ndarray, y: np.ndarray, balance: np.ndarray) -> tuple[list[float], float]:
    """Logistic regression by Newton's steps, with a small ridge; weights of hits are not negative: a feature that gets a negative one is left out and the rest fitted again."""
    used = np.ones(x.shape[1], bool)
    while True:
        a = np.c_[x[:, used], np.ones(len(x))]
        w = np.zeros(a.shape[1])
        ridge = np.r_[np.full(used.sum(), 0.5), 0.01]
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (balance * p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(ridge), a.T @ (balance * (y - p)) - ridge * w)
            w += np.clip(step, -3, 3)
        if (w[:-1] >= 0).all():
            out = np.zeros(x.shape[1])
            out[used] = w[:-1]
            return out.tolist(), float(w[-1])
        used[np.flatnonzero(used)[np.argmin(w[:-1])]] = False


def sample_of(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame | None, dict[int, int]]:
    """doc_id, toxic, text of at most per_class labelled documents of each label, about, and each label's count.

    The sample is drawn among labels; only its ids, bounded by per_class, are sent to the documents. Equal
    texts give one row.
    """
    best = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in best.groupBy("toxic").count().collect()}
    if not counts.get(1) or not counts.get(0):
        return None, counts
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, per_class / counts[1]))).otherwise(F.lit(min(1.0, per_class / counts[0])))
    ids = sorted(tuple(r) for r in best.filter(unit("doc_id", "toxicity") < share).collect())
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, toxic int")
    texts = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    drawn = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    once = drawn.groupBy(F.sha2("text", 256).alias("_digest")).agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"), F.min("text").alias("text")).drop("_digest")
    return written(once, "toxic-sample"), counts


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, reporting: frozenset[str] = REPORTING, second: frozenset[str] = SECOND) -> Model | None:
    """Terms and weights from at most per_class labelled documents of each label, about; reporting and second are the words that tell contexts."""
    sample, counts = sample_of(docs, labels, per_class)
    seen = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()} if sample is not None else {}
    n, m = seen.get(1, 0), seen.get(0, 0)
    if not n or not m:
        return None

    def start():
        def f(_, labels, texts):
            out: dict[str, list] = {"term": [], "toxic": []}
            for y, t in zip(labels, texts, strict=True):
                terms = {x for w in set(_TOKEN.findall(t.lower())) for x in terms_of(w)}
                out["term"] += terms
                out["toxic"] += [y] * len(terms)
            return out

        return f

    terms = map_rows(sample, [F.col("doc_id").cast("long"), F.col("toxic").cast("int"), F.col("text")], "term string, toxic int", start, rows=32)
    counted = terms.groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    likely = counted.filter((F.col("a") * m >= F.col("b") * (n * LEAST_LIFT)) & (ratio_column(n, m) >= LEAST_RATIO))
    clean = {r["term"]: r["b"] for r in likely.select("term", "b").collect()}

    def words_of():
        def f(texts):
            return {"words": [[w for w in set(_TOKEN.findall(t.lower())) if any(x in clean for x in terms_of(w))] for t in texts]}

        return f

    rows_ = map_rows(sample.filter("toxic = 1"), [F.col("text")], "words array<string>", words_of, rows=128).collect()
    chosen = covering([r["words"] for r in rows_], clean, n, m)
    if not chosen:
        discard(sample)
        return None
    words, beginnings = [t[1:] for t in chosen if t[0] == "="], [t[1:] for t in chosen if t[0] == "^"]
    begun = F.lit(False)
    for k in BEGINNINGS:
        begun |= F.substring("term", 2, k).isin([b for b in beginnings if len(b) == k])
    often = counted.filter(F.col("term").startswith("=") & begun & (F.col("a") >= FAMILY_TEXTS) & (F.col("a") * m >= F.col("b") * (n * LEAST_LIFT)))
    family = sorted(r["term"][1:] for r in often.select("term").collect()) if beginnings else []

    def edited_words():
        matcher = Matcher(words, beginnings, family, [])

        def f(labels, texts):
            found = [(w, y) for y, t in zip(labels, texts, strict=True) for w, (_, exact) in matcher.hits(set(_TOKEN.findall(t.lower()))).items() if not exact]
            return {"term": [w for w, _ in found], "toxic": [y for _, y in found]}

        return f

    edited = map_rows(sample, [F.col("toxic").cast("int"), F.col("text")], "term string, toxic int", edited_words, rows=128)
    common = edited.groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).filter((F.col("b") >= FAMILY_TEXTS) & (F.col("a") * m < F.col("b") * (n * LEAST_LIFT)))
    plain = sorted(r["term"] for r in common.select("term").collect())
    matcher_args = (words, beginnings, family, plain, reporting, second)

    def rows():
        matcher = Matcher(*matcher_args)

        def f(ids, labels, texts):
            return {"doc_id": ids * 2, "toxic": labels * 2, "x": [features(t, matcher, edited) for edited in (False, True) for t in texts]}

        return f

    made = map_rows(sample, [F.col("doc_id").cast("long"), F.col("toxic").cast("int"), F.col("text")], "doc_id long, toxic int, x array<double>", rows, rows=128).collect()
    made.sort(key=lambda r: (str(r["doc_id"]), r["toxic"], r["x"]))
    y = np.array([r["toxic"] for r in made], float)
    balance = np.where(y == 1, counts[1] / n, counts[0] / m)  # as in all of train
    weights, bias = _regression(np.array([r["x"] for r in made]), y, balance / balance.mean() / 2)  # each text is there twice
    discard(sample)
    return Model(*matcher_args, weights, bias)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score of every whole text."""

    def start():
        scorer = model.scorer() if model else lambda _: 0.0
        return lambda ids, texts: {"doc_id": ids, "score": [scorer(t) for t in texts]}

    return map_rows(docs, [F.col("doc_id").cast("long"), F.col("text")], "doc_id long, score double", start)


def score_column(text: Column, model: Model | None) -> Column:
    """The score beside a document's other columns."""

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = model.scorer() if model else lambda _: 0.0
        for batch in batches:
            yield pa.array([scorer(t) for at in range(0, len(batch), 256) for t in batch.slice(at, 256).to_pylist()], pa.float64())

    return scores(text)
