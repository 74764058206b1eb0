"""The Jaccard join: large groups, equal ids, connected links, derived answers, what it leaves behind."""

from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_llm import brute_components, components

from quarry.llm import jaccard
from quarry.llm.common import giving_back, shared_dir


def near_copies(count: int, size: int, edits: int, seed: int) -> list[str]:
    """Copies of one text, some words of each changed, each with a line that all texts have."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(count):
        words = [f"s{seed}w{j}" for j in range(size)]
        for at in rng.integers(0, size, rng.integers(0, edits + 1)):
            words[at] = f"x{rng.integers(10_000)}"
        out.append(" ".join(words) + "\none line that every text of this test has")
    return out


def test_large_group(spark):
    """2,000 near copies of one text, and texts with nothing but a line in common."""
    texts = near_copies(2000, 60, 2, 1) + [f"one line that every text of this test has {i} {i + 1} {i + 2} {i + 3}" for i in range(300)]
    rows = list(enumerate(texts))
    found = components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert found == components_by_lists(rows)
    assert 300 < len({c for *_, c in found}) < 1000


def components_by_lists(rows):
    """brute_components, but only pairs that share a shingle are looked at, and only if not connected yet."""
    sets = []
    for _, t in rows:
        w = t.encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    up, index = list(range(len(rows))), {}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for x in s for j in index.get(x, ())}:
            if root(i) != root(j) and 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
        for x in s:
            index.setdefault(x, []).append(i)
    return sorted(((i, len(s), rows[root(k)][0]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def test_ids_of_few_bits(spark):
    """Different sets of one id are told apart by the other half of their hash."""
    rows = list(enumerate(near_copies(40, 30, 2, 2) + near_copies(40, 30, 2, 3)))
    found = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), bits=3).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == brute_components(rows)


def test_equal_ids_of_different_texts(spark):
    """Rows of one id are judged by their own texts; none is lost because of the other."""
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(5, a, 1), (1, a, 2), (5, b, 3), (None, a, 4), (None, "only this one without an id", 5), (None, "only this one without an id", 5), (7, "", 6), (7, "", 6), (8, None, 7)]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _key int")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, a, 2), (5, b, 3), (None, "only this one without an id", 5), (7, "", 6), (7, "", 6), (8, None, 7)], key=str)


def test_two_texts_of_one_id_in_one_component(spark):
    a = " ".join(f"w{i}" for i in range(40))
    rows = [(3, a, "x"), (3, a + " end", "x"), (4, a, "y")]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(kept) == 1 and kept[0]["doc_id"] == 3
    again = jaccard.one_of_each(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).collect()
    assert kept == again


@pytest.mark.parametrize("few", [0, 10**6])
def test_connected(spark, few):
    rng = np.random.default_rng(7)
    ids = rng.permutation(400).tolist()
    links = list(zip(ids[:100], ids[1:101], strict=False)) + [(ids[150], x) for x in ids[151:250]] + list(zip(ids[260:300], ids[300:340], strict=True)) + [(1, 1)]
    made = jaccard.connected(spark.createDataFrame(links, "a long, b long"), few)
    group = {x: x for link in links[:-1] for x in link}
    for _ in group:
        for a, b in links[:-1]:
            group[a] = group[b] = min(group[a], group[b])
    assert {r["set_id"]: r["label"] for r in made.collect()} == group


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_joined(links):
    a, b = (np.array([x[k] for x in links], np.int64) for k in (0, 1))
    nodes, label = jaccard.joined(a, b)
    found = dict(zip(nodes.tolist(), label.tolist(), strict=True))
    want = {x: {x} for link in links for x in link}
    for x, y in links:
        both = want[x] | want[y]
        for z in both:
            want[z] = both
    assert found == {x: min(group) for x, group in want.items()}


def test_answers_from_leaders(spark):
    """Bounds from the leaders' common tokens settle pairs; those left open are compared."""
    rng = np.random.default_rng(3)
    leaders = [np.arange(0, 50), np.arange(20, 70), np.arange(200, 250)]  # the first two nearly link
    sets = {i: np.unique(np.r_[leaders[i % 3][i // 3 :], rng.integers(0, 70, i // 3)]).astype(np.uint64) for i in range(12)}
    size = lambda x, y: len(np.intersect1d(sets[x], sets[y]))
    links = [(i, i % 3, i % 3, len(sets[i]), len(sets[i % 3]), size(i, i % 3)) for i in range(3, 12)]
    pairs = [(i, j, i, len(sets[i]), len(sets[j])) for i in sets for j in sets if i < j]
    asked = []

    class Compared:
        percent = 50

        def of(self, df, linked=True):
            rows = [(r.a, r.b, r.lead, r.n_a, r.n_b, size(r.a, r.b)) for r in df.collect()]
            asked.append(len(rows))
            rows = [r for r in rows if not linked or 150 * r[5] >= 50 * (r[3] + r[4])]
            return jaccard.written(spark.createDataFrame(rows, SCHEMA), "compared")

    schema = "a long, b long, lead long, n_a long, n_b long"
    SCHEMA = schema + ", common long"
    found, tables = jaccard.derived(spark.createDataFrame(pairs, schema), [spark.createDataFrame(links, SCHEMA)], Compared())
    assert sorted(map(tuple, found.collect())) == [(a, b) for a, b, *_ in pairs if 150 * size(a, b) >= 50 * (len(sets[a]) + len(sets[b]))]
    assert sum(asked) < len(pairs)
    jaccard.discard(*tables)


def listed(spark, count: int, size: int, own: int, seed: int):
    """Sets of one family, each with some tokens of its own, and the index lists of their first tokens."""
    rng = np.random.default_rng(seed)
    sets = {i: np.sort(np.r_[rng.permutation(size)[rng.integers(own // 8, own + 1) :], 1000 * (i + 1) + np.arange(rng.integers(own // 8, own + 1))]) for i in range(count)}
    rows = [(int(t), i, len(x), at, i % 50) for i, x in sets.items() for at, t in enumerate(x[: jaccard.prefix_size(len(x), 75)])]
    rows = spark.createDataFrame(rows, "token long, set_id long, n long, position long, label long")
    return sets, rows.join(jaccard.shared_tokens(rows), "token")


def test_alike_sets_meet_about_once(spark):
    """Pairs that share many tokens are not made once for each, and none that links is passed by."""
    sets, rows = listed(spark, 60, 200, 40, 5)
    met = [tuple(r) for r in jaccard.met_pairs(rows, 75).collect()]
    links = {(i, j) for i in sets for j in sets if i < j and i % 50 != j % 50 and 175 * len(np.intersect1d(sets[i], sets[j])) >= 75 * (len(sets[i]) + len(sets[j]))}
    assert links and links <= set(met)
    assert len(met) <= 3 * len(set(met))
    assert sorted((r["a"], r["b"]) for r in jaccard.open_pairs(rows, 75, []).collect()) == sorted(set(met))


def test_no_step_shuffles_much(spark, monkeypatch):
    """A step's shuffle files are all on disk until its table is written; no step has much more of them than the index lists have."""
    sc, shuffled, threshold = spark.sparkContext._jsc.sc(), [], "spark.sql.autoBroadcastJoinThreshold"
    quantiles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(None, False, False, quantiles, None)
        return {x.stageId(): x.shuffleWriteBytes() for x in map(found.apply, range(found.size()))}

    def watched(df, name, write=jaccard.written):
        before, out = stages(), write(df, name)
        shuffled.append((name, sum(n for k, n in stages().items() if k not in before)))
        return out

    monkeypatch.setattr(jaccard, "written", watched)
    texts = [x for seed in range(20) for x in near_copies(60, 200, 12, seed)]
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        jaccard.components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    finally:
        spark.conf.set(threshold, before)
    assert max(n for _, n in shuffled) <= 1.4 * dict(shuffled)["lists"], shuffled


def test_workers_give_memory_back():
    """What a task has freed inside the heap is no longer held once it has ended."""
    rss = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * 4096
    left = []

    def run(batches):
        held = [bytearray(b"x" * 60_000) for _ in range(4000)]
        left.append(bytearray(b"x" * 60_000))  # above the others: the heap can't shrink by itself
        del held
        left.append(rss())
        yield from batches

    before = rss()
    assert list(giving_back(run)(iter([1]))) == [1]
    assert rss() < before + 60_000_000


def test_counts_of_tokens(spark):
    """Tokens of more than one set are counted once a set."""
    texts = near_copies(50, 20, 2, 6) * 2
    rows = jaccard.measured(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), 5).filter("token is not null").collect()
    want = Counter(t for s in {tuple(jaccard.tokens(x).view(np.int64).tolist()) for x in texts} for t in s)
    assert {r["token"]: r["seen"] for r in rows} == {t: n for t, n in want.items() if n > 1}


def test_scratch_tables_go(spark):
    """Only the tables that the result reads are left, and no shuffle files setting."""
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("quarry-*"))
    jaccard.components(spark.createDataFrame(list(enumerate(near_copies(60, 40, 3, 4))), "doc_id long, text string")).collect()
    assert sorted(p.name.split("-")[1] for p in set(folder.glob("quarry-*")) - before) == ["measured", "named"]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
