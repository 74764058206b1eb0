"""The ten operators against brute force, libraries, round trips and held-out rows; null, empty, long and repeated texts."""

import hashlib
import itertools

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import bpe, chat, fingerprint, jaccard, langid, mixing, repetition, toxicity, urlfilter, warc
from quarry.llm.queries import QUERIES, RANKS, SQL

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, range int, size int"
TEXTS = [None, "", " \n\t", "one two", "One TWO", "a b c d e f g h i j k l", "a b c d e f g h i j k l", "a b c d e f g h i j k m", "é" * 3, "x " * 20000, "y" * 30000, "line\nline\nline one", "é" * 3, "a b c d e f g h i j k l m n o p q r s t u v w"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, long and repeated texts, a null id, sources and clashing columns."""
    rows = [(i if i != 8 else None, t, None if i % 3 else "en", None if i % 5 == 0 else f"s{i % 2}", len(t or ""), 1, 2) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5]], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    made, want = QUERIES[name](spark, SF), con.sql(SQL[name])
    assert sorted(made.columns) == sorted(want.columns)
    pick = lambda rows, names: sorted(repr([r[names.index(c)] for c in sorted(names)]) for r in rows)
    assert pick(made.collect(), made.columns) == pick(want.fetchall(), want.columns)


def test_fingerprints(spark, odd, empty):
    rows = sorted(((i, t or "") for i, t in [*enumerate(TEXTS), (5, TEXTS[5])] if i != 8), key=lambda r: (-r[0], r[1])) + [(None, TEXTS[8])]
    want = [(i, hashlib.sha256(fingerprint.edited(t, rows[(k + 1) % len(rows)][1]).encode()).hexdigest(), fingerprint.digest(t)) for k, (i, t) in enumerate(rows)]
    got = fingerprint.fingerprints(odd).collect()
    assert sorted(((r["doc_id"], r["edited_sha256"], r["fingerprint"]) for r in got), key=str) == sorted(want, key=str)
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    assert fingerprint.fingerprints(empty).collect() == []
    made = QUERIES["op1_fingerprints"](spark, SF).toPandas()
    assert (made.near_edited > made.near_next).mean() > 0.95
    assert fingerprint.likeness(fingerprint.digest(""), fingerprint.digest("abc def ghi")) < 0.5


def test_toxicity(spark, odd, empty):
    docs = [(i, f"some plain words about number {i} and a thing" + (" you dreadfool person" if i % 4 == 0 else ""), None, None, 0, 0, 0) for i in range(200)]
    docs += [(1000, "what a dreadfol day", None, None, 0, 0, 0), (1001, 'they said "dreadfool" once', None, None, 0, 0, 0), (1002, None, None, None, 0, 0, 0), (1003, "you dreadfool", None, None, 0, 0, 0)]
    df = spark.createDataFrame(docs, DOCS)
    labels = df.filter("doc_id < 200").select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(df, labels.unionByName(labels))
    assert "dreadfool" in model.words + model.beginnings or any("dreadfool".startswith(b) for b in model.beginnings)
    score = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert score[0] > 0.5 > score[1] and score[1002] == score[1] and score[1003] > score[1001]
    assert {r["score"] for r in toxicity.score(odd, None).collect()} == {0.0}
    assert toxicity.fit(empty, labels.limit(0)) is None and toxicity.score(empty, model).collect() == []


def test_toxicity_misspelled(spark):
    """Words misspelled by one edit, also inside the beginning that stands for their family, are as telling as the words."""
    family = ["gorblak", "gorblimor", "gorbluster", "gorblendan"]
    rows = [(i, f"some plain words about number {i} and a thing" + (f" {family[i // 4 % 4]}" if i % 4 == 0 else "")) for i in range(200)]
    rows += [(1000, "some plain words and a grblimor"), (1001, "a gxrbluster here"), (1002, "a goorblendan here"), (1003, "a gorblmor here"), (1004, "a gobble and a garble here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(df, df.filter("doc_id < 200").select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")))
    assert "gorbl" in [b[:5] for b in model.beginnings] or "gorb" in model.beginnings
    score = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert all(score[i] >= 0.5 for i in range(1000, 1004)) and score[1004] == score[1] < 0.5
    plain = [(i, f"some plain words about number {i} and a thing" + (" you dreadfool person" if i % 4 == 0 else "")) for i in range(200)] + [(1000, "what a dreadfol day")]
    df = spark.createDataFrame(plain, "doc_id long, text string")
    model = toxicity.fit(df, df.filter("doc_id < 200").select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")))
    assert toxicity.score(df.filter("doc_id = 1000"), model).first()["score"] >= 0.5


def test_toxicity_lexicon_past_copies(spark):
    """60 copies of one toxic text of 5,200 words, whose beginnings differ, don't take the places of the word in 20 other toxic texts."""
    abc = "abcdefghijklmnopqrst"
    long_text = " ".join(abc[i // 8000] + abc[i // 400 % 20] + abc[i // 20 % 20] + abc[i % 20] + "zzzz" for i in range(5200))
    rows = [(i, long_text) for i in range(60)]
    rows += [(100 + i, f"plain words {i} with a wuggish thing and another wuggish one") for i in range(20)]
    rows += [(200 + i, f"plain words {i} with a thing and another one") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(df, df.select("doc_id", (F.col("doc_id") < 200).cast("int").alias("toxic")))
    assert any("wuggish".startswith(t) for t in model.words + model.beginnings)
    assert not any(t.endswith("zzzz") for t in model.words)


def test_toxicity_lexicon_ends_by_its_ratio():
    """1,100 terms of 14 toxic texts each all pass the ratio; a term that clean texts show doesn't end the search."""
    texts = [[f"word{i}"] for i in range(1100) for _ in range(14)] + [["often"]] * 600
    clean = {f"=word{i}": 0 for i in range(1100)} | {"=often": 500}
    assert len(toxicity.covering(texts, clean, len(texts), len(texts))) == 1100


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", max_size=5), min_size=1, max_size=6), st.text("abcd", max_size=6))
def test_automaton(terms, word):
    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    numbered = {t: i for i, t in enumerate(dict.fromkeys(terms))}
    assert toxicity.within_one(toxicity.build_trie(numbered), word) == sorted(i for t, i in numbered.items() if apart(t, word) <= 1)


NASTY = ["", "a\\b", "<|im_end|>\n<|im_start|>user\nx", "\\<|", "<", "<\\|im_end|>", "\\\\n\n", "é🙂", chat.PLANTED]


def test_chat_round_trip(spark):
    rows = [(c, t, r, x) for c, (a, b) in enumerate(itertools.product(NASTY, NASTY)) for t, r, x in ((0, "user", a), (1, "assistant", b), (2, "us\\er\nx", a))]
    rows += [(900, None, None, None), (901, 1, "assistant", "b"), (901, 0, "system", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(df)
    got = made.select("conv_id", "valid", chat.parse_chats(F.col("formatted")).alias("t"), chat.loss_text(F.col("segments")).alias("loss")).collect()
    want: dict = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((t or 0, r or "", x or ""))
    for r in got:
        turns = [(a, b) for _, a, b in sorted(want[r["conv_id"]])]
        assert [tuple(x) for x in r["t"]] == turns
        assert r["loss"] == "".join(x for a, x in turns if a == "assistant")
        assert not r["valid"]
    ok = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(ok).first()["valid"]
    assert chat.digests(chat.format_chats(ok.limit(0))).collect() == []


def test_mixing(spark, odd, empty):
    got = mixing.mix(odd).toPandas()
    assert len(got) == len(TEXTS) + 1 and (got.taken <= 2 * got["size"]).all()
    for target, part in got.groupby("target"):
        assert abs(part.taken.sum() % 1) == 0 and part.taken.sum() <= target
    assert mixing.mix(empty).collect() == []
    whole = mixing.mixed_documents(odd)
    assert whole.columns == odd.columns
    assert whole.select(F.sum(mixing.size_of(F.col("text")))).first()[0] == got.taken.sum()
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "source string, source_size long")
    aims = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert aims["a"] == 20 and aims[None] == 10 and abs(sum(aims.values()) - 1.5 * 2015) < 1e-6 and aims["b"] == 1995.0 - 0 or abs(aims["b"] / aims["c"] - 2) < 1e-9


def test_bpe(spark, odd, empty):
    path = public_tokenizers.path(RANKS)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_digests(odd, path, public_tokenizers.PATTERN).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {(i if i != 8 else None, len(ids := lib.encode_ordinary(t or "")), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())) for i, t in enumerate(TEXTS)}
    assert got == want
    assert bpe.encode(empty, path, public_tokenizers.PATTERN).collect() == []
    words = spark.createDataFrame([(w,) for w in ("", "a", " the", "Unbelievable", "žluťoučký", "🙂!?", "zzzzqqqq")], "word string")
    assert all(r["ids"] == lib.encode_ordinary(r["word"]) for r in bpe.encode_words(words, path).collect())
    assert {r[0] for r in bpe.vocabulary(odd, public_tokenizers.PATTERN).collect()} >= {"one", " two", "é" * 3}


def test_warc(spark, tmp_path):
    html = ["x" * 100, "x" * 100, "x" * 99, "x" * 99, None, "", "é" * 60, "é" * 60, "x" * 100]
    pages = spark.createDataFrame([(20 - i if i != 8 else None, None if i == 1 else "http://a/\r\nb", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.as_records(pages), path)
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.read_back(spark, path).collect()}
    sha = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    refers = {20: 19, 14: 13, None: 19}
    assert got == {p: ("revisit" if p in refers else "response", refers.get(p), len((h or "").encode()), sha(h)) for p, h in zip([*range(20, 12, -1), None], html, strict=True)}
    warc.write_warc(warc.as_records(pages.limit(0)), f"{path}-none")
    assert warc.read_back(spark, f"{path}-none").collect() == []
    plain = b"".join(warc.record({"warc_type": k, "record_id": f"<{k}>", "payload": b"p" * n}) for k, n in (("response", 9000), ("metadata", 3), ("response", 0)))
    (tmp_path / "p.warc").write_bytes(plain)
    import gzip

    (tmp_path / "q.warc.gz").write_bytes(b"".join(gzip.compress(warc.record({"warc_type": k, "record_id": k, "payload": b"z" * 9000})) for k in ("a", "b", "c")))
    assert [len(r["payload"]) for r in warc.read_warc(spark, f"{tmp_path}/p.warc").filter("warc_type = 'response'").collect()] == [9000, 0]
    assert [(r["record_id"], r["payload"]) for r in warc.read_warc(spark, f"{tmp_path}/q.warc.gz", payload=False).collect()] == [("a", None), ("b", None), ("c", None)]
    assert warc.read_warc(spark, f"{tmp_path}/q.warc.gz").filter(F.col("record_id").isin("b", "c")).count() == 2


def test_language(spark, odd, empty):
    made = QUERIES["op7_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (made.lang == made.lang_pred).mean() > 0.95
    assert langid.fit(empty) is None
    got = langid.predict(odd, langid.fit(odd)).toPandas()
    assert set(got.lang_pred[got.doc_id.isin([0, 1, 2])]) == {"und"} and got.score.between(0, 1).all()
    assert langid.predict(empty, None).collect() == []


def test_urls(spark):
    urls = [("https://A.example.net/en/x?q", "example.net/en/", "allow"), ("http://b.net/", "net/", "block"), ("http://b.net", None, "block"), ("http://example.com/de/1", "example.com/de/", "block"), ("http://w.org/fr/#x", "org/fr/", "allow"), ("nourl", None, "allow"), (None, None, "allow"), ("http://spam.io/x", None, "block"), ("http://ok.io/", None, "allow")]
    html = {"http://spam.io/x": '<a href="http://b.net/1"> <a href=\'//b.net/2\'>', "http://w.org/fr/#x": '<a href="https://ok.io/">'}
    pages = spark.createDataFrame([(i, u, html.get(u)) for i, (u, _, _) in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urlfilter.filter_urls(pages).collect()}
    assert [(got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == [(r, v) for _, r, v in urls]
    assert (got[0]["host"], got[0]["path"], got[2]["path"]) == ("a.example.net", "/en/x", "")
    assert got[7]["distrust"] >= 0.125 and got[8]["trust"] > got[8]["distrust"] == 0
    assert urlfilter.filter_urls(pages.limit(0)).collect() == []
    clashing = pages.withColumns({"host": F.lit("x"), "kind": F.lit("block"), "src": F.lit("y"), "score": F.lit(9)})
    assert sorted(map(tuple, urlfilter.filter_urls(clashing.unionByName(clashing)).collect()), key=str) == sorted([*map(tuple, urlfilter.filter_urls(pages.unionByName(pages)).collect())], key=str)


def test_urls_by_links_alone(spark):
    """A quarter of one host's pages is blocked by a rule. What links to it, and its sister, are blocked by the graph only; who is linked from a trusted host isn't."""
    urls = ["http://bad.example.com/de/1", "http://bad.example.com/de/2", "http://bad.example.com/x", "http://farm.io/1", "http://fair.io/1", "http://w.org/fr/1", "http://www.example.com/y", "http://lone.io/"]
    html = {3: '<a href="http://bad.example.com/de/1">' * 6 + '<a href="/de/1">', 5: '<a href="//fair.io/2">', 4: '<a href="http://w.org/">'}
    pages = spark.createDataFrame([(i, u, html.get(i)) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urlfilter.filter_urls(pages).collect()}
    assert [got[i]["verdict"] for i in (2, 3, 4, 7)] == ["block", "block", "allow", "allow"]
    assert got[6]["distrust"] > 0 and got[7]["distrust"] == 0
    bare = {r["page_id"]: r["verdict"] for r in urlfilter.filter_urls(pages.withColumn("html", F.lit(None).cast("string"))).collect()}
    assert bare[3] == "allow"


def dense_ranks(weights, links, turned):
    hosts = sorted({h for a, b, _ in links for h in (a, b)} | set(weights))
    at = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for a, b, n in links:
        a, b = (b, a) if turned else (a, b)
        m[at[b], at[a]] += n
    sums = m.sum(0)
    p = np.array([weights.get(h, 0.0) for h in hosts])
    m = np.where(sums, m / np.where(sums, sums, 1), (p / p.sum())[:, None])  # hosts without edges give back to the seeds
    score = 0.5 * p
    for _ in range(400):
        score = 0.5 * p + 0.5 * m @ score
    return dict(zip(hosts, score, strict=True))


def test_urls_settle(spark):
    """Ranks on a random graph with dead ends and cycles, and on a chain of 20, are those of dense iteration."""
    rng = np.random.default_rng(9)
    links = [(f"h{a}", f"h{b}", int(n)) for a, b, n in zip(rng.integers(0, 30, 70), rng.integers(0, 40, 70), rng.integers(1, 4, 70), strict=True) if a != b] + [(f"c{i + 1}", f"c{i}", 1) for i in range(20)]
    seeds = [("block", "c0", 1.0), ("block", "h3", 0.5), ("block", "h35", 0.1), ("allow", "h1", 0.7), ("allow", "c9", 0.2), ("allow", "alone", 1.0)]
    made = urlfilter.propagate(spark.createDataFrame(seeds, "kind string, host string, weight double"), spark.createDataFrame(links, "src string, dst string, n long"))
    got = {(r["kind"], r["host"]): r["score"] for r in made.collect()}
    for kind in ("allow", "block"):
        want = dense_ranks({h: w for k, h, w in seeds if k == kind}, links, kind == "block")
        assert all(abs(got.get((kind, h), 0.0) - score) < 1e-4 for h, score in want.items())
    assert got["block", "c20"] > 0


def brute_repetition(text):
    words = repetition._WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines = (text or "").split("\n")
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(bool(x.split()) and x in lines[:i] for i, x in enumerate(lines)), len(inside)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c d", "\n", "e\nf", "#$", " é"]), max_size=40).map(" ".join))
def test_repetition(text):
    m = repetition.measure(text)
    assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == brute_repetition(text)
    assert m["base_failed"] == (m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]) and not (m["base_failed"] and m["kept"])


def test_repetition_method_decides():
    """Texts that pass the base rule and only the method rejects: at length 10, and by short repeated phrases; plain ones are kept."""
    plain = [f"word{i}" for i in range(100, 200)]
    again = [f"again{i}" for i in range(9)] + ["x"]
    two = [w for i, w in enumerate(plain) for w in ([w, "buy", "cheapthings"] if i % 5 == 0 else [w])]
    three = [w for i, w in enumerate(plain) for w in ([w, "buy", "it", "now!!!!"] if i % 6 == 0 else [w])]
    four = [w for i, w in enumerate(plain) for w in ([w, "buy", "it", "now", "friends"] if i % 9 == 0 else [w])]
    for words in (plain[:60] + again + plain[60:] + again, two, three, four):
        m = repetition.measure(" ".join(words))
        assert not m["base_failed"] and not m["kept"]
    m = repetition.measure(" ".join(plain[:50] + ["of", "the"] + plain[50:] + ["of", "the"]))
    assert not m["base_failed"] and m["kept"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "ccc", "d"]), max_size=30), st.integers(2, 10))
def test_repetition_windows(words, n):
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids, sizes = np.array([numbers[w] for w in words], np.int64), np.array([len(w) for w in words], np.int64)
    grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    ((_, hashes),) = repetition.windows(ids, [n])
    inside = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + n)}
    assert set(np.flatnonzero(repetition.inside_repeated(hashes, n, len(words)))) == inside
    assert repetition.most_in_one(hashes, n, sizes) == max((grams.count(g) * len("".join(g)) for g in grams if grams.count(g) > 1), default=0)


def test_repetition_rows(odd, empty):
    assert repetition.repetition(odd).count() == len(TEXTS) + 1
    assert repetition.repetition(empty).collect() == []


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    low: dict = {}
    for g, (i, _) in zip(group, rows, strict=True):
        low[g] = min(x for x in (low.get(g), i) if x is not None) if (low.get(g), i) != (None, None) else None
    return sorted(((i, len(s), low[g] if s else i) for (i, _), s, g in zip(rows, sets, group, strict=True)), key=str)


def components(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.components(df).collect()), key=str)


def test_jaccard_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert components(odd) == brute_components(rows)
    assert jaccard.components(empty).collect() == []
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == [0, 1, 2, 3, 5, 9, 10, 11, 12, 13]
    assert kept.filter("doc_id is null").count() == 0  # its copy has an id


def test_jaccard_near_copies(spark):
    rng = np.random.default_rng(5)
    rows, base = [], [f"w{i}" for i in range(60)]
    for g in range(4):
        start = [f"g{g}{w}" for w in base]
        for _ in range(30):
            words = list(start)
            for at in rng.integers(0, 60, rng.integers(0, 4)):
                words[at] = f"x{rng.integers(1000)}"
            rows.append((len(rows), " ".join(words + ["common passage of seven words in all"] * int(rng.integers(0, 2)))))
    rows += [(len(rows) + i, " ".join(f"u{rng.integers(30)}" for _ in range(40)) + " common passage of seven words in all") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert components(df) == brute_components(rows)


@pytest.mark.parametrize("rounds", [True, False])
def test_jaccard_at_the_bound(spark, monkeypatch, rounds):
    """Sets about as alike as the bound, of many sizes; without rounds, the last step finds every link by itself."""
    rng = np.random.default_rng(11)
    rows = []
    for g, size in enumerate((6, 12, 25, 60, 140)):
        base = [f"g{g}w{i}" for i in range(size)]
        for _ in range(24):
            words = list(base)
            for _ in range(rng.integers(0, 1 + max(1, size // 25))):
                words[rng.integers(size)] = f"x{rng.integers(100_000)}"
            cut = rng.integers(0, 1 + size // 6)
            rows.append((len(rows), " ".join(words[cut:] + [f"y{rng.integers(100_000)}" for _ in range(rng.integers(0, 1 + size // 12))])))
    if not rounds:
        monkeypatch.setattr(jaccard, "likeliest", lambda near, *_: near.select(F.col("set_id").alias("a"), F.col("set_id").alias("b"), F.col("set_id").alias("lead")).limit(0))
    found = components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found == brute_components(rows)
    assert 10 < len({c for *_, c in found}) < len(rows)


def test_jaccard_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert components(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows)
