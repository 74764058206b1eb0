"""N-gram Jaccard join: exact links between sets of word shingles, and what they connect.

A prefix-filter join that skips by set relations. Tokens (hashed shingles) have one order: those
seen often come last, the rest by hash; two sets that link share a token among the first of each.
Index lists of these tokens are sorted by block of set size and by position, so that what size or
position rules out is skipped. In each block of a list sets are first held against the block's leader
only. A set that links with a leader gets its other answers from the leader's: what it has beyond the
leader and lacks of it bounds its common tokens with any set from the leader's, and only where the
bounds leave a pair open are its own tokens compared. Pairs of a list that are connected already aren't
looked at, and of the others only those that share enough of their first tokens have sets fetched. No
list's pairs are emitted within one connected group, and every link between groups is found.

The answer is the connected groups, as the smallest id reachable; links inside a group that is
connected without them are neither counted nor returned.

Equal sets are one class from the start. Null and empty texts have no set and are linked with
nothing; a text of fewer words than a shingle has one. Repeated rows are documents of the same
class; of equal ids each row is judged by its own text. A null id takes the class's smallest id, or
stays null. An empty table gives no rows. Texts may be of any length; a set is held whole in one
task, with 8 bytes a shingle. Other columns of the input are not looked at, whatever their names.
Tokens are known by 64-bit hashes, sets by 128 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from quarry.llm.common import WORD, discard, giving_back, map_rows, written

WORDS = 5
#: Tokens counted at least so often come last, at most so many of them, the most frequent ones. Only speed depends on both.
OFTEN, MOST_OFTEN = 16, 1 << 18
#: Tokens whose counts a task adds up before it passes them on.
COUNTED = 1_000_000
#: Rows of so many sets or documents are broadcast at most (16 MB); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Links of so many sets are connected in one task at most (32 MB); more are contracted by rounds of joins first.
FEW_LINKS = 2_000_000
#: With how many block leaders a set is held in each round; after them, all pairs that are left are looked at.
LEADERS = (5, 5)
_B = 0x9E3779B97F4A7C15 | 3
_B_INVERSE = pow(_B, -1, 1 << 64)


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers up to n, and those of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)], dtype=np.uint64) for x in (np.uint64(_B), np.uint64(_B_INVERSE))]
    return _powers[0], _powers[1]


def tokens(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles' hashes, sorted: a polynomial hash of the bytes from the first word's start to the last one's end."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(parts), np.uint8)
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[data] * up[: len(data)], out=sums[1:])
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(data)]
    k = min(words, len(parts))
    first, last = starts[: len(parts) - k + 1], ends[k - 1 :]
    z = (sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique(z ^ (z >> np.uint64(31)))


def set_id(found: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """A set's id, and the other half of its 128-bit hash, which tells sets of one id apart."""
    digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
    own, other = int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
    return own & ((1 << bits) - 1) if bits < 64 else own, other


def told_apart(key: tuple[int, int], clashing: frozenset[int]) -> int:
    """The id under which a set is known: where different sets have one id, both halves together."""
    return key[0] ^ key[1] if key[0] in clashing else key[0]


def prefix_size(n: int, percent: int) -> int:
    """How many first tokens of a set of n any partner must share one of."""
    return n - -(-percent * n // 100) + 1


def measured(docs: DataFrame, words: int, bits: int = 64) -> DataFrame:
    """Rows of doc_id, text_key, set_id, other, n (a document's set; n is 0 without one), and rows of token, seen: how often a task has seen a token more than once, in different sets."""
    out = StructType.fromDDL("doc_id long, text_key long, set_id long, other long, n long, token long, seen long")
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        keys: set[tuple[int, int]] = set()
        size = 0

        def counted() -> pa.RecordBatch:
            found = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear()
            found.sort()
            first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]][: len(found)])
            n = np.diff(first, append=len(found))
            found, n = found[first[n > 1]].view(np.int64), n[n > 1].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64())] * 5 + [pa.array(found), pa.array(n)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids, text_keys, texts = batch.slice(at, 512).columns
                sets, others, sizes = [], [], []
                for text in texts.to_pylist():
                    found = tokens(text, words)
                    key = set_id(found, bits) if len(found) else None
                    sets.append(key and key[0])
                    others.append(key and key[1])
                    sizes.append(len(found))
                    if key is not None and key not in keys:
                        keys.add(key)
                        held.append(found)
                        size += len(found)
                yield pa.RecordBatch.from_arrays([ids, text_keys, pa.array(sets, pa.int64()), pa.array(others, pa.int64()), pa.array(sizes, pa.int64())] + [pa.nulls(len(sets), pa.int64())] * 2, schema=schema)
                if size > COUNTED:
                    yield counted()
                    size = 0
                    keys.clear()
        yield counted()

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text").mapInArrow(giving_back(run), out)


def classes_of(known: DataFrame) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """known with different sets told apart, its classes (set_id, low: the smallest doc_id, rows, n; a written table), and the ids that were given to more sets than one.

    Of N sets some N * N / 2^65 pairs have one id: three of 10^10 sets, so these ids are few.
    """
    grouped = lambda df: df.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"), F.min("other").alias("lo"), F.max("other").alias("hi"))
    classes = written(grouped(known), "classes")
    clashing = frozenset(r["set_id"] for r in classes.filter("lo != hi").select("set_id").collect())
    if clashing:
        known = known.withColumn("set_id", F.when(F.col("set_id").isin(*clashing), F.col("set_id").bitwiseXOR(F.col("other"))).otherwise(F.col("set_id")))
        discard(classes)
        classes = written(grouped(known), "classes")
    return known, classes, clashing


def often(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that are found often, sorted, and how often, about: the tasks' counts added up."""
    sums = counts.groupBy("token").agg(F.sum("seen").alias("n")).filter(F.col("n") >= OFTEN)
    rows = sums.orderBy(F.desc("n"), "token").limit(MOST_OFTEN).toArrow()
    found, n = rows.column("token").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(found)
    return found[order], n[order]


def block_of(n: np.ndarray, percent: int, turn: float) -> np.ndarray:
    """Blocks of sizes of which the largest is less than 100 / percent times the smallest; turns shift their bounds."""
    return np.floor(np.log(n) / math.log(100 / min(percent, 99)) + turn).astype(np.int64)


def postings(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], clashing: frozenset[int], words: int, percent: int, bits: int = 64) -> DataFrame:
    """token, place, n, set_id: each set's first tokens in the order of all; place has the block of the set's size, then the token's position.

    A task passes equal sets on once, so that however many copies of a text there are, its tokens have a row a task.
    """
    shared = docs.sparkSession.sparkContext.broadcast((common, clashing))
    out = StructType.fromDDL("token long, place long, n long, set_id long")
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (late, counts), clashes = shared.value
        keys: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                firsts, sizes, ids = [], [], []
                for text in batch.slice(at, 256).column(0).to_pylist():
                    found = tokens(text, words)
                    n = len(found)
                    if not n or (key := told_apart(set_id(found, bits), clashes)) in keys:
                        continue
                    keys.add(key)
                    if len(late):
                        spot = np.minimum(np.searchsorted(late, found), len(late) - 1)
                        rank = np.where(late[spot] == found, counts[spot], 0)
                        if rank.any():
                            found = found[np.lexsort((found, rank))]
                    firsts.append(found[: prefix_size(n, percent)])
                    sizes.append(n)
                    ids.append(key)
                if len(keys) > 1_000_000:
                    keys.clear()
                if ids:
                    lengths = np.array([len(x) for x in firsts])
                    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                    n = np.repeat(np.array(sizes, np.int64), lengths)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts).view(np.int64)), pa.array((block_of(n, percent, 0) << 32) + place), pa.array(n), pa.array(np.repeat(np.array(ids, np.int64), lengths))], schema=schema)

    return docs.select("text").mapInArrow(giving_back(run), out)


def index_lists(rows: DataFrame) -> DataFrame:
    """token, set_id, n, position, lead, lead_n, lead_position: lists of two sets or more, by block and position.

    lead is the first set of the block: it has this token at the lowest position, so the fewest tokens that
    others lack come before it, and it is the likeliest to link with any of the block. Lists are streamed, however long.
    """
    out = StructType.fromDDL("token long, set_id long, n long, position long, lead long, lead_n long, lead_position long")
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last row, held back until it is known whether its list goes on
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if last is not None:
                cols = [np.r_[x, c] for x, c in zip(last[0], cols, strict=True)]
            token, place, n, ids = cols
            once = np.r_[True, (token[1:] != token[:-1]) | (ids[1:] != ids[:-1])]  # tasks may each have passed on a set
            token, place, n, ids = token[once], place[once], n[once], ids[once]
            fresh = np.r_[True, token[1:] != token[:-1]]
            begins = fresh | np.r_[True, place[1:] >> 32 != place[:-1] >> 32]
            first = np.maximum.accumulate(np.where(begins, np.arange(len(token)), 0))
            lead = [ids[first], n[first], place[first] & 0xFFFFFFFF]
            earlier = ~fresh
            if last is not None:
                for x, value in zip(lead, last[1], strict=True):
                    x[first == 0] = value
                earlier[0] = last[2]
            keep = earlier[:-1] | ~fresh[1:]
            last = ([x[-1:] for x in (token, place, n, ids)], [x[-1] for x in lead], bool(earlier[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep]) for x in (token, ids, n, place & 0xFFFFFFFF, *lead)], schema=schema)
        if last is not None and last[2]:
            token, place, n, ids = last[0]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token, ids, n, place & 0xFFFFFFFF, *([v] for v in last[1]))], schema=schema)

    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "token").sortWithinPartitions("token", "place", "set_id").mapInArrow(giving_back(run), out)


def led(rows: DataFrame, percent: int, turn: float) -> DataFrame:
    """rows (token, set_id, n, position, label) with the leader of the set's block of the list, if that has another label."""
    block = F.floor(F.log("n") / math.log(100 / min(percent, 99)) + F.lit(turn))
    blocks = rows.select("token", "set_id", "n", "position", "label", block.alias("block"))
    first = blocks.groupBy("token", "block").agg(F.min(F.struct("position", "set_id", "n", "label")).alias("first")).filter("first.label is not null")
    return blocks.join(first, ["token", "block"]).filter(F.col("label") != F.col("first.label")).select("token", "set_id", "n", "position", F.col("first.set_id").alias("lead"), F.col("first.n").alias("lead_n"), F.col("first.position").alias("lead_position"))


def first_tokens(lists: DataFrame) -> DataFrame:
    """set_id, n, firsts: each set's first tokens that other sets have too, with their positions, in their order."""
    return lists.groupBy("set_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("position", "token"))).alias("firsts"))


def alike(pairs: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b, lead) that share as many first tokens as linking sets must, and have enough left from the first shared one on; with their sizes n_a, n_b."""
    for side in ("a", "b"):
        pairs = pairs.join(firsts.select(F.col("set_id").alias(side), F.col("firsts").alias(f"firsts_{side}"), F.col("n").alias(f"n_{side}")), side)
    n, m = F.col("n_a"), F.col("n_b")
    pairs = pairs.withColumn("common", F.array_intersect("firsts_a.token", "firsts_b.token")).filter((F.size("common") > 0) & (F.size("common") > least_need(n, m, percent) - 1e-6))
    left = [F.col(f"n_{side}") - F.get(F.col(f"firsts_{side}.position"), (F.array_position(f"firsts_{side}.token", F.get("common", 0)) - 1).cast("int")) for side in ("a", "b")]
    return pairs.filter((100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * F.least(*left) >= percent * (n + m))).select("a", "b", "lead", "n_a", "n_b")


def not_among(pairs: DataFrame, tested: list[DataFrame]) -> DataFrame:
    """pairs (a, b, ...) that no table of tested ones has: one join, however many tables."""
    return pairs.join(reduce(DataFrame.unionByName, (t.select("a", "b") for t in tested)), ["a", "b"], "left_anti") if tested else pairs


def likeliest(near: DataFrame, percent: int, tested: list[DataFrame], most: int) -> DataFrame:
    """a, b, lead: each set and the leaders that it has in most lists, of those that it may link with and wasn't held against."""
    votes = near.filter("lead != set_id").filter(may_link(percent)).select("set_id", "lead", F.least("set_id", "lead").alias("a"), F.greatest("set_id", "lead").alias("b"))
    votes = not_among(votes.groupBy("set_id", "lead", "a", "b").agg(F.count(F.lit(1)).alias("lists")), tested)
    place = F.row_number().over(W.partitionBy("set_id").orderBy(F.desc("lists"), F.desc("lead")))
    return votes.withColumn("place", place).filter(F.col("place") <= most).groupBy("a", "b").agg(F.max("lead").alias("lead"))


def may_link(percent: int):
    """Whether a set and its leader that share this token first may link: sizes are alike, and enough tokens are left behind the positions."""
    n, m = F.col("n"), F.col("lead_n")
    left = F.least(n - F.col("position"), m - F.col("lead_position"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * left >= percent * (n + m))


def fetched(docs: DataFrame, ids: DataFrame, classes: DataFrame, clashing: frozenset[int], words: int, bits: int = 64) -> DataFrame:
    """set_id, tokens of the sets in ids (set_id), and maybe of some more; a few may come twice.

    One document stands for each set, the one with the smallest id. Few ids are broadcast, by their number; else they and the texts are shuffled.
    """
    wanted = written(classes.join(ids, "set_id", "left_semi").select(F.xxhash64("low").alias("slot")).distinct(), "wanted")
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("slot"), "text")
    rows = rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "slot", "left_semi")

    def start():
        keys: set[int] = set()

        def f(texts):
            out: dict[str, list] = {"set_id": [], "tokens": []}
            for text in texts:
                found = tokens(text, words)
                if len(found) and (key := told_apart(set_id(found, bits), clashing)) not in keys:
                    keys.add(key)
                    out["set_id"].append(key)
                    out["tokens"].append(found.view(np.int64))
            if len(keys) > 1_000_000:
                keys.clear()
            return out

        return f

    made = written(map_rows(rows, [F.col("text")], "set_id long, tokens array<long>", start, rows=64), "sets")
    discard(wanted)
    return made


class Compared:
    """Whole sets of docs, fetched and compared."""

    def __init__(self, docs: DataFrame, classes: DataFrame, clashing: frozenset[int], words: int, percent: int, bits: int = 64):
        self.percent, self._fetch = percent, lambda ids: fetched(docs, ids, classes, clashing, words, bits)

    def of(self, pairs: DataFrame, linked: bool = True) -> DataFrame:
        """pairs (a, b, lead, n_a, n_b) with common, the number of tokens that both have, as a written table; linked: only of sets that link.

        The pairs are read three times, so they are written first: made once, and their shuffles are gone before sets are fetched.
        """
        pairs = written(pairs, "asked")
        ids = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
        sets = self._fetch(ids)
        both = pairs.join(sets.select(F.col("set_id").alias("b"), F.col("tokens").alias("y")), "b").join(sets.select(F.col("set_id").alias("a"), F.col("tokens").alias("x")), "a")
        both = both.select("a", "b", "lead", "n_a", "n_b", F.size(F.array_intersect("x", "y")).cast("long").alias("common"))
        out = written(both.filter((100 + self.percent) * F.col("common") >= self.percent * (F.col("n_a") + F.col("n_b"))) if linked else both, "compared")
        discard(sets, pairs)
        return out


def derived(pairs: DataFrame, links: list[DataFrame], compared: Compared) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) among pairs (a, b, lead, n_a, n_b), and the written tables that they are in.

    A set that links with a leader takes its answers from the leader's: what it has beyond the leader and lacks
    of it is known, so of the leaders' common tokens follow bounds of its own ones with any set, or with those that
    follow another leader. The leaders are compared, and of the pairs only those that their bounds leave open.
    """
    mine = [t.select(F.when(F.col("lead") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("set_id"), "lead", "common", "n_a", "n_b", (F.col("lead") == F.col("a")).alias("first")) for t in links]
    guides = None
    if mine:
        own, its = F.when(F.col("first"), F.col("n_b")).otherwise(F.col("n_a")), F.when(F.col("first"), F.col("n_a")).otherwise(F.col("n_b"))
        rows = reduce(DataFrame.unionByName, mine).select("set_id", F.struct((F.col("common") / (own + its - F.col("common"))).alias("share"), "lead", (own - F.col("common")).alias("more"), (its - F.col("common")).alias("less"), its.alias("size")).alias("guide"))
        guides = written(rows.groupBy("set_id").agg(F.max("guide").alias("guide")).select("set_id", "guide.lead", "guide.more", "guide.less", "guide.size"), "guides")
    for side in ("a", "b"):
        if guides is not None:
            pairs = pairs.join(guides.select(F.col("set_id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("lead", "more", "less", "size"))), side, "left")
        else:
            pairs = pairs.withColumns({f"{c}_{side}": F.lit(None).cast("long") for c in ("lead", "more", "less", "size")})
        pairs = pairs.withColumns({f"lead_{side}": F.coalesce(f"lead_{side}", side), f"more_{side}": F.coalesce(f"more_{side}", F.lit(0)), f"less_{side}": F.coalesce(f"less_{side}", F.lit(0)), f"size_{side}": F.coalesce(f"size_{side}", f"n_{side}")})
    turned = F.col("lead_a") > F.col("lead_b")
    pairs = pairs.withColumns({"x": F.least("lead_a", "lead_b"), "y": F.greatest("lead_a", "lead_b"), "n_x": F.when(turned, F.col("size_b")).otherwise(F.col("size_a")), "n_y": F.when(turned, F.col("size_a")).otherwise(F.col("size_b"))})
    pairs = written(pairs.select("a", "b", "n_a", "n_b", "x", "y", "n_x", "n_y", (F.col("more_a") + F.col("more_b")).alias("more"), (F.col("less_a") + F.col("less_b")).alias("less")), "guided")
    leaders = compared.of(pairs.filter("x != y").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.max("x").alias("lead"), F.max("n_x").alias("n_a"), F.max("n_y").alias("n_b")), linked=False)
    known = pairs.join(leaders.select(F.col("a").alias("x"), F.col("b").alias("y"), "common").distinct(), ["x", "y"], "left").withColumn("common", F.coalesce("common", F.when(F.col("x") == F.col("y"), F.col("n_x"))))
    links_if = lambda common: (100 + compared.percent) * common >= compared.percent * (F.col("n_a") + F.col("n_b"))
    judged = written(known.withColumns({"sure": links_if(F.col("common") - F.col("less")), "may": links_if(F.col("common") + F.col("more"))}).filter("may").select("a", "b", F.col("a").alias("lead"), "n_a", "n_b", "sure"), "judged")
    tables = [judged]
    found = judged.filter("sure").select("a", "b")
    if not (rest := judged.filter("not sure").drop("sure")).isEmpty():
        tables.append(compared.of(rest))
        found = found.unionByName(tables[-1].select("a", "b"))
    discard(pairs, leaders, *([guides] if guides is not None else []))
    return found, tables


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of links a-b, and for each the smallest node that it reaches: labels hook onto lower ones, then jump to their labels' labels."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while (label[x] != label[y]).any():
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def connected(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """set_id, label of the sets in links (a, b): the smallest id reachable, as a written table.

    While there are more links than one task may take, each set is put in the place of its smallest
    neighbour and links inside such a group are dropped; groups that are complete have no links left. The rest is connected in one task.
    """
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    steps: list[DataFrame] = []
    while edges.count() > few:
        low = edges.groupBy(F.col("b").alias("set_id")).agg(F.min("a").alias("onto"))
        steps.append(written(low, "steps"))
        ends = edges
        for side in ("a", "b"):
            ends = ends.join(steps[-1].select(F.col("set_id").alias(side), F.col("onto").alias(f"onto_{side}")), side, "left").withColumn(f"onto_{side}", F.coalesce(f"onto_{side}", side))
        after = written(ends.filter("onto_a != onto_b").select(F.least("onto_a", "onto_b").alias("a"), F.greatest("onto_a", "onto_b").alias("b")).distinct(), "edges")
        discard(edges)
        edges = after

    out = StructType.fromDDL("set_id long, label long")
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        nodes, label = joined(*(table.column(c).to_numpy() for c in ("a", "b")))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(label)], schema=schema)

    labels = written(edges.select("a", "b").coalesce(1).mapInArrow(giving_back(run), out), "labels")
    discard(edges)
    for step in reversed(steps):
        passed = step.join(labels.select(F.col("set_id").alias("onto"), "label"), "onto", "left").select("set_id", F.coalesce("label", "onto").alias("label"))
        after = written(passed.unionByName(labels).unionByName(passed.select(F.col("label").alias("set_id"), "label")).groupBy("set_id").agg(F.min("label").alias("label")), "labels")
        discard(labels, step)
        labels = after
    return labels


def relabelled(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """labels (set_id, label) with the links found (a, b) added: only the groups that these join are connected anew. labels is discarded if others take its place."""
    if labels is None:
        return connected(found)
    if found.isEmpty():
        return labels
    ends = found.select("a", "b")
    for side in ("a", "b"):
        ends = ends.join(labels.select(F.col("set_id").alias(side), F.col("label").alias(f"label_{side}")), side, "left").withColumn(f"label_{side}", F.coalesce(f"label_{side}", side))
    onto = connected(ends.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    moved = onto.select(F.col("set_id").alias("label"), F.col("label").alias("onto"))
    groups = labels.join(moved, "label", "left").select("set_id", F.coalesce("onto", "label").alias("label"))
    fresh = onto.join(labels.select("set_id"), "set_id", "left_anti")
    after = written(groups.unionByName(fresh), "labels")
    discard(labels, onto)
    return after


def linked_sets(docs: DataFrame, classes: DataFrame, clashing: frozenset[int], common: tuple[np.ndarray, np.ndarray], words: int, percent: int, bits: int = 64) -> DataFrame:
    """set_id, label of the sets that link with another one, as a written table."""
    compared = Compared(docs, classes, clashing, words, percent, bits)
    lists = written(index_lists(postings(docs, common, clashing, words, percent, bits)), "lists")
    firsts = written(first_tokens(lists), "firsts")
    near, rows, labels = lists, None, None
    tested: list[DataFrame] = []
    links: list[DataFrame] = []
    for k, most in enumerate(LEADERS):
        tested.append(written(likeliest(near, percent, tested, most), "pairs"))
        links.append(compared.of(alike(tested[-1], firsts, percent)))
        labels = relabelled(labels, links[-1])
        if rows is not None:
            discard(rows)
        rows = with_labels(lists, labels)
        rows = written(rows.join(shared_tokens(rows), "token"), "open-lists")
        near = led(rows, percent, (k + 1) / len(LEADERS))
    seen = written(sought(rows, percent), "sought")  # a table a step: the shuffles of each are gone before the next one's
    open_ones = written(open_pairs(rows, percent, tested, seen), "open")
    discard(seen, rows)
    pairs = written(alike(open_ones, firsts, percent), "alike")
    if not pairs.isEmpty():
        found, tables = derived(pairs, links, compared)
        labels = relabelled(labels, found)
        discard(*tables)
    discard(lists, firsts, open_ones, pairs, *tested, *links)
    return labels


def with_labels(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Lists with each set's label; a set without links is its own. Few labels are broadcast, by their number."""
    rows = lists.select("token", "set_id", "n", "position")
    return rows.join(labels if labels.count() > BROADCAST_ROWS else F.broadcast(labels), "set_id", "left").select("token", "set_id", "n", "position", F.coalesce("label", "set_id").alias("label"))


def shared_tokens(rows: DataFrame) -> DataFrame:
    """token, most: tokens of more labels than one, and the label that most of their sets have."""
    counts = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("sets"))
    return counts.groupBy("token").agg(F.max_by("label", F.struct("sets", "label")).alias("most"), F.count(F.lit(1)).alias("groups")).filter("groups > 1").select("token", "most")


#: Sets whose sizes differ by less than this factor are one block when lists are chosen. Only speed depends on it.
BLOCK = 1.02
#: With how many tokens before it a token of a list comes. Only speed depends on it.
PREVIOUS = 4


def least_need(n, m, percent: int):
    """A lower bound of how many first tokens linking sets of n and m share, before it is rounded up; over a range of m it is least at an end.

    What both sets have behind their first tokens can't make up for fewer.
    """
    return F.lit(float(percent)) * (n + m) / F.lit(100.0 + percent) - F.lit(float(percent)) * F.greatest(n, m) / F.lit(100.0)


def open_pairs(rows: DataFrame, percent: int, tested: list[DataFrame], seen: DataFrame | None = None) -> DataFrame:
    """a, b, lead (a): all pairs of sets of different labels that may link, but for those that were looked at before. seen: sought's answer, if it is there already."""
    return not_among(met_pairs(rows, percent, seen).distinct(), tested).withColumn("lead", F.col("a"))


def size_block():
    return F.floor(F.log("n") / math.log(BLOCK)).alias("block")


def seeks(whole):
    """Whether a set's label isn't the most frequent one of some list that it is in; whole: a window of its rows."""
    return F.max(F.col("label") != F.col("most")).over(whole).alias("seeks")


def before(window):
    """The tokens before this one."""
    return F.array(*(F.lag("token", k).over(window) for k in range(1, PREVIOUS + 1)))


def sought(rows: DataFrame, percent: int) -> DataFrame:
    """token, block, s, label_s, m, before_s: in which lists, and at which size blocks of them, a set s of size m looks for its partners."""
    blocks = rows.groupBy("token", size_block()).agg(F.count(F.lit(1)).alias("sets"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("label").alias("label_lo"), F.max("label").alias("label_hi"))
    seekers = rows.select("token", "set_id", "label", "n", "position", seeks(W.partitionBy("set_id"))).filter("seeks").drop("seeks")
    seen = seekers.join(blocks, "token").filter((100 * F.col("hi") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("lo")) & ((F.col("label") != F.col("label_lo")) | (F.col("label") != F.col("label_hi"))))
    own = W.partitionBy("set_id", "block")
    lo, hi = F.greatest(F.min("lo").over(own), F.col("n") * percent / 100), F.least(F.max("hi").over(own), F.col("n") * 100 / percent)
    need = F.greatest(F.lit(1), F.floor(F.least(least_need(F.col("n"), lo, percent), least_need(F.col("n"), hi, percent)) - 1e-6) + 1)
    seen = seen.select("token", "block", "set_id", "label", "n", "position", need.alias("need"), F.count(F.lit(1)).over(own).alias("lists"), F.row_number().over(own.orderBy("sets", "token")).alias("place"))
    return seen.filter("place <= lists - need + 1").select("token", "block", F.col("set_id").alias("s"), F.col("label").alias("label_s"), F.col("n").alias("m"), before(own.orderBy("position")).alias("before_s"))


def met_pairs(rows: DataFrame, percent: int, seen: DataFrame | None = None) -> DataFrame:
    """a, b: all pairs of sets of different labels that may link, some of them more than once.

    Each such pair has a set whose label isn't some list's most frequent one; it looks for its partners, or the smaller
    set does if both are such. Of its lists with sets of a size block it looks only at the shortest: a partner that is in
    none of them is in too few of the others. Pairs that have just met in an earlier one of these lists are passed by:
    with each token of a set come the tokens before it, so alike sets don't meet once for every token that they share.
    """
    whole = W.partitionBy("set_id")
    seen = sought(rows, percent) if seen is None else seen
    rows = rows.select("token", "set_id", "label", "n", size_block(), seeks(whole), before(whole.orderBy("position")).alias("before"))
    met = F.coalesce(F.arrays_overlap("before", "before_s"), F.lit(False))
    turn = ~F.col("seeks") | (F.struct(F.col("m").alias("n"), F.col("s").alias("id")) < F.struct("n", F.col("set_id").alias("id")))
    pairs = rows.join(seen, ["token", "block"]).filter((F.col("label") != F.col("label_s")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & turn & ~met)
    return pairs.select(F.least("s", "set_id").alias("a"), F.greatest("s", "set_id").alias("b"))


def components(docs: DataFrame, words: int = WORDS, percent: int = 75, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (equal in a component, with or without ids), text_key of each document. bits: of a set's id, fewer for tests."""
    rows = written(measured(docs, words, bits), "measured")
    known, classes, clashing = classes_of(rows.filter("n is not null").select("doc_id", "text_key", "set_id", "other", "n"))
    labels = linked_sets(docs, classes, clashing, often(rows.filter("token is not null")), words, percent, bits)
    groups = classes.join(labels, "set_id", "left").filter("rows > 1 or label is not null").select("set_id", "low", F.coalesce("label", "set_id").alias("class_id"))
    lows = groups.groupBy("class_id").agg(F.min("low").alias("component_id"))
    named = written(groups.join(lows, "class_id").select("set_id", "class_id", "component_id"), "named")
    discard(labels, classes)
    return known.join(named, "set_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "set_id").alias("class_id"), "text_key")


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = 75) -> DataFrame:
    """docs with one document of each component: the one with the smallest id, of rows of one id the one with the smallest text hash.

    Rows of one id and text are one document. Rows of one id and different texts are different ones, and each is
    judged by its own text. Rows without an id come last in their component. Rows without words are linked with nothing and all stay.
    """
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    row = lambda key: [F.col("doc_id").isNull().alias("_bare"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), key.alias("_key")]
    judged = components(docs, words, percent).filter("n_shingles > 0").select("class_id", F.struct(*row(F.col("text_key"))).alias("row"))
    kept = judged.groupBy("class_id").agg(F.min("row").alias("row")).select("row.*")
    placed = docs.filter(has_words).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *row(F.xxhash64("text")))
    turn = F.row_number().over(W.partitionBy("_bare", "_id", "_key").orderBy("_key"))
    once = placed.join(kept, ["_bare", "_id", "_key"]).withColumn("_turn", turn).filter("_turn = 1")
    return once.select("_row.*").unionByName(docs.filter(~has_words))
