"""URL filters: host and path rules, and link-graph propagation of trust and distrust over hosts.

Rules judge urls by host (and its subdomains) and path; the longest that fits wins. A host is a trusted
seed by the share of its pages whose urls fit an allow rule, and a blocked seed by the share that fits a
block rule. Trust flows along edges (personalised PageRank from the trusted seeds), distrust against
them (reversed, from the blocked seeds: who links to bad hosts is bad). Edges are the pages' links to
other hosts, and those that the names of hosts show: a host and its parent domain, of two labels at
least, link with each other once. Links without a host of their own lead to the page's host and make
no edge. What flows into hosts without edges returns to the seeds. A host whose distrust is at least
`least` of a wholly blocked host's restart and more than its trust is blocked. All of it is DataFrame
expressions; each round is a join and a sum over distinct host pairs. Rounds go on until scores settle.

A null url or one without '://' has an empty host and path, no rule, and the verdict allow. Null
and empty pages have no links; pages may be of any length. Repeated rows count their links each. Other columns
of the input are not looked at, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, written

# The rules (kind, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The part of a host's score that it passes on. A domain's hosts shouldn't all be judged by one of them, so it is
#: lower than the usual 0.85 of ranks of importance; rounds are fewer by that, too.
DAMPING = 0.5
#: Scores have settled once CHECKED rounds change them by less than this in sum. What further rounds would add is
#: below 1 / (1 - DAMPING) times as much in sum, 2e-5; a host is blocked from 0.125 on.
TOLERANCE = 1e-5
CHECKED = 5
#: The share of an equal part of the blocked seeds' restart that a host's distrust must reach.
LEAST = 0.25
_LINK = r"(?i)(?:href|src)\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?(//[^\s\"'<>]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, kind); null if none does."""
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:]))
    out = F.lit(None).cast("struct<rule:string,kind:string>")
    for kind, h, p in reversed(ordered):
        out = F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(kind).alias("kind"))).otherwise(out)
    return out


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, kind of each url."""
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return parts.withColumn("best", best_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.kind").alias("kind"))


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts."""
    out = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("link"))
    out = out.select("src", host_of(F.concat(F.lit("x:"), "link")).alias("dst"))
    return out.filter("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def domain_links(hosts: DataFrame) -> DataFrame:
    """src, dst, n: one link each way between each of hosts (host) or its parent domains and the next parent domain of two labels at least."""
    labels = F.split("host", r"\.")
    name = lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    up = F.when(F.size(labels) > 2, F.transform(F.sequence(F.lit(1), F.size(labels) - 2), lambda i: F.struct(name(i).alias("src"), name(i + 1).alias("dst"))))
    pairs = hosts.select(F.explode(up).alias("pair")).select("pair.*").filter("src != '' and dst not like '.%'").distinct()
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("n", F.lit(1).cast("long"))


def propagate(seeds: DataFrame, links: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """kind, host, score, as a written table: seeds (kind, host, weight) restart with their weight; allow flows along links (src, dst, n), block against them.

    Scores start as the restarts and only rise, so the sum of changes is the change of the sum. Every few rounds'
    table is cut off from the ones before. Giving what hosts without edges take in back to the seeds, in proportion to their weights, is the same as scaling
    all scores of a kind until their sum is that of the weights; so that is done once, at the end.
    """
    both = links.select(F.lit("allow").alias("kind"), "src", "dst", "n").unionByName(links.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    both = both.groupBy("kind", "src", "dst").agg(F.sum("n").alias("n"))
    totals = both.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    edges = written(both.join(totals, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share")), "host-links")
    start = written(seeds.select("kind", "host", ((1 - damping) * F.col("weight")).alias("score")), "host-seeds")
    total = F.coalesce(F.sum("score"), F.lit(0.0))
    scores, before = start, start.agg(total).first()[0]
    while True:
        last = scores
        for _ in range(CHECKED):
            moved = scores.withColumnRenamed("host", "src").join(edges, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
            scores = start.unionByName(moved).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        scores = written(scores, "host-scores")
        if last is not start:
            discard(last)
        after = scores.agg(total).first()[0]
        if after - before < tolerance:
            break
        before = after
    whole = start.groupBy("kind").agg((F.sum("score") / (1 - damping)).alias("whole")).join(scores.groupBy("kind").agg(F.sum("score").alias("found")), "kind")
    scaled = written(scores.join(F.broadcast(whole), "kind").select("kind", "host", (F.col("score") * F.col("whole") / F.col("found")).alias("score")), "host-ranks")  # a row for either kind
    discard(edges, start, scores)
    return scaled


def filter_urls(pages: DataFrame, rules=RULES, least: float = LEAST) -> DataFrame:
    """page_id, host, path, rule, verdict of each page, with its host's trust and distrust."""
    rows = judged(pages, rules)
    own = written(rows.filter("host != ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), *(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("allow", "block"))), "hosts")
    seeds = own.select("host", "pages", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("fit")) for k in ("allow", "block")))).alias("seed")).select("seed.kind", "host", (F.col("seed.fit") / F.col("pages")).alias("weight")).filter("weight > 0")
    links = written(host_links(pages), "page-links")
    hosts = own.select("host").unionByName(links.select(F.explode(F.array("src", "dst")).alias("host"))).distinct()
    scores = propagate(seeds, links.unionByName(domain_links(hosts)))
    by_host = written(scores.groupBy("host").agg(*(F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(name) for k, name in (("allow", "trust"), ("block", "distrust")))), "host-trust")
    discard(own, links, scores)
    bad = (F.coalesce("distrust", F.lit(0.0)) >= least * (1 - DAMPING)) & (F.coalesce("distrust", F.lit(0.0)) > F.coalesce("trust", F.lit(0.0)))
    verdict = F.coalesce("kind", F.when(bad, "block").otherwise("allow"))
    return rows.join(by_host, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
