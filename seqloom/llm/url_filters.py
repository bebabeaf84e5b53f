"""Operator 9, URL filters by link-graph propagation, by DataFrame operations only.

A page's host and path are looked up in a short table of rules; the longest rule that
fits decides. All other pages are judged by their host: personalised PageRank spreads
trust from the hosts of allowed pages along links, and distrust from the hosts of
blocked pages against them (a host that links to blocked hosts is distrusted). Host
edges are absolute links of the html, and every host is joined with the domains above
it, so that a subdomain shares its domain's standing. A host whose distrust outweighs
its trust is blocked.

Ranks are summed by host with map-side partial sums; edges are counted by pair of
hosts before they are shuffled, so that one very common host costs no more than its
distinct neighbours. What reaches a host without edges returns to the seeds, so that the
ranks of each kind sum to 1. Steps are taken until the ranks change by less than
`TOLERANCE` in sum, which they do, as each step shrinks the change by the damping. Trust
and distrust take their steps together; each is written to the shared folder.

Defined cases: null url, or one without `://`: host and path are empty; such pages
match no rule and are judged by the empty host, which has no edges: allowed. Null html
has no links; repeated rows are judged each and count once a row in the edges; null
page_ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, removed, saved

# The rules of the contract, (host, start of the path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING = 0.85
#: Summed change of the ranks below which the walk has settled.
TOLERANCE = 1e-3
#: Rows of a step that one task writes.
ROWS_A_TASK = 1_000_000
#: Distrust over trust above which a host is blocked.
THRESHOLD = 1.0
#: Weight of an edge between a host and the domain above it, in links.
DOMAIN_WEIGHT = 0.5

_AFTER = r"^.*?://"
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), *_LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path together), and its verdict; nulls if none does."""
    name = verdict = F.lit(None).cast("string")
    for of_host, of_path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == of_host) | F.endswith(host, F.lit("." + of_host))) & F.startswith(path, F.lit(of_path))
        name, verdict = F.when(fits, F.lit(of_host + of_path)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts, and hosts with the domain above."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?\s*([a-z][a-z0-9+.-]*://[^"'\s>]+)"""), F.lit(1))
    linked = pages.select(host_of(F.col("url")).alias("src"), F.explode(links).alias("link")).select("src", host_of(F.col("link")).alias("dst"))
    counted = linked.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).union(linked.select("dst")).where("host <> ''").distinct()
    # Each domain above a host, short of the last label alone.
    labels = F.split("host", r"\.")
    above = hosts.where(F.size(labels) > 2).select("host", F.explode(F.sequence(F.lit(1), F.size(labels) - 2)).alias("k"))
    chain = above.select(
        F.when(F.col("k") == 1, F.col("host")).otherwise(F.array_join(F.slice(labels, F.col("k"), F.size(labels)), ".")).alias("low"),
        F.array_join(F.slice(labels, F.col("k") + 1, F.size(labels)), ".").alias("high"),
    ).distinct()
    both = chain.select(F.col("low").alias("src"), F.col("high").alias("dst")).union(chain.select("high", "low"))
    return counted.union(both.withColumn("weight", F.lit(DOMAIN_WEIGHT))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(kind, host, rank) of random walks that return to the seeds (kind, host, share), one
    walk for each kind, along edges (kind, src, dst, weight). Shares of a kind sum to 1, and
    so do its ranks. A kind without seeds has no ranks."""
    # A step's tables are small next to the pages; more tasks than rows call for write empty files.
    tasks = 1 + edges.count() // ROWS_A_TASK
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    parts = edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("total")).alias("part"))
    steps = saved(parts.coalesce(tasks), "op9-steps")
    spark = steps.sparkSession
    path = new_path(spark, "op9-rank")
    state = saved(seeds.select("kind", "host", "share", F.lit(0.0).alias("moved"), F.lit(0.0).alias("before")).coalesce(tasks), "op9-rank", path)
    kinds = [r.kind for r in state.select("kind").distinct().collect()]
    nothing = F.lit(0.0)

    def ranked(state: DataFrame, totals: dict) -> DataFrame:
        """What came along edges, and the rest of 1 at the seeds."""
        left = F.lit(1.0)
        for kind, total in totals.items():
            left = F.when(F.col("kind") == kind, 1 - damping * total).otherwise(left)
        return state.withColumn("rank", damping * F.col("moved") + left * F.col("share"))

    totals = dict.fromkeys(kinds, 0.0)
    while True:
        ranks = ranked(state, totals)
        came = ranks.join(steps, ["kind", "host"]).select("kind", F.col("dst").alias("host"), nothing.alias("share"), (F.col("rank") * F.col("part")).alias("moved"), nothing.alias("before"))
        both = came.union(ranks.select("kind", "host", "share", nothing, "moved")).groupBy("kind", "host")
        old, path = path, new_path(spark, "op9-rank")
        state = saved(both.agg(*(F.sum(c).alias(c) for c in ("share", "moved", "before"))).coalesce(tasks), "op9-rank", path)
        removed(spark, old)
        sums = [F.sum(F.when(F.col("kind") == k, v)) for v in (F.col("moved"), F.abs(F.col("moved") - F.col("before"))) for k in kinds]
        found = [x or 0.0 for x in state.agg(F.count("*"), *sums).first()[1:]]
        totals = dict(zip(kinds, found, strict=False))
        # The seeds' part changes by no more than what moved does.
        if all(2 * damping * change < tolerance for change in found[len(kinds) :]):
            return ranked(state, totals).select("kind", "host", "rank")


def judge(pages: DataFrame, rules=RULES, tolerance: float = TOLERANCE, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust."""
    url = F.col("url")
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    page = page.select("*", rule.alias("rule"), verdict.alias("ruled"))
    edges = saved(host_edges(pages.select("url", "html")), "op9-edges")

    marks = saved(page.where("ruled is not null and host <> ''").groupBy(F.col("ruled").alias("kind"), "host").agg(F.count("*").cast("double").alias("n")), "op9-marks")
    seeds = marks.join(marks.groupBy("kind").agg(F.sum("n").alias("total")), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("share"))
    # Trust follows links, distrust goes against them.
    walks = edges.select(F.lit("allow").alias("kind"), "src", "dst", "weight").union(edges.select(F.lit("block"), "dst", "src", "weight"))
    rank = personalised_rank(walks, seeds, tolerance)
    of = lambda kind, name: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(name)
    standing = rank.groupBy("host").agg(of("allow", "trust"), of("block", "distrust"))
    standing = standing.withColumn("standing", F.when(F.col("distrust") > threshold * F.col("trust"), "block").otherwise("allow"))
    found = page.join(standing, "host", "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", "standing", F.lit("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
