"""URL filters by rules and, where no rule fits, by trust that spreads over the host graph.

Hosts with pages that a rule allows are trusted seeds, hosts with pages that a rule blocks are
blocked seeds. Trust is a personalised PageRank along the links, from the trusted seeds; distrust one
against the links, from the blocked seeds. A host is blocked if its distrust exceeds its trust.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import LOWER, UPPER, join_hot
from corpuslab.session import stage

# Verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING, ERROR = 0.6, 1e-6  # each host's rank differs from its limit by less than ERROR of itself
RATIO = 1.0  # a host is blocked if its distrust exceeds RATIO times its trust, by more than twice ERROR of it
STEPS = 4  # between two staged ranks
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (text, verdict), or null. Of equally long ones the first."""
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("text"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts in the pages' html, and the ties between a host and the
    hosts it is part of (``blog.site.example`` and ``site.example``), in both directions."""
    hosts = pages.select(host_of(F.col("url")).alias("src"), F.col("html").cast("string").alias("html")).where("src <> ''")
    linked = hosts.select("src", F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("to"))
    linked = linked.select("src", host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))).alias("dst"))
    names = hosts.select("src").distinct().withColumn("labels", F.split("src", r"\."))
    parts = names.select("src", F.explode(F.when(F.size("labels") > 2, F.sequence(F.lit(2), F.size("labels") - 1)).otherwise(F.array().cast("array<int>"))).alias("k"), "labels")
    up = parts.select("src", F.array_join(F.slice("labels", -F.col("k"), F.col("k")), ".").alias("dst"))
    ties = up.union(up.select("dst", "src")).distinct()
    both = linked.where("dst <> '' and dst <> src").union(ties)
    return both.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def personalised_pagerank(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, error: float = ERROR) -> DataFrame:
    """(host, rank) of hosts reached from ``seeds`` (host, mass; masses add up to 1). Each step passes
    ``damping`` of a host's rank along its links by their number; what does not pass returns to the seeds.

    The ranks x(t) of walks of up to t links only grow, and x(2t) - x(t) is what t more links make of
    x(t). So if no host's rank grows by more than ``grown`` of itself from t to 2t, the rest of each is
    at most ``grown``² / (1 - ``grown``) of it, however small the rank and however far the seed: the walk
    stops there, with that share below ``error``. It also stops where ``damping`` ** t leaves the range of
    a double. Messages are added up per host before the shuffle, and the ranks are written to the shared
    folder every ``STEPS`` steps.
    """
    out = links.groupBy("src").agg(F.sum("n").alias("all"))
    share = stage(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")), "links")
    kept = seeds.select("host", (F.col("mass") * (1 - damping)).alias("rank"))
    grown = math.sqrt(error) * (1 - math.sqrt(error))
    last = math.ceil(math.log(5e-324) / math.log(damping))
    rank, step, staged = kept, 0, {}
    while True:
        for _ in range(STEPS):
            sent = share.join(rank, F.col("src") == F.col("host")).select(F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
            rank = sent.union(kept).groupBy("host").agg(F.sum("rank").alias("rank"))
        step += STEPS
        staged[step] = rank = stage(rank, "rank")
        half = staged.pop(step // 2, None)
        if step > last or half is not None and _settled(half, rank, grown):
            return rank


def _settled(half: DataFrame, rank: DataFrame, grown: float) -> bool:
    before = half.select("host", F.col("rank").alias("before"))
    moved = rank.join(before, "host", "left").where(F.col("before").isNull() | (F.col("rank") > F.col("before") * (1 + grown)))
    return moved.isEmpty()


def significant(c: Column) -> Column:
    """To nine significant digits, so that the order of additions does not show."""
    return F.format_string("%.8e", c).cast("double")


def host_verdicts(links: DataFrame, seeds: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(host, trust, distrust, verdict) from ``seeds`` (host, trusted, blocked: numbers of pages)."""
    def spread(column: str, along: DataFrame, name: str) -> DataFrame:
        own = seeds.where(F.col(column) > 0).select("host", F.col(column).alias("n"))
        total = own.agg(F.sum("n")).first()[0] or 1
        mass = own.select("host", (F.col("n") / F.lit(total)).alias("mass"))
        return personalised_pagerank(along, stage(mass, "seeds")).withColumnRenamed("rank", name)

    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    both = spread("trusted", links, "trust").join(spread("blocked", back, "distrust"), "host", "full")
    both = both.select("host", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")))
    verdict = F.when(F.col("distrust") > ratio * (1 + 2 * ERROR) * F.col("trust"), "block").otherwise("allow")
    return both.select("host", significant(F.col("trust")).alias("trust"), significant(F.col("distrust")).alias("distrust"), verdict.alias("verdict"))


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust.

    A null url and one without ``://`` have an empty host and path; no rule fits an empty host. The
    longest fitting rule gives the verdict, else the host's: block if its distrust exceeds its trust,
    allow if not, which holds for hosts that neither reaches and for the empty host. Null html has no
    links. Repeated rows are judged alike, and count as often as they stand. An empty table gives an
    empty result; other columns are ignored, whatever they are called.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    seeds = rows.where("rule is not null").groupBy("host").agg(
        F.count(F.when(F.col("rule.verdict") == "allow", 1)).alias("trusted"), F.count(F.when(F.col("rule.verdict") == "block", 1)).alias("blocked"))
    hosts = host_verdicts(stage(host_links(pages), "host-links"), stage(seeds, "host-seeds"))
    sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    known = stage(sizes.join(hosts, "host", "left").select("host", "n", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
                                                           F.coalesce("verdict", F.lit("allow")).alias("spread")), "hosts")
    out = join_hot(rows, known, "host", "n", "page_id")
    return out.select("page_id", "host", "path", F.col("rule.text").alias("rule"), F.coalesce("rule.verdict", "spread").alias("verdict"), "trust", "distrust")
