"""URL filters: rules, and trust and distrust propagated over host edges for what no rule decides."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Scratch
from lectern.llm.licenses import LOWER, UPPER


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"),
         Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"))
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits: (rule, verdict), or null."""
    out = F.lit(None)
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def judge_urls(df: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", rules: tuple[Rule, ...] = RULES,
               tolerance: float = 1e-4, damping: float = 0.85, scratch: Scratch | None = None) -> DataFrame:
    """Per row: host, path, the rule that fits, and a verdict: the rule's, else the host's by propagation.

    Host edges are links of pages to hosts (a link without a host points to the page's own), and a host's ties with its
    parent domain, that one's with its own, and so on, each once.  Hosts with allowed pages seed trust, which follows the edges by personalised PageRank;
    hosts with blocked pages seed distrust, which follows them reversed.  Seeds weigh as their pages, either kind adds up
    to 1; rounds go on until both together change by less than `tolerance`.  A host is blocked if its distrust exceeds its trust.  Hosts that neither reaches are allowed, as is an empty
    host, which is no node.  Link counts are aggregated before they are shuffled, so one host may hold any share of
    the pages.  A null url has an empty host and path; a null page has no links; each row gives one row, repeated and null
    ids included; an empty table gives none; other columns are not read.
    """
    scratch = scratch or Scratch(df.sparkSession)
    pages = df.select(df[id].alias("page_id"), host_of(df[url]).alias("host"), path_of(df[url]).alias("path"),
                      df[html].alias("html")).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    target = F.translate(F.regexp_extract("link", "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), UPPER, LOWER)
    links = pages.filter("host <> ''").select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias(
        "link")).select(F.col("host").alias("a"), F.when(target == "", F.col("host")).otherwise(target).alias("b"))
    direct = links.groupBy("a", "b").agg(F.count("*").alias("w"))
    seeds = pages.filter("host <> ''").groupBy("host").agg(
        F.count(F.when(F.col("r.verdict") == "allow", 1)).alias("good"),
        F.count(F.when(F.col("r.verdict") == "block", 1)).alias("bad"))
    counted = scratch.store(direct)
    seeds = scratch.store(seeds)
    hosts = counted.select(F.col("a").alias("host")).union(counted.select("b")).union(seeds.select("host")).distinct()
    parts = hosts.select(F.split("host", "[.]").alias("p")).filter(F.size("p") > 1)
    rest = lambda i: F.array_join(F.slice("p", i, F.size("p")), ".")
    ties = scratch.store(parts.select("p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("i")).select(
        rest(F.col("i")).alias("host"), rest(F.col("i") + 1).alias("up")).filter("host <> '' and up <> ''").distinct())
    edges = counted.union(ties.select("host", "up", F.lit(1).cast("long"))).union(
        ties.select("up", "host", F.lit(1).cast("long"))).groupBy("a", "b").agg(F.sum("w").cast("double").alias("w"))
    edges = scratch.store(edges)
    out_of = edges.groupBy("a").agg(F.sum("w").alias("out"))
    into = edges.groupBy("b").agg(F.sum("w").alias("in"))
    flow = scratch.store(edges.join(out_of, "a").join(into, "b").select(
        "a", "b", (F.col("w") / F.col("out")).alias("ahead"), (F.col("w") / F.col("in")).alias("back")))
    total = seeds.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    seed = seeds.select("host", (F.col("good") / (total["good"] or 1)).alias("good"),
                        (F.col("bad") / (total["bad"] or 1)).alias("bad")).filter("good > 0 or bad > 0")
    rank, change = scratch.store(seed), 2.0
    zero = F.lit(0.0)
    while change >= tolerance:
        moved = flow.join(rank.select(F.col("host").alias("a"), "good"), "a").select(
            F.col("b").alias("host"), (damping * F.col("ahead") * F.col("good")).alias("good"), zero.alias("bad"),
            zero.alias("was_good"), zero.alias("was_bad"))
        back = flow.join(rank.select(F.col("host").alias("b"), "bad"), "b").select(
            F.col("a"), zero, (damping * F.col("back") * F.col("bad")), zero, zero)
        start = seed.select("host", (1 - damping) * F.col("good"), (1 - damping) * F.col("bad"), zero, zero)
        before = rank.select("host", zero, zero, "good", "bad")
        new = scratch.store(moved.union(back).union(start).union(before).groupBy("host").agg(
            *(F.sum(c).alias(c) for c in ("good", "bad", "was_good", "was_bad"))))
        change = new.agg(F.sum(F.abs(F.col("good") - F.col("was_good")) + F.abs(F.col("bad") - F.col("was_bad")))).first()[0] or 0.0
        scratch.drop(rank)
        rank = new
    by_host = rank.select(F.col("host").alias("_host"), F.when(F.col("bad") > F.col("good") + 1e-12, "block").otherwise(
        "allow").alias("by_host"))
    return pages.drop("html").join(by_host, F.col("host") == F.col("_host"), "left").select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", "by_host", F.lit("allow")).alias("verdict"))
