"""URL filter: rules first, then trust and distrust that flow over links between hosts."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, read_table, small, stored

#: (host and path prefix, verdict): fixed by the contract of the query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
HREF = r"""(?is)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        at, _, prefix = text.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + prefix))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def propagate(seeds: DataFrame, edges: DataFrame, damping: float, tolerance: float, rounds: int | None = None) -> DataFrame:
    """(host, rank): personalised PageRank. seeds: (host, seed); edges: (src, dst, share), shares of a src sum to 1.

    rank = (1 - damping) * seed + damping * sum of share * rank over the links in. Each round is stored; it ends when
    no host's rank moved by more than tolerance. The sum of all moves shrinks by damping each round, so that comes; a
    number of rounds ends it before."""
    start = seeds.where("seed > 0").select("host", ((1 - damping) * F.col("seed")).alias("base"))
    rank = stored(start.withColumnRenamed("base", "rank"), "rank")
    for _ in count() if rounds is None else range(rounds):
        flow = rank.join(small(edges), rank.host == edges.src).select(F.col("dst").alias("host"), (damping * F.col("rank") * F.col("share")).alias("part"))
        new = stored(start.withColumnRenamed("base", "part").unionByName(flow).groupBy("host").agg(F.sum("part").alias("rank")), "rank")
        moved = new.alias("n").join(rank.alias("o"), "host", "left").agg(F.max(F.col("n.rank") - F.coalesce(F.col("o.rank"), F.lit(0.0)))).first()[0]
        rank = new
        if (moved or 0.0) <= tolerance:
            break
    return rank


def judge_urls(pages: DataFrame, rules=RULES, damping: float = 0.85, threshold: float = 0.5, tolerance: float = 1e-6, rounds: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each row of pages (page_id, url, html).

    The longest rule that fits decides. For the other pages: a host's trust seed is the share of its pages that rules
    allow, its distrust seed the share that rules block. Trust flows along links from host to host, distrust from a
    host back to those that link to it; both ranks are divided by (1 - damping), so that an unlinked seed keeps its
    share. A host's other pages are blocked if its distrust is at least threshold and above its trust; else allowed.

    Links are the absolute or //host hrefs of a-tags; links within a host say nothing about others and are left out.
    Null urls, and those without ://, have empty host and path, take no part in the graph, and are allowed unless a
    rule says otherwise. Null or empty html has no links. Rows that repeat a page count again. Empty tables stay empty."""
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumns({"rule": rule, "by_rule": verdict})
    hosts = stored(judged.where("host != ''").groupBy("host").agg(F.avg((F.col("by_rule") == "allow").cast("double")).alias("x"), F.count("*").alias("n"), F.count_if(F.col("by_rule") == "allow").alias("good"), F.count_if(F.col("by_rule") == "block").alias("bad")), "hosts")
    links = pages.where(F.instr("html", "//") > 0).select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("link"))
    to = host_of(F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), "link")).otherwise(F.col("link")))
    links = stored(links.select("src", to.alias("dst")).where("src != '' AND dst != '' AND src != dst").groupBy("src", "dst").agg(F.count("*").alias("n")), "links")

    def shares(a: str, b: str) -> DataFrame:
        out = links.groupBy(F.col(a).alias("src")).agg(F.sum("n").alias("all"))
        return stored(links.select(F.col(a).alias("src"), F.col(b).alias("dst"), "n").join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")), "edges")

    trust = propagate(hosts.select("host", (F.col("good") / F.col("n")).alias("seed")), shares("src", "dst"), damping, tolerance, rounds)
    distrust = propagate(hosts.select("host", (F.col("bad") / F.col("n")).alias("seed")), shares("dst", "src"), damping, tolerance, rounds)
    scores = hosts.select("host").join(trust.withColumnRenamed("rank", "trust"), "host", "left").join(distrust.withColumnRenamed("rank", "distrust"), "host", "left")
    scores = stored(scores.select("host", *((F.coalesce(c, F.lit(0.0)) / (1 - damping)).alias(c) for c in ("trust", "distrust"))), "scores")

    out = judged.join(small(scores), "host", "left").fillna(0.0, ["trust", "distrust"])
    blocked = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(blocked, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
