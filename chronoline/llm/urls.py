"""URL filters: rules first, then trust and distrust spread over the host graph.

Everything is DataFrame operations.  Host edges come from the absolute links of the
pages' markup.  Trust is a personalised PageRank from hosts whose pages a rule
allows; distrust is one over reversed edges from hosts whose pages a rule blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoline.llm.common import stage_table
from chronoline.llm.graphs import dealt_join

# Fixed values: (verdict, host and path).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
DAMPING = 0.85
#: Scores are exact to this share of the threshold.
EXACT = 1e-3
#: A host is blocked by the graph if its distrust is at least this and more than its trust.
THRESHOLD = 0.02
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UP, _LOW), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null; the earlier one on ties."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


_HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
_AWAY = r"""(?i)\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
_BASE = r"""(?i)<base\b[^>]*\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, counted.  Relative links lead to the page's base, if it names one."""
    text = F.col(html)
    away = F.regexp_extract_all(text, F.lit(_AWAY), 1)
    base = F.regexp_extract(text, _BASE, 1)
    relative = F.filter(F.regexp_extract_all(text, F.lit(_HREF), 1), lambda x: ~x.rlike("(?i)^([a-z][a-z0-9+.-]*:|//|#)"))
    # Few pages have a base; only theirs are searched for relative links.
    based = F.when(F.lower(text).contains("<base"), F.when(base != "", F.transform(relative, lambda _: base)))
    links = F.explode(F.concat(away, F.coalesce(based, F.array().cast("array<string>"))))
    out = pages.select(host_of(F.col(url)).alias("src"), links.alias("link"))
    to = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))
    return out.select("src", host_of(to).alias("dst")).where("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = 1e-12) -> DataFrame:
    """(host, rank): personalised PageRank over edges (src, dst, n) from seeds (host, seed), whose seeds sum to 1.

    A host passes on its rank by its links' share; a host without links passes nothing.  Each
    round passes on what the last one brought, at most ``damping`` of it.  Ends once all that
    later rounds can bring, to any host, is under ``tolerance``; raises if ``rounds`` run out before.
    """
    if edges.isEmpty():
        return seeds.select("host", (F.col("seed") * (1 - damping)).alias("rank"))
    total = edges.groupBy("src").agg(F.sum("n").alias("total"))
    share = stage_table(edges.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")), "share")
    part = F.col("seed") * (1 - damping)
    rank = stage_table(seeds.select("host", part.alias("rank"), part.alias("fresh")), "rank")
    left = rank.agg(F.sum("fresh")).first()[0] or 0.0
    while left * damping / (1 - damping) >= tolerance and left:
        if rounds is not None and (rounds := rounds - 1) < 0:
            raise RuntimeError("ranks did not settle")
        brought = share.join(rank.where("fresh > 0"), share["src"] == rank["host"]).groupBy(F.col("dst").alias("host")).agg((F.sum(F.col("fresh") * F.col("share")) * damping).alias("rank"))
        new = rank.withColumn("fresh", F.lit(0.0)).unionByName(brought.withColumn("fresh", F.col("rank")))
        rank = stage_table(new.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("fresh").alias("fresh")), "rank")
        left = rank.agg(F.sum("fresh")).first()[0] or 0.0
    return rank.select("host", "rank")


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, host, path, rule, verdict, trust, distrust) of every page.

    A rule's verdict stands; else a host is blocked if its distrust reaches ``threshold`` and
    exceeds its trust, and allowed otherwise.  Trust and distrust of a host are its rank times the
    number of all pages over that of its own, at most 1; a host that nothing reaches has 0.
    A null url, or one without ``://``, has an empty host and path and no rule, and is allowed.
    Rows are judged one by one; repeated rows count as often as they occur in the seeds.
    """
    parts = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = parts.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    by_host = stage_table(ruled.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("r.verdict") == "allow").alias("good"), F.count_if(F.col("r.verdict") == "block").alias("bad")), "hosts")
    edges = stage_table(host_edges(pages, url, html), "edges")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")

    pages_all, least = by_host.agg(F.sum("n"), F.min("n")).first()
    pages_all, least = pages_all or 1, least or 1
    # A rank counts most for the smallest host, so the tolerance shrinks as the pages grow in number.
    tolerance = EXACT * threshold * least / pages_all

    def ranks(column: str, graph: DataFrame, name: str) -> DataFrame:
        total = by_host.agg(F.sum(column)).first()[0] or 1
        seeds = by_host.where(F.col(column) > 0).select("host", (F.col(column) / F.lit(total)).alias("seed"))
        # Seeds weigh by their pages; the score is the rank against the host's share of all pages.
        return spread(graph, seeds, tolerance=tolerance).select("host", F.col("rank").alias(name))

    score = (
        by_host.join(ranks("good", edges, "t"), "host", "left")
        .join(ranks("bad", back, "d"), "host", "left")
        .select("host", "n", *[F.round(F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0)) * pages_all / F.col("n")), 9).alias(name) for c, name in (("t", "trust"), ("d", "distrust"))])
    )
    by_graph = F.when((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return dealt_join(ruled, score, "host", "path", pages_all).select(key, "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", by_graph).alias("verdict"), "trust", "distrust")
