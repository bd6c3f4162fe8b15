"""URL filters: rules first, then trust and distrust carried over the host link graph.

Trust is a personalised PageRank that starts at hosts with allowed pages and follows
links; distrust starts at hosts with blocked pages and follows links backwards, to
those who link there. A host whose distrust outweighs its trust is blocked.

Edges are counted per host pair before anything is joined, so a hub's links meet as
one row per partner. Ranks are whole numbers (parts of `WHOLE`), so that results do
not depend on the order of additions. They only grow from round to round, so when their
total stays within the tolerance, so does each of them. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplake.llm.shared import stored

WHOLE = 10 ** 30                # 10^20 for a page among 10^10
DAMPING = 85                    # per cent that follows links
ROUNDS = 10                     # if their number is fixed
TOLERANCE = 10 ** 6             # ranks have settled within this part of the smallest seed
MOST_ROUNDS = 1000              # more of them are an error
SAVE_EVERY = 5                  # rounds between stored tables
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]     # verdict, host, path


def url_host(url: Column) -> Column:
    """Host after the first `://`, up to `/`, `?`, `#` or the end; A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty if there is no host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. A rule fits its host and subdomains."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, host: str, html: str = "html") -> DataFrame:
    """(src, dst, links): links between different hosts. Absolute `href`s, quoted or not, count."""
    href = F.regexp_extract_all(F.col(html), F.lit(
        r"""(?i)href\s*=\s*["']?\s*((?:https?:)?//[^\s"'<>]+)"""), F.lit(1))
    target = F.col("_link")
    return (pages.select(F.col(host).alias("src"), F.explode(href).alias("_link"))
            .select("src", url_host(F.when(target.startswith("//"), F.concat(F.lit("x:"), target))
                                    .otherwise(target)).alias("dst"))
            .where((F.col("dst") != "") & (F.col("src") != "") & (F.col("dst") != F.col("src")))
            .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links")))


def _share(whole: str, part: str | int, of: str | int) -> Column:
    """whole * part / of, rounded down, as decimal(38,0); `part` and `of` are longs, so nothing overflows."""
    w, p, d = f"cast({whole} as decimal(38,0))", f"cast({part} as decimal(19,0))", f"cast({of} as decimal(19,0))"
    rest = f"cast({w} % {d} as decimal(19,0)) * {p}"
    return F.expr(f"cast(cast(({w} - {w} % {d}) / {d} as decimal(38,0)) * {p}"
                  f" + ({rest} - ({rest}) % {d}) / {d} as decimal(38,0))")


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, settle: bool = False) -> DataFrame:
    """Personalised PageRank (host, rank) of `seeds` (host, weight) along `edges` (src, dst, links).

    Seeds' weights are scaled to sum to WHOLE. Rank that leaves by no link is dropped. It
    takes `rounds` rounds or, with `settle`, as many as it needs: until no host is newly
    reached and no rank grows by a part of TOLERANCE of the smallest seed. More than
    `rounds` are an error then.
    """
    total = seeds.agg(F.sum("weight").alias("_total"))
    base = seeds.withColumn("_total", total.scalar())
    base = base.where(F.col("_total") > 0).select("host", _share(f"{WHOLE}BD", "weight", "_total").alias("seed"))
    base = stored(base, "rank-seeds")
    out = edges.groupBy("src").agg(F.sum("links").alias("_out"))
    flows = stored(edges.join(out, "src").select(F.col("src").alias("host"), "dst", "links", "_out"), "rank-flows")
    start = base.select("host", _share("seed", 100 - DAMPING, 100).alias("rank"))
    rank, before = start, _extent(start) if settle else None
    least = (base.agg(F.min("seed")).first()[0] or 0) if settle else 0
    for k in range(rounds):
        carried = (rank.join(flows, "host").select("dst", "links", "_out", _share("rank", DAMPING, 100).alias("rank"))
                   .select(F.col("dst").alias("host"), _share("rank", "links", "_out").alias("rank")))
        rank = carried.unionByName(start).groupBy("host").agg(F.sum("rank").alias("rank")) \
            .where(F.col("rank") > 0)
        if k % SAVE_EVERY == SAVE_EVERY - 1:
            rank = stored(rank, "ranks")
            if settle:
                now = _extent(rank)
                if now[0] == before[0] and (now[1] - before[1]) * TOLERANCE <= least:
                    return rank
                before = now
    if settle:
        raise RuntimeError(f"ranks have not settled in {rounds} rounds")
    return rank


def _extent(rank: DataFrame) -> tuple[int, int]:
    """Hosts and their total rank."""
    hosts, total = rank.agg(F.count(F.lit(1)), F.sum("rank")).first()
    return hosts, int(total or 0)


def host_scores(judged: DataFrame, edges: DataFrame, rounds: int = MOST_ROUNDS) -> DataFrame:
    """(host, trust, distrust) of hosts with any; `judged` has host and the rules' verdict, null without one.

    A host's seed weight is its number of allowed (blocked) pages.
    """
    seeds = stored(judged.where(F.col("host") != "").groupBy("host").agg(
        F.count_if(F.col("verdict") == "allow").alias("allow"),
        F.count_if(F.col("verdict") == "block").alias("block")), "seeds")
    trust = propagate(edges, seeds.where("allow > 0").select("host", F.col("allow").alias("weight")), rounds, settle=True)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    distrust = propagate(back, seeds.where("block > 0").select("host", F.col("block").alias("weight")), rounds, settle=True)
    return (trust.select("host", F.col("rank").alias("trust"), F.lit(0).cast("decimal(38,0)").alias("distrust"))
            .unionByName(distrust.select("host", F.lit(0).cast("decimal(38,0)").alias("trust"),
                                         F.col("rank").alias("distrust")))
            .groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))


def judge_pages(pages: DataFrame, rules: Sequence[Rule], rounds: int = MOST_ROUNDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each row of pages (page_id, url, html).

    A url that is null or has no `://` has an empty host and path. Verdict: the rule's;
    else block if the host's distrust exceeds its trust, else allow. So a host that no
    seed reaches, an empty host and a tie are allowed. Equal rows stay; a null html has no
    links; other columns are ignored. More than `rounds` rounds of propagation are an error.
    """
    url = F.col("url")
    ruled = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path")) \
        .withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules)) \
        .select("page_id", "host", "path", "_rule.rule", "_rule.verdict")
    judged = stored(ruled, "ruled-pages")
    edges = stored(host_edges(pages.select(url_host(url).alias("_host"), "html"), "_host"), "host-edges")
    scores = host_scores(judged, edges, rounds)
    zero = F.lit(0).cast("decimal(38,0)")
    return (judged.join(scores, "host", "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("verdict", F.when(F.col("distrust") > F.col("trust"), "block").otherwise("allow"))
                    .alias("verdict"),
                    F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust")))
