"""URL filters (operator 10): rules by host and path, and for all other pages trust and distrust spread over the link graph of hosts.

Native: DataFrame and SQL functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: The rules as (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DAMPING = 0.85
ROUNDS = 12
#: Rounds between writes of the scores, so that the plan stays short.
ROUNDS_PER_WRITE = 4
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LINK = r"""(?i)\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""


def plain_lower(c: Column) -> Column:
    return F.translate(c, CAPITALS, CAPITALS.lower())


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or where there is no `://`."""
    text = F.coalesce(url, F.lit(""))
    return plain_lower(F.regexp_extract(text, r"://([^/?#]*)", 1)), F.regexp_extract(text, r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    name = F.coalesce(*(F.when(fit, F.lit(h + p)) for fit, (_, h, p) in zip(fits, ordered, strict=True)))
    verdict = F.coalesce(*(F.when(fit, F.lit(v)) for fit, (v, _, _) in zip(fits, ordered, strict=True)))
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct links between different hosts with their counts: src, dst, links. Relative links stay on their host."""
    host, _ = url_parts(F.col("url"))
    links = pages.select(host.alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("link"))
    dst = plain_lower(F.regexp_extract("link", r"//([^/?#]*)", 1))
    return links.select("src", dst.alias("dst")).where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank for several kinds at once: edges (kind, src, dst, share), seeds (kind, host, weight).

    One row per kind and host that is a seed or is reached. The scores have one row per host, the edges one per host
    pair, both far smaller than the pages; a hub's edges form a skewed join side that adaptive execution splits, and
    sums per target are combined before the shuffle.
    """
    start = seeds.select("kind", "host", ((1 - damping) * F.col("weight")).alias("score"))
    ranks = seeds.select("kind", "host", F.col("weight").alias("score"))
    for done in range(1, rounds + 1):
        moved = edges.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (damping * F.col("score") * F.col("share")).alias("score"))
        ranks = moved.unionByName(start).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if done % ROUNDS_PER_WRITE == 0:
            ranks = stored(ranks, f"ranks{done}")
    return ranks


def page_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Host, path, rule and verdict of every page.

    Seeds: each host's share of pages that an allow rule (trust) or a block rule (distrust) decides, scaled to sum 1 over
    hosts. Trust flows along links, distrust against them. A page without a rule is blocked if its host has more
    distrust than trust; hosts without evidence, the empty one among them, are allowed. Null urls or html count as empty,
    repeated rows give repeated rows, an empty table none.
    """
    host, path = url_parts(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": name, "decided": verdict})
    hosts = judged.where("host <> ''").groupBy("host").agg(*(F.avg(F.coalesce((F.col("decided") == v).cast("double"), F.lit(0.0))).alias(v) for v in ("allow", "block")))
    seeds = hosts.select(F.explode(F.array(*(F.struct(F.lit(v).alias("kind"), "host", F.col(v).alias("weight")) for v in ("allow", "block")))).alias("s")).select("s.*").where("weight > 0")
    totals = seeds.groupBy("kind").agg(F.sum("weight").alias("total"))  # two rows
    seeds = stored(seeds.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("weight") / F.col("total")).alias("weight")), "seeds")
    links = host_edges(pages)
    both = links.select(F.explode(F.array(F.struct(F.lit("allow").alias("kind"), "src", "dst", "links"), F.struct(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "links"))).alias("e")).select("e.*")
    out = both.groupBy("kind", "src").agg(F.sum("links").alias("all_links"))
    edges = stored(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("links") / F.col("all_links")).alias("share")), "edges")
    ranks = spread(edges, seeds)
    balance = ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == "allow", F.col("score")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "block", F.col("score")).otherwise(0.0)).alias("distrust"))
    by_method = F.when(F.col("distrust") > F.col("trust"), F.lit("block")).otherwise("allow")
    return judged.join(balance, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("decided", by_method).alias("verdict"))


def _sql() -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda value: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(v, h, p)}'" for v, h, p in ordered) + " END"
    link = LINK.replace("'", "''")
    lower = lambda x: f"translate({x}, '{CAPITALS}', '{CAPITALS.lower()}')"
    return f"""
WITH RECURSIVE parts AS (
  SELECT page_id, html, {lower("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
judged AS (SELECT page_id, html, host, path, {fits(lambda v, h, p: h + p)} AS rule, {fits(lambda v, h, p: v)} AS decided FROM parts),
shares AS (
  SELECT host, 'allow' AS kind, avg(CASE WHEN decided = 'allow' THEN 1.0 ELSE 0.0 END) AS weight FROM judged WHERE host <> '' GROUP BY host
  UNION ALL SELECT host, 'block', avg(CASE WHEN decided = 'block' THEN 1.0 ELSE 0.0 END) FROM judged WHERE host <> '' GROUP BY host),
seeds AS (SELECT kind, host, weight / sum(weight) OVER (PARTITION BY kind) AS weight FROM shares WHERE weight > 0),
found AS (SELECT host AS src, {lower("regexp_extract(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)), '//([^/?#]*)', 1)")} AS dst FROM judged),
links AS (SELECT src, dst, count(*) AS links FROM found WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
both_ways AS (SELECT 'allow' AS kind, src, dst, links FROM links UNION ALL SELECT 'block', dst, src, links FROM links),
edges AS (SELECT kind, src, dst, links / sum(links) OVER (PARTITION BY kind, src) AS share FROM both_ways),
ranks AS (
  SELECT kind, host, weight AS score, 0 AS step FROM seeds
  UNION ALL
  SELECT kind, host, sum(score), step + 1 FROM (
    SELECT r.kind, e.dst AS host, {DAMPING} * r.score * e.share AS score, r.step FROM ranks r JOIN edges e ON r.kind = e.kind AND r.host = e.src WHERE r.step < {ROUNDS}
    UNION ALL
    SELECT s.kind, s.host, {1 - DAMPING} * s.weight, t.step FROM seeds s, (SELECT DISTINCT step FROM ranks WHERE step < {ROUNDS}) t) GROUP BY kind, host, step),
balance AS (
  SELECT host, sum(CASE WHEN kind = 'allow' THEN score ELSE 0 END) AS trust, sum(CASE WHEN kind = 'block' THEN score ELSE 0 END) AS distrust
  FROM ranks WHERE step = {ROUNDS} GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(decided, CASE WHEN distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN balance b ON j.host = b.host"""


SQL = _sql()
