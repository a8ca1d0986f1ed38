"""URL filtering by rules and, where no rule fits, by link-graph propagation.

Hosts that rules allow or block are seeds. Trust flows from allowed seeds along host
links; distrust flows from blocked seeds along reversed links. What reaches a host is
the mean over its own links, those to it for trust and those from it for distrust,
so it doesn't thin out with the number of other hosts that link to a seed or that a
seed links to. A host is blocked if its distrust exceeds its trust by a threshold.
DataFrame functions only.

Scale: pages are scanned for links, which become counted host edges by partial
aggregation. Each step of propagation is a join and a grouped sum on hosts, and is
written to the shared folder. Verdicts of hosts reach the pages by broadcast only
while at most ``BROADCAST_ROWS`` hosts differ from the default; beyond that
by a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""
DAMPING, STEPS = 0.85, 8
THRESHOLD = 0.5
BROADCAST_ROWS = 200_000

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(rules: tuple[tuple[str, str, str], ...], host: Column, path: Column) -> Column:
    """The longest fitting rule as a struct (rule, verdict), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): how many links lead from one host to another; links within a host don't count."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("url"))
    target = host_of(F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), F.col("url"))).otherwise(F.col("url")))
    return links.select("src", target.alias("dst")).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """(host, score): scores that flow from the seeds (host, seed) along the edges, by a fixed number of steps.

    Each step a host gets its seed value and the damped mean of the scores at the
    other ends of its incoming edges, weighed by their links. A host without
    incoming edges keeps its seed value.
    """
    weights = durable(edges.join(edges.groupBy("dst").agg(F.sum("n").alias("total")), "dst").select("src", "dst", (F.col("n") / F.col("total")).alias("w")))
    start = durable(seeds.select("host", F.col("seed").alias("score")))
    rank = start
    for _ in range(steps):
        moved = rank.join(weights, rank["host"] == weights["src"]).select(F.col("dst").alias("host"), (F.col("score") * F.col("w") * damping).alias("score"))
        rank = durable(moved.unionByName(start).groupBy("host").agg(F.sum("score").alias("score")))
    return rank


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", damping: float = DAMPING, steps: int = STEPS, threshold: float = THRESHOLD) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) per row of ``pages``.

    The verdict is the longest fitting rule's; without one it is block where the
    host's distrust exceeds its trust by more than ``threshold``, else allow.
    A host's seed is the share of its pages that rules allow, or block. A null url, or one without ``://``, has empty host and path.
    Null html has no links; repeated rows count each. Other columns aren't
    read. An empty table gives an empty result.
    """
    read = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    named = read.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = named.select("id", "host", "path", rule_of(rules, F.col("host"), F.col("path")).alias("r"), "html")
    edges = durable(host_links(ruled.select("host", "html")))
    none = F.lit(0.0)
    judged = ruled.select("id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("given"))
    seen = durable(judged.groupBy("host").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("given") == v, 1)).alias(v) for v in ("allow", "block")]))
    linked = not edges.isEmpty()
    flows = {}
    for verdict in ("allow", "block"):
        seeds = seen.where(F.col(verdict) > 0).select("host", (F.col(verdict) / F.col("n")).alias("seed"))
        ways = edges if verdict == "allow" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
        flows[verdict] = propagate(ways, seeds, damping, steps if linked else 0)
    hosts = flows["allow"].withColumnRenamed("score", "trust").join(flows["block"].withColumnRenamed("score", "distrust"), "host", "full")
    hosts = durable(hosts.select("host", F.coalesce("trust", none).alias("trust"), F.coalesce("distrust", none).alias("distrust")))
    if hosts.count() <= BROADCAST_ROWS:
        hosts = F.broadcast(hosts)
    out = judged.join(hosts, "host", "left").withColumns({"trust": F.coalesce("trust", none), "distrust": F.coalesce("distrust", none)})
    blocked = F.round(F.col("distrust") - F.col("trust"), 9) > threshold
    return out.select("id", "host", "path", "rule", F.coalesce("given", F.when(blocked, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")


def oracle_sql(rules: tuple[tuple[str, str, str], ...] = RULES, damping: float = DAMPING, steps: int = STEPS) -> str:
    """The same for DuckDB, with the steps of propagation written out."""
    match = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}={v}'" for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))) + " END"
    url = URL.replace("'", "''")
    link = LINK.replace("'", "''")
    flows = ""
    for name, verdict, src, dst in (("t", "allow", "src", "dst"), ("d", "block", "dst", "src")):
        flows += f""", {name}w AS (SELECT {src} AS src, {dst} AS dst, n / sum(n) OVER (PARTITION BY {src}) AS w FROM e)
, {name}0 AS (SELECT host, count(*) FILTER (given = '{verdict}') / count(*) AS score FROM r GROUP BY host HAVING count(*) FILTER (given = '{verdict}') > 0)"""
        for i in range(steps):
            flows += f"""
, {name}{i + 1} AS (SELECT host, sum(score) AS score FROM (SELECT dst AS host, score * w * {damping} AS score FROM {name}{i} JOIN {name}w ON host = src UNION ALL SELECT host, score FROM {name}0) GROUP BY host)"""
    return f"""
WITH p AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(url, '{url}', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '{url}', 2), '') AS path FROM pages
), m AS (SELECT *, {match} AS hit FROM p)
, r AS (SELECT page_id, html, host, path, split_part(hit, '=', 1) AS rule, split_part(hit, '=', 2) AS given FROM m)
, l AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS url FROM r)
, e AS (
  SELECT src, dst, count(*) AS n
  FROM (SELECT src, translate(regexp_extract(CASE WHEN starts_with(url, '//') THEN 'http:' || url ELSE url END, '{url}', 1), '{UPPER}', '{LOWER}') AS dst FROM l)
  WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL
){flows}
SELECT page_id, r.host AS host, path, rule,
       coalesce(given, CASE WHEN round(coalesce(d{steps}.score, 0) - coalesce(t{steps}.score, 0), 9) > {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN t{steps} ON r.host = t{steps}.host LEFT JOIN d{steps} ON r.host = d{steps}.host
"""


ORACLE_SQL = oracle_sql()
