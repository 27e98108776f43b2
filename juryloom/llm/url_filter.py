"""URL verdicts: rules on host suffixes and paths first, then trust and distrust that spread over links between hosts.

Every page that a rule allows gives its host trust, every page that a rule blocks distrust. Trust follows links as in
personalised PageRank; distrust runs against them, from a host to those that link to it. A host with more distrust
than trust is blocked for all pages that no rule settles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialize, shared_dir

#: (verdict, host and path) of the production rules.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Share, in hundredths, that goes on over links in a step, and the most steps.
DAMPING, STEPS = 85, 20
#: Mass of one page, so that whole numbers are precise enough; sums of them do not hang on any order.
MASS = 1_000_000
#: A link to another host: a scheme or two slashes, then the host.
_LINK = r"""(?i)<a\s[^>]*href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
_A_TO_Z, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A to Z lower-cased; null or without :// it is empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _A_TO_Z, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does: its host or a subdomain, and a path that
    starts with the rule's. Of rules of equal length the one given first wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        site, slash, rest = text.partition("/")
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(slash + rest)
        same = F.coalesce(F.length(rule) == len(text), F.lit(False))
        rule, verdict = F.when(fits & ~same, text).otherwise(rule), F.when(fits & ~same, says).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(source, target, n): links from pages of one host to another, counted. Null html has none."""
    found = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1)))
    links = pages.select(host_of(F.col("url")).alias("source"), found.alias("link"))
    target = F.translate("link", _A_TO_Z, _LOWER)
    return links.select("source", target.alias("target")).filter("source <> target and source <> ''").groupBy("source", "target").agg(F.count("*").alias("n"))


def _both_ways(links: DataFrame) -> DataFrame:
    """(kind, host, to, n): trust goes along links, distrust against them."""
    return links.select(F.lit("trust").alias("kind"), F.col("source").alias("host"), F.col("target").alias("to"), "n").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("target").alias("host"), F.col("source").alias("to"), "n")
    )


def propagate(seeds: DataFrame, links: DataFrame, folder: str, damping: int = DAMPING, steps: int = STEPS) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust: counts of pages) over links (source, target, n).

    mass(host) = (100 - damping) / 100 of its seed + damping / 100 of what comes over links, each host giving its mass by
    shares of its links; hosts without links give none. Masses are whole numbers, rounded down, which grow from step to
    step, so that steps end early without a change of result once nothing changes. A step's masses are a written table.
    """
    both = _both_ways(links)
    out = materialize(both.groupBy("kind", "host").agg(F.sum("n").alias("out")).withColumn("at", F.struct("kind", "host")), folder, "out")
    edges = hot_join(both.withColumn("at", F.struct("kind", "host")), out.select("at", "out"), "at", "to")
    edges = materialize(edges.select("at", F.struct("kind", F.col("to").alias("host")).alias("target"), "n", "out"), folder, "edges")
    base = F.stack(F.lit(2), F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))
    start = seeds.select("host", base.alias("kind", "pages")).filter("pages > 0")
    start = start.select(F.struct("kind", "host").alias("at"), (F.col("pages") * (MASS * (100 - damping) // 100)).cast("long").alias("mass"))
    start = materialize(start, folder, "step-0")
    mass, seen = start, None
    for step in range(1, steps + 1):
        given = hot_join(edges, mass, "at", "target")
        given = given.select(F.col("target").alias("at"), F.floor(F.col("mass").cast("double") * F.col("n") * damping / (100 * F.col("out"))).cast("long").alias("mass"))
        mass = materialize(start.unionByName(given).groupBy("at").agg(F.sum("mass").alias("mass")).filter("mass > 0"), folder, f"step-{step}")
        now = mass.agg(F.count("*"), F.sum("mass")).first()
        if now == seen:
            break
        seen = now
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("at.kind") == kind, F.col("mass"))), F.lit(0)).alias(kind)
    return mass.groupBy("at.host").agg(part("trust"), part("distrust"))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """One row for each row of pages (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust.

    The verdict is the rule's; without a rule it is block if the host's distrust is greater than its trust, else allow:
    a host that no mass reaches is allowed, and so is a url without a host (null or without ://). Repeated rows are
    pages of their own, null page_ids stay, other columns are ignored, an empty table gives no rows. A host may have
    any share of pages: only counts by host are shuffled, and pages meet a broadcast table or salted hosts.
    """
    folder = shared_dir(pages.sparkSession)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "ruled": verdict})
    count = lambda says: F.count_if(F.col("ruled") == says)
    seeds = judged.filter("host <> ''").groupBy("host").agg(count("allow").alias("trust"), count("block").alias("distrust"))
    links = materialize(host_links(pages), folder, "links")
    masses = materialize(propagate(seeds, links, folder), folder, "masses")
    found = hot_join(judged, masses, "host", "page_id", "left")
    trust, distrust = F.coalesce("trust", F.lit(0)), F.coalesce("distrust", F.lit(0))
    own = F.when(distrust > trust, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def _oracle() -> str:
    fits = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    cases, says = [], []
    for verdict, text in sorted(RULES, key=lambda r: -len(r[1])):
        h, _, p = text.partition("/")
        cases.append(f"WHEN {fits.format(h=h, p='/' + p)} THEN '{text}'")
        says.append(f"WHEN rule = '{text}' THEN '{verdict}'")
    steps = []
    for i in range(1, STEPS + 1):
        steps.append(
            f"m{i} AS (SELECT kind, host, sum(mass)::BIGINT AS mass FROM (SELECT * FROM m0 UNION ALL SELECT e.kind, e.target, "
            f"floor(m.mass::DOUBLE * e.n * {DAMPING} / (100 * e.total))::BIGINT FROM edges e JOIN m{i - 1} m USING (kind, host)) GROUP BY 1, 2)"
        )
    return rf"""
WITH parts AS (
    SELECT page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_A_TO_Z}', '{_LOWER}'), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, CASE {' '.join(cases)} END AS rule FROM parts),
said AS (SELECT *, CASE {' '.join(says)} END AS verdict FROM ruled),
links AS (
    SELECT source, target, count(*) AS n FROM (
        SELECT host AS source, translate(unnest(regexp_extract_all(coalesce(html, ''), '{_LINK.replace("'", "''")}', 1)), '{_A_TO_Z}', '{_LOWER}') AS target FROM parts)
    WHERE source <> target AND source <> '' GROUP BY ALL),
both_ways AS (SELECT 'trust' AS kind, source AS host, target, n FROM links UNION ALL SELECT 'distrust', target, source, n FROM links),
edges AS (SELECT *, sum(n) OVER (PARTITION BY kind, host)::BIGINT AS total FROM both_ways),
m0 AS (
    SELECT CASE verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) * {MASS * (100 - DAMPING) // 100} AS mass
    FROM said WHERE verdict IS NOT NULL AND host <> '' GROUP BY ALL),
{', '.join(steps)},
hosts AS (SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS distrust FROM m{STEPS} GROUP BY host)
SELECT page_id, s.host, path, rule, coalesce(verdict, CASE WHEN distrust > trust THEN 'block' ELSE 'allow' END) AS verdict,
    coalesce(trust, 0)::BIGINT AS trust, coalesce(distrust, 0)::BIGINT AS distrust
FROM said s LEFT JOIN hosts h ON h.host = s.host
"""


ORACLE = _oracle()
