"""URL filter: rules first, then trust and distrust over the link graph.

Hosts that link to each other are edges, weighted by links. Trust is a
personalised PageRank from the hosts whose pages rules mostly allow, along the
links; distrust one from the hosts whose pages rules mostly block, against the
links: who links to a blocked host is suspect. A page without a rule takes its
host's verdict: block if distrust exceeds trust by more than rounding can.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import join_group_facts, materialise
from framelake.llm.urls import url_host, url_path


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)
#: Share that a link hands on, and rounds of the SQL; what is left after them is under 0.85^16 = 7 % of the seeds' mass.
DAMPING, ROUNDS = 0.85, 16
#: Mass that is left when even equal trust and distrust are taken as they are.
TOLERANCE = 1e-12
#: Distrust blocks where it exceeds trust by more than this share of it; sums in another order differ by far less, and equal ones allow.
MARGIN = 1e-10
_EVERY = 4
#: Host of an absolute link, for Java's and RE2's regular expressions alike.
LINK_PATTERN = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def judged_by_rules(host, path, rules: tuple[Rule, ...] = RULES):
    """(rule, verdict) columns of the longest rule that fits, null where none does; of equally long ones a block, then the first by name."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # Built from the weakest to the strongest, so that the strongest stands first.
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.verdict == "block", [-ord(c) for c in r.host + r.path])):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        rule = F.when(fits, r.host + r.path).otherwise(rule)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """kind, host, mass: PageRank of each kind from its seeds (kind, host, seed) along edges (kind, src, dst, share).

    The mass of hosts without links is not handed on. Every few rounds the
    masses are written to the checkpoint folder. Rounds end when no further host
    is reached and none that has both kinds can still change which is greater:
    a host's mass is at most damping^rounds from its limit, so the difference of
    two at most twice that. Where they are nearer than that, rounds go on until
    damping^rounds is under ``tolerance``.
    """
    ranks = seeds.select("kind", "host", F.col("seed").alias("mass"))
    reached, rounds = -1, 0
    while True:
        for _ in range(_EVERY):
            handed = ranks.withColumnRenamed("host", "src").join(edges, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.lit(damping) * F.col("mass") * F.col("share")).alias("mass"))
            ranks = handed.unionByName(seeds.select("kind", "host", (F.lit(1 - damping) * F.col("seed")).alias("mass"))).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        ranks = materialise(ranks)
        rounds += _EVERY
        before, reached = reached, ranks.count()
        left = damping**rounds
        if reached == before:
            gap = F.abs(F.sum(F.when(F.col("kind") == "trust", F.col("mass")).otherwise(-F.col("mass"))))
            both = ranks.groupBy("host").agg(gap.alias("gap"), F.count("*").alias("kinds")).filter("kinds = 2")
            if left < tolerance or both.filter(F.col("gap") <= 2 * left).limit(1).count() == 0:
                return ranks


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, trust, distrust.

    rule is like ``net/``, null where none fits. A null url, or one without ://,
    has empty host and path. Links within a host don't count; a null html has
    none. An empty table gives no rows. Further columns of ``pages`` are not read.
    """
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    parts = read.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "html")
    rule, verdict = judged_by_rules(F.col("host"), F.col("path"), rules)
    links = F.coalesce(F.regexp_extract_all("html", F.lit(LINK_PATTERN), F.lit(1)), F.array().cast("array<string>"))
    links = F.transform(links, lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    rows = materialise(parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), links.alias("links")))

    hosts = materialise(rows.groupBy("host").agg(
        F.count("*").alias("pages"), F.sum((F.col("ruled") == "allow").cast("long")).alias("allowed"), F.sum((F.col("ruled") == "block").cast("long")).alias("blocked")
    ))
    seeded = hosts.select("host", F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), (F.col("allowed") * 2 > F.col("pages")).alias("seed")),
        F.struct(F.lit("distrust").alias("kind"), (F.col("blocked") * 2 > F.col("pages")).alias("seed")),
    )).alias("s")).filter("s.seed").select("s.kind", "host")
    counts = seeded.groupBy("kind").agg(F.count("*").alias("n"))  # two rows at most
    seeds = materialise(seeded.join(F.broadcast(counts), "kind").select("kind", "host", (F.lit(1.0) / F.col("n")).alias("seed")))

    pairs = rows.select(F.col("host").alias("src"), F.explode("links").alias("dst")).filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    pairs = materialise(pairs)
    if pairs.limit(1).count():
        both = pairs.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(pairs.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
        out = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
        edges = materialise(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share")))
        ranks = spread(edges, seeds)
    else:
        ranks = seeds.select("kind", "host", (F.lit(1 - DAMPING) * F.col("seed")).alias("mass"))
    masses = ranks.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("mass"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("mass"))), F.lit(0.0)).alias("distrust"),
    )
    facts = materialise(hosts.select("host", "pages").join(masses, "host"))
    judged = join_group_facts(rows.drop("links"), facts, "host", "pages", rows.count())
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    own = F.when(distrust > trust * (1 + MARGIN), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def sql(rounds: int = ROUNDS, damping: float = DAMPING) -> str:
    """The verdicts in DuckDB's SQL, a common table expression for each round."""
    steps = "".join(
        f""",
r{k} AS (
  SELECT kind, host, sum(mass) AS mass FROM (
    SELECT e.kind, e.dst AS host, {damping} * r.mass * e.share AS mass FROM r{k - 1} r JOIN edges e ON e.kind = r.kind AND e.src = r.host
    UNION ALL SELECT kind, host, (1 - {damping}) * seed FROM seeds) GROUP BY kind, host)"""
        for k in range(1, rounds + 1)
    )
    link = LINK_PATTERN.replace("'", "''")
    return f"""
WITH cut AS (
  SELECT page_id, coalesce(regexp_extract(url, '^(?s).*?://([^?#]*)', 1), '') AS rest, html FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/]*((?s).*)$', 1) AS path, html FROM cut),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts),
judged AS (SELECT *, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS verdict FROM ruled),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (verdict = 'allow') AS allowed, count(*) FILTER (verdict = 'block') AS blocked FROM judged GROUP BY host),
seeded AS (
  SELECT 'trust' AS kind, host FROM hosts WHERE allowed * 2 > n UNION ALL SELECT 'distrust', host FROM hosts WHERE blocked * 2 > n),
seeds AS (SELECT kind, host, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind) AS seed FROM seeded),
links AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM judged),
pairs AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> dst GROUP BY src, dst),
ways AS (SELECT 'trust' AS kind, src, dst, n FROM pairs UNION ALL SELECT 'distrust', dst, src, n FROM pairs),
edges AS (SELECT kind, src, dst, n::DOUBLE / sum(n) OVER (PARTITION BY kind, src) AS share FROM ways),
r0 AS (SELECT kind, host, seed AS mass FROM seeds){steps},
masses AS (
  SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS distrust FROM r{rounds} GROUP BY host)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.verdict, CASE WHEN coalesce(m.distrust, 0) > coalesce(m.trust, 0) * (1 + {MARGIN!r}::DOUBLE) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN masses m ON m.host = j.host
"""
