"""URL filters: host and path rules, and trust spread over the link graph for the rest.

Rules.  Distinct (host, path) pairs are joined with the rules on each suffix of the host; the
longest rule whose path begins the url's wins.

Method.  Pages that a rule decides are seeds: a host is trusted by its share of allowed pages and
distrusted by its share of blocked ones.  Trust runs along links: personalised PageRank from the trusted, where a
host divides its rank among the hosts it links to.  Distrust runs against them, from the blocked: a host receives from each
host it links to that one's distrust times the share of its own links that lead there, so however many others link to a
blocked host, one that links to nothing else is suspect.  A host that links nowhere keeps its own share of both.  A
page without a rule is blocked if its host's distrust reaches ``threshold`` and exceeds its trust.  Ranks are whole
numbers (SCALE is 1), so results do not depend on the order of additions.  Rounds end when no rank changes, or after ROUNDS,
when what is still on its way is below a thousandth (DAMPING to that power).

The graph is one of hosts, aggregated before it is shuffled; each
round's ranks are a table in the shared folder, which goes when the next one is written.  Everything is DataFrame operations.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is
allowed; null html has no links; repeated rows are judged alike and count as pages each; without rules nothing is blocked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, sized, written

SCALE = 10**9
DAMPING = 85  # percent
ROUNDS = 43
THRESHOLD = SCALE // 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""

Rule = tuple[str, str]  # verdict, host and path such as example.com/en/


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def suffixes(name: Column) -> Column:
    """A host and the domains it is in: a.b.c, b.c, c."""
    labels = F.split(name, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule for each distinct (host, path) that one fits: host, path, rule, rule_verdict.

    rules: rule (host and path), verdict.  Of rules of one length the longer host wins.
    """
    r = rules.select(
        F.col("rule"),
        F.col("verdict").alias("rule_verdict"),
        F.substring_index("rule", "/", 1).alias("rule_host"),
        F.expr("substr(rule, length(substring_index(rule, '/', 1)) + 1)").alias("rule_path"),
    )
    u = urls.select("host", "path").distinct().select("host", "path", F.explode(suffixes(F.col("host"))).alias("suffix"))
    fits = u.join(r, (F.col("suffix") == F.col("rule_host")) & F.startswith("path", "rule_path"))
    order = F.struct(F.length("rule"), F.length("rule_host"), F.col("rule"), F.col("rule_verdict"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), order).alias("best"))
    return best.select("host", "path", "best.*")


def edges(pages: DataFrame) -> DataFrame:
    """Host edges (src, dst, w): how many links of pages (url, html) go from one host to another.

    Relative links count as links to the page's own host; addresses such as mailto: are left out.
    """
    links = pages.select(host(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1)).alias("link"))
    absolute = F.translate(F.regexp_extract("link", "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), UPPER, LOWER)
    other = F.col("link").rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & (absolute == "")
    dst = F.when(absolute != "", absolute).when(~other, F.col("src"))
    return links.select("src", dst.alias("dst")).where("dst IS NOT NULL AND src <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


def spread(seeds: DataFrame, graph: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust) and edges (src, dst, w).

    kind 1 is trust along links, kind 2 distrust against them.  A rank moves from ``src`` to ``dst`` with the weight
    w / total; total are the links of the page's host in either kind.
    """
    graph = written(graph, "links")
    totals = graph.groupBy("src").agg(F.sum("w").alias("total"))
    along = graph.join(totals, "src").select("src", "dst", "w", "total")
    both = along.select(F.lit(1).alias("kind"), "*").unionByName(along.select(F.lit(2).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w", "total"))
    both = written(both, "host-edges")
    n_edges = both.count()
    start = seeds.select("host", F.explode(F.array(F.struct(F.lit(1).alias("kind"), F.col("trust").alias("seed")), F.struct(F.lit(2).alias("kind"), F.col("distrust").alias("seed")))).alias("s"))
    start = start.select("s.kind", "host", "s.seed")
    # a host that links nowhere passes no trust on and receives no distrust, so it keeps its own of either kind
    ends = totals.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("kind"), F.col("src").alias("host"), F.lit(True).alias("has_links"))
    nodes = start.select("kind", "host").unionByName(both.select("kind", F.col("dst").alias("host"))).unionByName(both.select("kind", F.col("src").alias("host"))).distinct()
    nodes = nodes.join(start, ["kind", "host"], "left").join(ends, ["kind", "host"], "left")
    state = written(nodes.select("kind", "host", F.coalesce("seed", F.lit(0).cast("long")).alias("seed"), F.coalesce("has_links", F.lit(False)).alias("has_links")).withColumn("rank", F.col("seed")).withColumn("before", F.lit(None).cast("long")), "host-ranks")
    share = F.expr("CAST(CAST(rank AS DECIMAL(19,0)) * CAST(w AS DECIMAL(19,0)) div CAST(total AS DECIMAL(19,0)) AS BIGINT)")
    for _ in range(rounds):
        moved = sized(both, n_edges).join(state.select("kind", F.col("host").alias("src"), "rank").where("rank > 0"), ["kind", "src"]).select(
            "kind", F.col("dst").alias("host"), share.alias("got"), F.lit(None).cast("long").alias("seed"), F.lit(None).cast("boolean").alias("has_links"), F.lit(None).cast("long").alias("before")
        )
        # what a node keeps goes with its seed, so one aggregation makes the next ranks
        kept = F.when(F.col("has_links"), F.lit(0).cast("long")).otherwise(F.col("rank")).alias("got")
        together = moved.unionByName(state.select("kind", "host", kept, "seed", "has_links", F.col("rank").alias("before")))
        # a host may gather from all others, so sums are wider than a rank
        summed = together.groupBy("kind", "host").agg(F.sum(F.col("got").cast("decimal(28,0)")).alias("got"), F.max("seed").alias("seed"), F.max("has_links").alias("has_links"), F.max("before").alias("before"))
        rank = F.expr(f"CAST((CAST({100 - DAMPING} AS DECIMAL(3,0)) * seed + CAST({DAMPING} AS DECIMAL(3,0)) * got) div CAST(100 AS DECIMAL(3,0)) AS BIGINT)").alias("rank")
        # the next round reads these ranks twice, so each round's plan would double the one before
        old, state = state, written(summed.select("kind", "host", "seed", "has_links", rank, "before"), "host-ranks")
        dropped(old)
        if state.where("rank <> before").isEmpty():
            break
    dropped(graph, both)
    return state.groupBy("host").agg(F.sum(F.expr("CASE WHEN kind = 1 THEN rank END")).alias("trust"), F.sum(F.expr("CASE WHEN kind = 2 THEN rank END")).alias("distrust"))


def judge(pages: DataFrame, rules: Sequence[Rule] | DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        each = [F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for v, r in rules]
        rules = spark.range(1).select(F.inline(F.array(*each))) if each else spark.range(0).selectExpr("'' AS rule", "'' AS verdict")
    named = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    ruled = written(named.join(matched(named, rules), ["host", "path"], "left"), "url-rules")
    part = lambda v: F.expr(f"count_if(rule_verdict = '{v}') * {SCALE}L div count(1)")
    seeds = ruled.where("host <> ''").groupBy("host").agg(part("allow").alias("trust"), part("block").alias("distrust"))
    ranks = spread(seeds, edges(pages))
    bad = (F.coalesce("distrust", F.lit(0)) >= threshold) & (F.coalesce("distrust", F.lit(0)) > F.coalesce("trust", F.lit(0)))
    return ruled.join(ranks, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0).cast("long")).alias("trust"),
        F.coalesce("distrust", F.lit(0).cast("long")).alias("distrust"),
    )


def oracle(rules: Sequence[Rule], rounds: int = ROUNDS, threshold: int = THRESHOLD) -> str:
    """DuckDB SQL for judge() over pages, one table expression for each round."""
    host_of = "translate(regexp_extract({}, '{}', 1), '" + UPPER + "', '" + LOWER + "')"
    values = ", ".join(f"('{v}', '{r}', '{r.split('/')[0]}', '{r[len(r.split('/')[0]):]}')" for v, r in rules)
    link = LINK.replace("'", "''")
    sql = [
        f"""WITH r(v, rule, h, p) AS (VALUES {values}),
n AS MATERIALIZED (SELECT page_id, html, {host_of.format("coalesce(url, '')", "://([^/?#]*)")} AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
u AS MATERIALIZED (SELECT host, path, max(row(length(rule), length(h), rule, v)) AS best FROM (SELECT DISTINCT host, path FROM n) d
  JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path),
j AS MATERIALIZED (SELECT page_id, n.host, n.path, best[3] AS rule, best[4] AS rv FROM n LEFT JOIN u ON n.host = u.host AND n.path = u.path),
l AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS link FROM n WHERE host <> ''),
e0 AS (SELECT src, link, {host_of.format("link", "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)")} AS a FROM l),
e AS (SELECT src, CASE WHEN a <> '' THEN a WHEN NOT regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN src END AS dst, count(*) AS w FROM e0 GROUP BY ALL),
t0 AS MATERIALIZED (SELECT src, dst, w, sum(w) OVER (PARTITION BY src) AS total FROM e WHERE dst IS NOT NULL),
b AS MATERIALIZED (SELECT 1 AS kind, src, dst, w, total FROM t0 UNION ALL SELECT 2, dst, src, w, total FROM t0),
s AS (SELECT host, {SCALE} * count(*) FILTER (rv = 'allow') // count(*) AS trust, {SCALE} * count(*) FILTER (rv = 'block') // count(*) AS distrust FROM j WHERE host <> '' GROUP BY host),
s2 AS (SELECT 1 AS kind, host, trust AS seed FROM s UNION ALL SELECT 2, host, distrust FROM s),
nodes AS (SELECT kind, host FROM s2 UNION SELECT kind, src FROM b UNION SELECT kind, dst FROM b),
k0 AS MATERIALIZED (SELECT nodes.kind, nodes.host, coalesce(seed, 0) AS seed, EXISTS (SELECT 1 FROM t0 WHERE t0.src = nodes.host) AS has, coalesce(seed, 0) AS rank
  FROM nodes LEFT JOIN s2 ON s2.kind = nodes.kind AND s2.host = nodes.host)"""
    ]
    for k in range(1, rounds + 1):
        sql.append(
            f"k{k} AS MATERIALIZED (SELECT k.kind, k.host, k.seed, k.has, ({100 - DAMPING} * k.seed + {DAMPING} * (coalesce(g.got, 0) + CASE WHEN k.has THEN 0 ELSE k.rank END)) // 100 AS rank"
            f" FROM k{k - 1} k LEFT JOIN (SELECT b.kind, b.dst, sum(CAST(x.rank AS HUGEINT) * b.w // b.total) AS got FROM b JOIN k{k - 1} x ON x.kind = b.kind AND x.host = b.src GROUP BY ALL) g ON g.kind = k.kind AND g.dst = k.host)"
        )
    sql.append(f"t AS (SELECT host, max(rank) FILTER (kind = 1) AS trust, max(rank) FILTER (kind = 2) AS distrust FROM k{rounds} GROUP BY host)")
    return (
        ",\n".join(sql)
        + f"""
SELECT page_id, j.host AS host, path, rule, coalesce(rv, CASE WHEN coalesce(distrust, 0) >= {threshold} AND coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(coalesce(trust, 0) AS BIGINT) AS trust, CAST(coalesce(distrust, 0) AS BIGINT) AS distrust FROM j LEFT JOIN t ON t.host = j.host"""
    )
