"""URL filters: rules by host and path, and trust and distrust spread over the link graph of hosts.

A rule (action, host, path) fits its host and all subdomains if the path starts with its own; the longest fitting rule
decides. All rules compile into one expression. Pages that no rule fits get their host's verdict: hosts are seeded by
the pages that rules allow (trust) or block (distrust); a personalised PageRank spreads trust along links between
hosts and another spreads distrust against them, each with damping ``DAMPING`` and for as many steps as it takes until one
moves less than ``TOLERANCE`` of all rank; what is left to move is then under TOLERANCE * DAMPING / (1 - DAMPING), 0.6 %. As
a step keeps at most DAMPING of the one before, ``STEPS`` steps always do. A host is blocked if
distrust makes up ``BLOCK_SHARE`` or more of both (each a distribution over the hosts).

Plan: one pass over the pages for seeds and one for links, both aggregated by host (or pair of hosts) with partial
sums; ranks and links lie in reliable checkpoints; every step is one join and one aggregate. Host verdicts reach
the pages by broadcast if the hosts to block are few, counted first, else by a join.

Defined results. Null urls and urls without ``://``: empty host and path, no rule, allowed unless that "host" is
seeded. Null html: no links. Links within a host count for nothing; hosts that link nowhere give their rank back to the
seeds. No seeds, no links, empty tables: every page without a rule is allowed. Repeated rows are judged alike and each
counts as a page. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import cut, table

Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
)
DAMPING, TOLERANCE, STEPS, BLOCK_SHARE = 0.85, 1e-3, 47, 0.9
BROADCAST_ROWS = 100_000
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?is)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]*)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def matched(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """A struct of the longest fitting rule's text and action, or null."""
    found = None
    for action, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))
        found = F.when(fits, hit) if found is None else found.when(fits, hit)
    return F.lit(None).cast("struct<rule: string, action: string>") if found is None else found


def link_edges(pages: DataFrame, host: Column, html: Column) -> DataFrame:
    """(src, dst, n): links between different hosts, absolute ones (``x://host`` or ``//host``)."""
    target = F.explode(F.regexp_extract_all(html, F.lit(_LINK), 1))
    links = pages.where(html.isNotNull()).select(host.alias("src"), target.alias("to"))
    absolute = F.when(F.col("to").startswith("//"), F.concat(F.lit("x:"), "to")).otherwise(F.col("to"))
    links = links.where(absolute.contains("://")).select("src", host_of(absolute).alias("dst"))
    return links.where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, steps: int = STEPS) -> DataFrame:
    """Personalised PageRank: edges (src, dst, n) and seeds (host, s), s adding up to 1; gives (host, r)."""
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    e = cut(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("share")))
    nodes = seeds.select("host").unionByName(e.select(F.col("src").alias("host"))).unionByName(e.select(F.col("dst").alias("host"))).distinct()
    ends = e.select(F.col("src").alias("host")).distinct().withColumn("links", F.lit(True))
    base = cut(nodes.join(seeds, "host", "left").join(ends, "host", "left").select("host", F.coalesce("s", F.lit(0.0)).alias("s"), F.col("links").isNotNull().alias("links")))
    rank = base.withColumns({"r": F.col("s"), "moved": F.lit(1.0)})
    for _ in range(steps):
        lost, moved = rank.agg(F.coalesce(F.sum(F.when(~F.col("links"), F.col("r"))), F.lit(0.0)), F.coalesce(F.sum("moved"), F.lit(0.0))).first()
        if moved < TOLERANCE:
            break
        got = e.join(rank.select(F.col("host").alias("src"), "r"), "src").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("r") * F.col("share")).alias("got"))
        new = (1 - DAMPING) * F.col("s") + DAMPING * (F.coalesce("got", F.lit(0.0)) + lost * F.col("s"))
        rank = cut(rank.join(got, "host", "left").select("host", "s", "links", new.alias("r"), F.abs(new - F.col("r")).alias("moved")))
    return rank.select("host", "r")


def host_scores(pages: DataFrame, edges: DataFrame | None, rules: tuple[Rule, ...], url: str = "url", html: str = "html") -> DataFrame:
    """(host, trust, distrust) of every host with a seed or a link. Edges are taken from the html if none are given."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    action = matched(host, path, rules)["action"]
    seeds = pages.select(host.alias("host"), action.alias("action")).groupBy("host").agg(F.count(F.when(F.col("action") == "allow", 1)).alias("a"), F.count(F.when(F.col("action") == "block", 1)).alias("b"))
    seeds = cut(seeds.where("a + b > 0"))
    edges = cut(link_edges(pages, host, F.col(html)) if edges is None else edges)
    a, b = seeds.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    trust = seeds.select("host", (F.col("a") / F.lit(float(max(a, 1)))).alias("s"))
    distrust = seeds.select("host", (F.col("b") / F.lit(float(max(b, 1)))).alias("s"))
    if edges.isEmpty():
        good, bad = trust.withColumnRenamed("s", "r"), distrust.withColumnRenamed("s", "r")
    else:
        good, bad = spread(edges, trust), spread(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), distrust)
    return good.withColumnRenamed("r", "trust").join(bad.withColumnRenamed("r", "distrust"), "host", "full").fillna(0.0, ["trust", "distrust"])


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, edges: DataFrame | None = None, url: str = "url", html: str = "html", out: str = "url_filter") -> DataFrame:
    """All columns of ``pages`` and a struct ``out`` of host, path, rule and verdict."""
    slim = pages.select(F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    scores = host_scores(slim, edges, rules)
    bad = cut(scores.where(F.col("distrust") > 0).where(F.col("distrust") >= BLOCK_SHARE * (F.col("distrust") + F.col("trust"))).select(F.col("host").alias("__bad")))
    few = F.broadcast(bad) if bad.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else bad
    rows = pages.withColumns({"__host": host_of(F.col(f"`{url}`")), "__path": path_of(F.col(f"`{url}`"))})
    rows = rows.withColumn("__rule", matched(F.col("__host"), F.col("__path"), rules)).join(few, F.col("__host") == F.col("__bad"), "left")
    verdict = F.coalesce(F.col("__rule.action"), F.when(F.col("__bad").isNotNull(), "block").otherwise("allow"))
    digest = F.struct(F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule.rule").alias("rule"), verdict.alias("verdict"))
    return rows.select(*[F.col(f"`{c}`") for c in pages.columns], digest.alias(out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "url_filter.*")


def _sql() -> str:
    rules = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
    case = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}') THEN '{what(a, h, p)}'" for a, h, p in rules) + " END"
    link, url = _LINK.replace("'", "''").replace('\\"', '"'), _URL
    lower = f"translate({{}}, '{_UPPER}', '{_UPPER.lower()}')"
    parts = [
        f"p AS (SELECT page_id, html, {lower.format(f'''coalesce(regexp_extract(url, '{url}', 1), '')''')} AS host, coalesce(regexp_extract(url, '{url}', 2), '') AS path FROM pages)",
        f"m AS (SELECT page_id, host, path, {case(lambda a, h, p: h + p)} AS rule, {case(lambda a, h, p: a)} AS action FROM p)",
        f"l AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS t FROM p)",
        f"l2 AS (SELECT src, {lower.format(f'''regexp_extract(CASE WHEN starts_with(t, '//') THEN 'x:' || t ELSE t END, '{url}', 1)''')} AS dst FROM l)",
        "g AS (SELECT src, dst, count(*)::DOUBLE AS n FROM l2 WHERE src <> dst AND dst <> '' GROUP BY ALL)",
        "sd AS (SELECT host, count(*) FILTER (action = 'allow') AS a, count(*) FILTER (action = 'block') AS b FROM m GROUP BY host HAVING count(action) > 0)",
        "n AS (SELECT host FROM sd UNION SELECT src FROM g UNION SELECT dst FROM g)",
    ]
    for k, (src, dst, s) in {"t": ("src", "dst", "a"), "d": ("dst", "src", "b")}.items():
        parts.append(f"{k}e AS (SELECT {src} AS src, {dst} AS dst, n / sum(n) OVER (PARTITION BY {src}) AS share FROM g)")
        parts.append(f"{k}z AS MATERIALIZED (SELECT host, coalesce({s} / greatest((SELECT sum({s}) FROM sd), 1)::DOUBLE, 0) AS s, host IN (SELECT src FROM {k}e) AS links FROM n LEFT JOIN sd USING (host))")
        parts.append(f"{k}0 AS (SELECT *, s AS r FROM {k}z)")
        for i in range(STEPS):
            parts.append(
                f"{k}{i + 1} AS MATERIALIZED (SELECT host, s, links, {1 - DAMPING}::DOUBLE * s + {DAMPING}::DOUBLE * (coalesce(got, 0) + s * coalesce((SELECT sum(r) FROM {k}{i} WHERE NOT links), 0)) AS r"
                f" FROM {k}0 LEFT JOIN (SELECT dst AS host, sum(q.r * share) AS got FROM {k}e JOIN {k}{i} q ON q.host = src GROUP BY dst) USING (host))"
            )
    parts.append(f"bad AS (SELECT host FROM t{STEPS} t JOIN d{STEPS} d USING (host) WHERE d.r > 0 AND d.r >= {BLOCK_SHARE} * (d.r + t.r))")
    return "WITH " + ",\n".join(parts) + "\nSELECT page_id, host, path, rule, coalesce(action, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM m"


SQL = _sql()
