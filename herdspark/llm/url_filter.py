"""URL filtering by rules and by trust that spreads over the link graph of hosts.

Rules name a host, with all subdomains, and the beginning of a path; the longest
that fits decides. Pages without a rule are judged by their host: personalised
PageRank spreads trust from hosts that rules allow along links, and distrust from
hosts that rules block against the links, as who links to a blocked host is
suspect. Links are the absolute links of the pages, and a host's place under its
parent domain, in both directions.

Scores are kept per host and round in a table; every round is one join with the
edges and one sum, and the lineage is cut after it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdspark.llm.common import folded
from herdspark.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))
DAMPING = 0.7
ROUNDS = 8
#: A host is blocked if its distrust is above its trust and at least this many times its share of all pages.
LEAST_LIFT = 1.0
#: Scores are compared to so many decimals, so that the order of additions does not matter.
DECIMALS = 12

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""[hH][rR][eE][fF]\s*=\s*["']?(?:[A-Za-z][A-Za-z0-9+.-]{1,15}:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return folded(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def host_rules(hosts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(host, rules): the rules that hold for a host, longest first; found by joining its domains with the rules."""
    spark = hosts.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in rules], "domain string, start string, rule string, verdict string")
    labels = F.split("host", r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    found = hosts.select("host", F.explode(domains).alias("domain")).join(table, "domain")
    order = F.struct((-F.char_length("rule")).alias("size"), "rule", "start", "verdict")
    return found.groupBy("host").agg(F.sort_array(F.collect_list(order)).alias("rules"))


def page_verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, ruled): ``rule`` and its verdict are null where none fits."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    by_host = cut_lineage(host_rules(urls.select("host").distinct(), rules))
    fits = F.filter(F.coalesce("rules", F.array().cast(by_host.schema["rules"].dataType)), lambda r: F.col("path").startswith(r["start"]))
    best = F.get(fits, F.lit(0))
    return urls.join(by_host, "host", "left").select(
        "page_id", "host", "path", best["rule"].alias("rule"), best["verdict"].alias("ruled")
    )


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) of absolute links between hosts, counted per page and host."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    targets = F.when(html.contains("//"), F.regexp_extract_all(html, F.lit(_LINK), F.lit(1)))
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(targets).alias("dst")).withColumn("dst", folded(F.col("dst")))
    return found.filter("src != '' AND src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def host_graph(hosts: DataFrame, links: DataFrame) -> DataFrame:
    """(source, target, trust_share, distrust_share) for one step of both walks.

    ``hosts`` has (host, pages). Trust leaves a host over its links in proportion
    to their weights; distrust leaves it over the links that lead to it. A host
    and its parent domain are linked both ways with the weight of the host's pages.
    """
    up = hosts.select(F.col("host").alias("src"), F.col("pages").cast("double").alias("weight"))
    # A domain name has at most 127 labels; a chain ends at two labels.
    labels = F.size(F.split("src", r"\."))
    steps = up.withColumn("step", F.explode(F.sequence(F.lit(1), F.greatest(labels - 2, F.lit(1))))).filter(labels > 2)
    parts = F.split("src", r"\.")
    below = F.array_join(F.slice(parts, F.col("step"), F.size(parts)), ".")
    above = F.array_join(F.slice(parts, F.col("step") + 1, F.size(parts)), ".")
    ladder = steps.groupBy(below.alias("src"), above.alias("dst")).agg(F.sum("weight").alias("weight"))
    both = ladder.unionByName(ladder.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    edges = cut_lineage(
        both.unionByName(links).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    )
    leaving = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    entering = edges.groupBy("dst").agg(F.sum("weight").alias("total"))
    share = F.col("weight") / F.col("total")
    trust = edges.join(leaving, "src").select(F.col("src").alias("source"), F.col("dst").alias("target"), share.alias("trust_share"), F.lit(0.0).alias("distrust_share"))
    distrust = edges.join(entering, "dst").select(F.col("dst").alias("source"), F.col("src").alias("target"), F.lit(0.0).alias("trust_share"), share.alias("distrust_share"))
    return cut_lineage(trust.unionByName(distrust))


def propagate(seeds: DataFrame, graph: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) after some rounds from (host, trust, distrust) seeds that sum up to one each."""
    now = seeds
    start = seeds.select("host", *[(F.col(c) * (1 - damping)).alias(c) for c in ("trust", "distrust")])
    for _ in range(rounds):
        moved = now.join(graph, F.col("host") == F.col("source")).select(
            F.col("target").alias("host"),
            (F.col("trust") * F.col("trust_share") * damping).alias("trust"),
            (F.col("distrust") * F.col("distrust_share") * damping).alias("distrust"),
        )
        now = cut_lineage(
            start.unionByName(moved).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        )
    return now


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping: float = DAMPING, rounds: int = ROUNDS, least_lift: float = LEAST_LIFT) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per page.

    The rule's verdict, or else the host's. Null urls and urls without ``://``
    have an empty host and path and are allowed. Null html has no links. Pages
    repeated, or without id, are answered each. Where no page has a rule all are
    allowed; an empty table gives no rows.
    """
    ruled = cut_lineage(page_verdicts(pages, rules))
    counted = ruled.filter("host != ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count(F.when(F.col("ruled") == "allow", 1)).alias("allowed"),
        F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"),
    )
    hosts = cut_lineage(counted)
    total = hosts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("pages", "allowed", "blocked")]).first()
    seeds = cut_lineage(
        hosts.filter("allowed + blocked > 0").select(
            "host",
            (F.col("allowed") / F.lit(float(max(total[1], 1)))).alias("trust"),
            (F.col("blocked") / F.lit(float(max(total[2], 1)))).alias("distrust"),
        )
    )
    scores = propagate(seeds, host_graph(hosts, host_links(pages)), damping, rounds)
    trust, distrust = (F.round(F.col(c), DECIMALS) for c in ("trust", "distrust"))
    lift = F.col("distrust") * F.lit(float(total[0])) / F.col("pages")
    bad = cut_lineage(
        hosts.join(scores, "host")
        .filter((distrust > trust) & (F.round(lift, DECIMALS - 3) >= least_lift))
        .select("host", F.lit("block").alias("judged"))
    )
    return ruled.join(bad, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "judged", F.lit("allow")).alias("verdict")
    )


def check_sql(rules: tuple[Rule, ...] = RULES, damping: float = DAMPING, rounds: int = ROUNDS, least_lift: float = LEAST_LIFT) -> str:
    """The same result in DuckDB SQL, for the query's check."""
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    link = _LINK.replace("'", "''")
    values = ", ".join(f"('{r.host}', '{r.path}', '{r.text}', '{r.verdict}')" for r in rules)
    walk = "".join(
        f""", x{n + 1} AS MATERIALIZED (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (
            SELECT host, trust * (1 - {damping}) AS trust, distrust * (1 - {damping}) AS distrust FROM x0 UNION ALL
            SELECT target, trust * ts * {damping}, distrust * ds * {damping} FROM x{n} JOIN graph ON host = source) GROUP BY host)"""
        for n in range(rounds)
    )
    return f"""
    WITH u AS (SELECT page_id, html, {fold.format(f"coalesce(regexp_extract(url, '{_URL}', 1), '')")} AS host, coalesce(regexp_extract(url, '{_URL}', 2), '') AS path FROM pages),
    rules(domain, start, rule, ruled) AS (VALUES {values}),
    ruled AS MATERIALIZED (SELECT page_id, host, path, first(rule ORDER BY length(rule) DESC, rule) AS rule, first(ruled ORDER BY length(rule) DESC, rule) AS ruled
        FROM (SELECT row_number() OVER () AS rid, * EXCLUDE html FROM u) LEFT JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start)
        GROUP BY rid, page_id, host, path),
    hosts AS MATERIALIZED (SELECT host, count(*) AS pages, count(*) FILTER (ruled = 'allow') AS allowed, count(*) FILTER (ruled = 'block') AS blocked FROM ruled WHERE host != '' GROUP BY host),
    total AS (SELECT sum(pages) AS pages, greatest(sum(allowed), 1) AS allowed, greatest(sum(blocked), 1) AS blocked FROM hosts),
    x0 AS MATERIALIZED (SELECT host, hosts.allowed / total.allowed AS trust, hosts.blocked / total.blocked AS distrust FROM hosts, total WHERE hosts.allowed + hosts.blocked > 0),
    links AS (SELECT host AS src, {fold.format('dst')} AS dst, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS dst FROM u)
        WHERE host != '' AND host != {fold.format('dst')} GROUP BY 1, 2),
    ladder AS (SELECT array_to_string(p[s:], '.') AS src, array_to_string(p[s + 1:], '.') AS dst, CAST(sum(pages) AS DOUBLE) AS weight
        FROM (SELECT p, pages, unnest(range(1, len(p) - 1)) AS s FROM (SELECT string_split(host, '.') AS p, pages FROM hosts)) GROUP BY 1, 2),
    edges AS MATERIALIZED (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM ladder UNION ALL SELECT dst, src, weight FROM ladder UNION ALL SELECT * FROM links) GROUP BY 1, 2),
    graph AS MATERIALIZED (SELECT src AS source, dst AS target, weight / sum(weight) OVER (PARTITION BY src) AS ts, 0.0 AS ds FROM edges
        UNION ALL SELECT dst, src, 0.0, weight / sum(weight) OVER (PARTITION BY dst) FROM edges){walk},
    bad AS (SELECT host FROM hosts JOIN x{rounds} USING (host), total WHERE round(distrust, {DECIMALS}) > round(trust, {DECIMALS}) AND round(distrust * total.pages / hosts.pages, {DECIMALS - 3}) >= {least_lift})
    SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled
    """
