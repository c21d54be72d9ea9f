"""URL filters: rules first, and for what no rule fits, trust and distrust propagated over the graph of hosts.

A rule (host, path, verdict) fits a URL if its host is the rule's or a subdomain of it and its path starts with the
rule's; the longest rule wins. Hosts are the seeds: a host's trust is the number of its pages that a rule allows, its
distrust the number that a rule blocks. Trust flows along links (personalised PageRank), distrust against them: who
links to a distrusted host is distrusted. A third vector, from all pages of a host, is the scale. A page that no rule
fits is blocked if its host's distrust is above its trust and above `threshold` of its scale. A host that is linked but has
no page in the table counts as one page, allowed or blocked if a rule fits the whole host.

Host edges are the absolute links of the pages' html, counted, and (site_edges) a link each way between a host and the host
one label shorter. A host without links keeps what it has. The vectors take `rounds` rounds, after which what is still to
move is below damping^rounds of the whole; edges are summed before they are shuffled, and no host's links are ever collected.

Defined cases: a null url, or one without "://", has an empty host and path, which no rule fits; such pages are no host of the
graph, nor are links without a host, and they are allowed; null html has no links;
repeated rows are judged one by one (and count as pages each); extra columns are not read; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark import cut

DAMPING = 0.85
ROUNDS = 20
THRESHOLD = 0.5
# Host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HOST, _PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^\s"'<>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def with_rule(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """pages (url) with host, path, rule and ruled (the rule's verdict)."""
    out = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, ruled = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    return out.withColumn("rule", rule).withColumn("ruled", ruled)


def link_counts(pages: DataFrame) -> DataFrame:
    """(src, dst, w): how many absolute links the pages (host, html) of a host have to another."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("url"))
    links = links.select("src", F.translate(F.regexp_extract("url", r"//([^/?#]*)", 1), _UPPER, _LOWER).alias("dst")).filter("src <> dst and src <> '' and dst <> ''")
    return links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def all_hosts(pages: DataFrame, links: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(host, scale, trust, distrust) of the hosts of pages (host, ruled), and of those that are only linked."""
    counts = (F.count("*").alias("scale"), F.count(F.when(F.col("ruled") == "allow", 1)).alias("trust"), F.count(F.when(F.col("ruled") == "block", 1)).alias("distrust"))
    hosts = pages.filter("host <> ''").groupBy("host").agg(*counts)
    linked = links.select(F.col("dst").alias("host")).distinct().join(hosts.select("host"), "host", "left_anti")
    linked = with_rule(linked.select(F.concat(F.lit("x://"), "host", F.lit("/")).alias("url")), rules)
    return hosts.unionByName(linked.select("host", F.lit(1).cast("long").alias("scale"), *((F.coalesce(F.col("ruled") == v, F.lit(False))).cast("long").alias(c) for v, c in (("allow", "trust"), ("block", "distrust")))))


def host_edges(links: DataFrame, hosts: DataFrame, site_edges: bool = True) -> DataFrame:
    """(src, dst, w) between different hosts."""
    if site_edges:
        up = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]+\.(.+)$", 1).alias("dst")).filter("dst <> ''")
        up = up.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi")
        both = up.select("src", "dst").unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        links = links.unionByName(both.withColumn("w", F.lit(1.0)))
    return links.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def transitions(edges: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, ahead, back): the share of src's trust, and of its distrust, that goes to dst in a round."""
    out = edges.groupBy("src").agg(F.sum("w").alias("all_out"))
    into = edges.groupBy("dst").agg(F.sum("w").alias("all_in"))
    ahead = edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("all_out")).alias("ahead"), F.lit(0.0).alias("back"))
    back = edges.join(into, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("ahead"), (F.col("w") / F.col("all_in")).alias("back"))
    stay_out = hosts.join(out.select(F.col("src").alias("host")), "host", "left_anti").select(F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(1.0).alias("ahead"), F.lit(0.0).alias("back"))
    stay_in = hosts.join(into.select(F.col("dst").alias("host")), "host", "left_anti").select(F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(0.0).alias("ahead"), F.lit(1.0).alias("back"))
    every = ahead.unionByName(back).unionByName(stay_out).unionByName(stay_in)
    return every.groupBy("src", "dst").agg(F.sum("ahead").alias("ahead"), F.sum("back").alias("back"))


def propagate(hosts: DataFrame, moves: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, cut_every: int = 5) -> DataFrame:
    """(host, scale, trust, distrust) after the given rounds; hosts: (host, scale, trust, distrust) as seeded."""
    names = ("scale", "trust", "distrust")
    seeds = hosts.select("host", *(F.col(c).cast("double").alias(f"seed_{c}") for c in names))
    state = hosts.select("host", *(F.col(c).cast("double").alias(c) for c in names))
    for k in range(rounds):
        sent = moves.join(state.withColumnRenamed("host", "src"), "src")
        got = sent.groupBy(F.col("dst").alias("host")).agg(*(F.sum(F.col(c) * F.col("back" if c == "distrust" else "ahead")).alias(c) for c in names))
        state = seeds.join(got, "host", "left").select("host", *(((1 - damping) * F.col(f"seed_{c}") + damping * F.coalesce(c, F.lit(0.0))).alias(c) for c in names))
        if (k + 1) % cut_every == 0:
            state = cut(state)
    return state


def judge(pages: DataFrame, rules: tuple = RULES, *, threshold: float = THRESHOLD, rounds: int = ROUNDS, site_edges: bool = True) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url, html)."""
    ruled = with_rule(pages.select("page_id", "url", "html"), rules)
    links = cut(link_counts(ruled))
    hosts = cut(all_hosts(ruled, links, rules))
    moves = cut(transitions(cut(host_edges(links, hosts, site_edges)), hosts))
    scores = propagate(hosts, moves, rounds)
    blocked = cut(scores.select("host", F.when((F.col("distrust") > F.col("trust")) & (F.col("distrust") > threshold * F.col("scale")), "block").otherwise("allow").alias("by_graph")))
    lean = with_rule(pages.select("page_id", "url"), rules)
    return lean.join(blocked, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "by_graph", F.lit("allow")).alias("verdict"))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _oracle(rounds: int = ROUNDS, damping: float = DAMPING, threshold: float = THRESHOLD, rules: tuple = RULES) -> str:
    rule = ruled = "NULL"
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"
        rule, ruled = f"CASE WHEN {fits} THEN '{host + path}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{verdict}' ELSE {ruled} END"
    link = _LINK.replace("'", "''")
    over = "NULL"  # the verdict on a host that is only linked
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        over = f"CASE WHEN (dst = '{host}' OR ends_with(dst, '.{host}')) AND starts_with('/', '{path}') THEN '{verdict}' ELSE {over} END"
    steps = "".join(
        f""",
s{k} AS MATERIALIZED (SELECT h.host, {1 - damping} * any_value(h.scale) + {damping} * coalesce(sum(m.ahead * s.scale), 0) AS scale,
  {1 - damping} * any_value(h.trust) + {damping} * coalesce(sum(m.ahead * s.trust), 0) AS trust,
  {1 - damping} * any_value(h.distrust) + {damping} * coalesce(sum(m.back * s.distrust), 0) AS distrust
  FROM hosts h LEFT JOIN moves m ON m.dst = h.host LEFT JOIN s{k - 1} s ON s.host = m.src GROUP BY h.host)"""
        for k in range(1, rounds + 1)
    )
    return f"""WITH urls AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '{_HOST}', 1), ''), '{_UPPER}', '{_LOWER}') AS host, coalesce(regexp_extract(url, '{_PATH}', 1), '') AS path FROM pages),
ruled AS (SELECT *, {rule} AS rule, {ruled} AS ruled FROM urls),
links AS MATERIALIZED (SELECT * FROM (SELECT src, translate(regexp_extract(url, '//([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS dst FROM (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS url FROM ruled WHERE host <> '')) WHERE dst <> ''),
paged AS MATERIALIZED (SELECT host, count(*)::DOUBLE AS scale, (count(*) FILTER (ruled = 'allow'))::DOUBLE AS trust, (count(*) FILTER (ruled = 'block'))::DOUBLE AS distrust FROM ruled WHERE host <> '' GROUP BY host),
hosts AS MATERIALIZED (SELECT * FROM paged UNION ALL SELECT dst, 1.0, (v IS NOT DISTINCT FROM 'allow')::INT::DOUBLE, (v IS NOT DISTINCT FROM 'block')::INT::DOUBLE FROM (SELECT DISTINCT dst, {over} AS v FROM links WHERE src <> dst AND dst NOT IN (SELECT host FROM paged))),
up AS (SELECT host AS src, regexp_extract(host, '^[^.]+\\.(.+)$', 1) AS dst FROM hosts),
site AS (SELECT src, dst FROM up WHERE dst IN (SELECT host FROM hosts) AND dst <> ''),
edges AS MATERIALIZED (SELECT src, dst, sum(w)::DOUBLE AS w FROM (SELECT src, dst, 1.0 AS w FROM links WHERE src <> dst
  UNION ALL SELECT src, dst, 1.0 FROM site UNION ALL SELECT dst, src, 1.0 FROM site) GROUP BY src, dst),
outs AS (SELECT src, sum(w) AS n FROM edges GROUP BY src), ins AS (SELECT dst, sum(w) AS n FROM edges GROUP BY dst),
moves AS MATERIALIZED (SELECT src, dst, sum(ahead) AS ahead, sum(back) AS back FROM (
  SELECT src, dst, w / n AS ahead, 0.0::DOUBLE AS back FROM edges JOIN outs USING (src)
  UNION ALL SELECT dst, src, 0.0, w / n FROM edges JOIN ins USING (dst)
  UNION ALL SELECT host, host, 1.0, 0.0 FROM hosts WHERE host NOT IN (SELECT src FROM outs)
  UNION ALL SELECT host, host, 0.0, 1.0 FROM hosts WHERE host NOT IN (SELECT dst FROM ins)) GROUP BY src, dst),
s0 AS (SELECT host, scale, trust, distrust FROM hosts){steps}
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN distrust > trust AND distrust > {threshold} * scale THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN s{rounds} USING (host)"""


OP8_SQL = _oracle()
