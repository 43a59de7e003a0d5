"""URL filters: rules, and beyond them trust and distrust spread over the host graph.

Hosts are vertices, links between pages of different hosts weighted edges. Trust
is personalised PageRank from hosts whose pages a rule allows, distrust the same
over reversed edges from hosts whose pages a rule blocks (a host that links to
blocked hosts is suspect). A page without a rule is blocked where its host's
distrust is above its trust and above a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import cut, small_join, table

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING, ITERATIONS = 0.85, 20
#: A host is blocked from this share of a host's mean distrust (1 / hosts) on, over its trust.
THRESHOLD = 1e-3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK_RE = r"""(?i)\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>/?#]*)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to / ? # or the end, A-Z lower-cased; null or without ``://``: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(host: Column) -> Column:
    """The host and all domains above it."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def page_rank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """(src, dst, weight), (host, seed) -> (host, rank): walks that start, and start again, at the seeds.

    A walk that comes to a host without links starts again. Seeds sum to 1 (or
    there are none: no rank). Contributions meet as sums by host.
    """
    out = edges.groupBy(F.col("src").alias("host")).agg(F.sum("weight").alias("out"))
    steps = cut(edges.join(out, edges["src"] == out["host"]).select("src", "dst", (F.col("weight") / F.col("out")).alias("p")), "steps")
    ranks = seeds.select("host", F.col("seed").alias("rank"))
    if steps.isEmpty():
        return ranks
    leaves = steps.select(F.col("src").alias("host")).distinct()
    for _ in range(iterations):
        # what does not move on, at dead ends and by the damping, starts again at the seeds
        going = ranks.join(leaves, "host", "left_semi").agg(F.sum("rank")).first()[0] or 0.0
        moved = ranks.join(steps, ranks["host"] == steps["src"]).groupBy(F.col("dst").alias("host")).agg((F.sum(F.col("rank") * F.col("p")) * damping).alias("rank"))
        start = seeds.select("host", (F.col("seed") * F.lit(1 - damping * going)).alias("rank"))
        ranks = cut(moved.unionByName(start).groupBy("host").agg(F.sum("rank").alias("rank")), "ranks")
    return ranks


def judge(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url", html: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every page.

    A rule fits its host and all subdomains if the path starts with the rule's;
    the longest wins. Null urls and those without ``://`` have empty host and
    path, fit no rule and are judged as the host "". Null html has no links.
    Repeated rows are judged each. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    named = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    listed = spark.createDataFrame([(r.partition("/")[0], "/" + r.partition("/")[2], r, v) for v, r in rules], "domain string, prefix string, rule string, verdict string")
    hosts = cut(named.groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    n_hosts = hosts.count()
    # the rules of each host, from its domains
    of_host = small_join(hosts.select("host", F.explode(_suffixes(F.col("host"))).alias("domain")), listed, "domain", rows=len(rules))
    of_host = of_host.groupBy(F.col("host").alias("_h")).agg(F.collect_list(F.struct(F.length("rule").alias("size"), "rule", "prefix", "verdict")).alias("rules"))
    of_host = cut(hosts.join(of_host, F.col("host") == F.col("_h"), "left").select("host", "rules"), "rules")
    ruled = small_join(named, of_host, "host", rows=n_hosts)
    best = F.array_max(F.filter(F.coalesce("rules", F.array().cast(of_host.schema["rules"].dataType)), lambda r: F.startswith(F.col("path"), r["prefix"])))
    ruled = cut(ruled.select("page_id", "host", "path", best.alias("best")), "ruled")

    seeds = ruled.groupBy("host").agg(F.count_if(F.col("best.verdict") == "allow").alias("allowed"), F.count_if(F.col("best.verdict") == "block").alias("blocked"))
    seeds = cut(seeds.filter("allowed + blocked > 0"), "seeds")
    sums = seeds.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()

    links = pages.select(host_of(F.col(url)).alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html).cast("string"), F.lit("")), F.lit(LINK_RE), F.lit(1))).alias("link"))
    # a link "//host" has its page's scheme
    target = host_of(F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("x:"), "link")).otherwise(F.col("link")))
    edges = links.select("src", target.alias("dst")).filter("src <> dst AND src <> '' AND dst <> ''")
    edges = cut(edges.groupBy("src", "dst").agg(F.count("*").alias("weight")), "edges")
    trust = page_rank(edges, seeds.filter("allowed > 0").select("host", (F.col("allowed") / (sums["a"] or 1)).alias("seed")))
    against = page_rank(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), seeds.filter("blocked > 0").select("host", (F.col("blocked") / (sums["b"] or 1)).alias("seed")))
    scores = trust.select("host", F.col("rank").alias("trust")).join(against.select("host", F.col("rank").alias("distrust")), "host", "full")
    scores = cut(hosts.join(scores, "host", "left").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")), "scores")
    method = F.when((F.col("distrust") * n_hosts >= threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    out = small_join(ruled, scores, "host", rows=n_hosts)
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", method).alias("verdict"), "trust", "distrust")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))
