"""Queries by index: vectors by graph, names by trigrams, percentiles by selection, policies by postings, long walks."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators import access, policies, search, selection, vector_index, walks
from skein.registry import query
from skein.session import table as t


def asked_vectors(v):
    return v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


@query("vs02_graph")
def graph_neighbours(s, d):
    """The ten nearest of every fiftieth vector, itself included, by small-world graphs over all vectors."""
    v = t(s, d, "embeddings")
    found = vector_index.search(vector_index.build(v, "vec_id", "embedding"), asked_vectors(v), 10)
    return found.select("query", "rank", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"))


@query("vs02_exact", """WITH p AS (SELECT q.vec_id AS query, v.vec_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0)
SELECT query, rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INT AS rank FROM p) WHERE rank <= 10""")
def exact_neighbours(s, d):
    """The same by a scan."""
    v = t(s, d, "embeddings")
    return vector_index.exact(v, asked_vectors(v), "vec_id", "embedding", 10).select("query", "rank", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"))


@query("vs08_name_pairs", """WITH n AS (SELECT DISTINCT lower(p_name || ' ' || p_type) AS name FROM part),
g AS (SELECT name, list_distinct(list_transform(range(1, length(name) + 2), lambda i: substring('  ' || name || ' ', i, 3))) AS g FROM n),
p AS (SELECT a.name AS a, b.name AS b, len(list_intersect(a.g, b.g)) AS n, len(a.g) + len(b.g) AS m FROM g a JOIN g b ON a.name < b.name)
SELECT a, b, round(n / (m - n)::DOUBLE, 6) AS score FROM p WHERE n / (m - n)::DOUBLE >= 0.3""")
def name_pairs(s, d):
    """All names of parts, each with its type, against each other."""
    names = t(s, d, "part").select(F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("name")).distinct()
    return search.similar_pairs(names.withColumn("k", F.col("name")), "k", "name", 0.3).select("a", "b", F.round("score", 6).alias("score"))


@query("ag25_selected", """SELECT l_shipmode AS mode, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99
FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, l_extendedprice FROM lineitem) GROUP BY 1""")
def selected(s, d):
    """Percentiles of prices by status, exact however many rows a status has."""
    rows = t(s, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("mode"), "l_extendedprice")
    out = selection.exact_percentiles(rows, ["mode"], "l_extendedprice", (0.5, 0.9, 0.95, 0.99), few=20_000)
    return out.select("mode", *[F.round(c, 4).alias(c) for c in out.columns[1:]])


def policy_table(s, d):
    """A policy table from the nations: each denies its customers of low balance and allows those of two segments; one more can't be read."""
    n = t(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    one = lambda kind, effect, place, order, body: F.struct(F.concat(F.lit(kind), F.col("k").cast("string")).alias("policy"), F.lit(effect).alias("effect"), place.alias("place"), F.lit(order).alias("rule_order"), body.alias("expression"))
    nation = F.to_json(F.struct(F.lower("name").alias("resource.nation")))
    poor = F.to_json(F.struct(F.struct((F.col("k") * 40).alias("max")).alias("resource.balance")))
    both = F.to_json(F.struct(F.array(F.lit("BUILDING"), F.lit("MACHINERY")).alias("resource.segment"), F.struct(F.lit(0).alias("min")).alias("resource.balance"), F.col("name").alias("resource.nation")))
    rows = n.select(F.inline(F.array(
        one("deny", "deny", 2 * F.col("k"), 1, nation), one("deny", "deny", 2 * F.col("k"), 2, poor), one("allow", "ALLOW", 2 * F.col("k") + 1, 1, both), one("odd", "DENY", F.lit(-1).cast("int"), 1, F.lit('{"action": ')),
    )))
    c = t(s, d, "customer").join(n, F.col("c_nationkey") == F.col("k"))
    held = lambda name, value: F.struct(F.lit(name).alias("attribute"), value.cast("string").alias("value"), F.lit(False).alias("many"))
    attributes = c.select("c_custkey", F.inline(F.array(held("resource.nation", F.col("name")), held("resource.segment", F.col("c_mktsegment")), held("resource.balance", F.col("c_acctbal")))))
    return t(s, d, "customer").select("c_custkey"), attributes, rows


@query("ac02_policy_index", "SELECT c_custkey, NOT c_acctbal <= 40 * c_nationkey AS allowed, CASE WHEN c_acctbal <= 40 * c_nationkey THEN 'deny' || c_nationkey END AS policy FROM customer")
def policy_deny(s, d):
    """All customers against the policy table: a deny wins, without one allowed."""
    return policies.decide(*policy_table(s, d), "c_custkey", deny_overrides=True).select("c_custkey", "allowed", "policy")


FIRST = "CASE WHEN c_acctbal <= 40 * c_nationkey THEN 'deny' || c_nationkey WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 0 THEN 'allow' || c_nationkey END"


@query("ac03_policy_index", f"SELECT c_custkey, coalesce({FIRST} LIKE 'allow%', false) AS allowed, {FIRST} AS policy FROM customer")
def policy_first(s, d):
    """The same: the first policy that matches decides, without one denied."""
    return policies.decide(*policy_table(s, d), "c_custkey", deny_overrides=False).select("c_custkey", "allowed", "policy")


@query("gr14_deep", "WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS level FROM events) SELECT event_id AS node, first_value(event_id) OVER (PARTITION BY event_type ORDER BY level) AS root, level FROM r")
def deep_hierarchy(s, d):
    """Threads of all events of a type, each an answer to the one before: thousands of levels."""
    e = t(s, d, "events")
    rows = e.select(F.col("event_id").alias("node"), F.lag("event_id").over(W.partitionBy("event_type").orderBy("ts", "event_id")).alias("parent"))
    return walks.roots(rows).select("node", "root", "level")


@query("ln04_long_trace", "WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events) SELECT event_id AS target, first_value(event_id) OVER (PARTITION BY user_id ORDER BY n) AS source, n AS steps FROM r")
def long_trace(s, d):
    """Each event traced to its user's first, by the earliest of the edges to what came before."""
    line = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t(s, d, "events").select("event_id", F.lag("event_id", 1).over(line).alias("one"), F.lag("event_id", 2).over(line).alias("two"))
    edges = rows.select(F.col("event_id").alias("target"), F.inline(F.array(F.struct(F.col("two").alias("source"), F.lit(2).alias("created")), F.struct(F.col("one").alias("source"), F.lit(1).alias("created")))))
    found = walks.trace(edges.filter("source IS NOT NULL")).select("target", "source", "steps")
    # users with one event have no edge
    return rows.select(F.col("event_id").alias("target")).join(found, "target", "left").select("target", F.coalesce("source", "target").alias("source"), F.coalesce("steps", F.lit(0)).alias("steps"))


@query("gr09_labels", """WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R' UNION SELECT 'p' || l_partkey, 'o' || l_orderkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders WHERE o_orderstatus = 'F'),
w AS (SELECT DISTINCT 's' || s_suppkey AS start, 's' || s_suppkey AS node, 0 AS hops FROM supplier UNION SELECT start, dst, hops + 1 FROM w JOIN e ON src = node WHERE hops < 3), m AS (SELECT start, node, min(hops) AS hops FROM w GROUP BY ALL)
SELECT start, hops, count(*) AS nodes, sum(substr(node, 2)::BIGINT)::BIGINT AS total FROM m GROUP BY ALL""")
def labelled_reach(s, d):
    """From every supplier over returned parts and their orders to the customers of finished ones, over the edges of the whole lineitem table: how many nodes at each distance."""
    # a node is a number: its key, and in the last two bits its kind
    node = lambda c, kind: F.shiftleft(F.col(c).cast("long"), 2) + "spoc".index(kind)
    edge = lambda df, a, x, b, y, label: df.select(node(x, a).alias("src"), node(y, b).alias("dst"), F.concat(F.lit(label), F.col(df.columns[-1])).alias("label"))
    items = t(s, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_returnflag")
    edges = edge(items, "s", "l_suppkey", "p", "l_partkey", "SUPPLIES_").unionByName(edge(items, "p", "l_partkey", "o", "l_orderkey", "IN_"))
    edges = edges.unionByName(edge(t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o", "o_orderkey", "c", "o_custkey", "OF_"))
    found = walks.within_labels(edges, t(s, d, "supplier").select(node("s_suppkey", "s").alias("node")), ("SUPPLIES_R", "IN_R", "OF_F"), 3)
    sums = found.groupBy("start", "hops").agg(F.count("*").alias("nodes"), F.sum(F.shiftright("node", 2)).alias("total"))
    return sums.select(F.concat(F.lit("s"), F.shiftright("start", 2).cast("string")).alias("start"), "hops", "nodes", "total")


@query("ac04_values", "SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS listed, lower(c_mktsegment) = 'household' AS same, c_nationkey % 3 = 0 AND c_mktsegment <> 'BUILDING' OR c_nationkey % 3 > 0 AND c_mktsegment = 'BUILDING' AS held FROM customer")
def values(s, d):
    """One condition each way: a value in a list, a value in any case, a list that holds what is expected."""
    one = F.array("c_mktsegment")
    roles = F.when(F.col("c_nationkey") % 3 == 0, F.array_remove(F.array(F.lit("reader"), F.lit("writer"), F.when(F.col("c_mktsegment") != "BUILDING", "admin").otherwise("none")), "writer")).otherwise(F.array("c_mktsegment"))
    wanted = F.when(F.col("c_nationkey") % 3 == 0, F.array(F.lit("admin"))).otherwise(F.array(F.lit("BUILDING")))
    match = lambda actual, many, expected: access.value_matches(actual, F.lit(many), expected)
    return t(s, d, "customer").select(
        "c_custkey", match(one, False, F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).alias("listed"), match(one, False, F.array(F.lit("Household"))).alias("same"), match(roles, True, wanted).alias("held"),
    )


@query("gr13_most_similar", """WITH p AS (SELECT a.vec_id, b.vec_id AS other, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT vec_id, rank, other, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other)::INT AS rank FROM p) WHERE rank <= 5""")
def most_similar(s, d):
    """The five stories most alike to each of its kind."""
    found = vector_index.most_similar(t(s, d, "embeddings"), "vec_id", "label", "embedding", 5, block=512)
    return found.select(F.col("key").alias("vec_id"), "rank", "other", F.round("score", 6).alias("score"))
