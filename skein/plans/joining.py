"""JN family: joins."""

from pyspark.sql import functions as F

from skein.operators.ordering import latest
from skein.operators.shared import shared_neighbours
from skein.registry import query
from skein.session import table as t


def dec(c):
    return F.col(c).cast("decimal(18,4)")


@query("jn01_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def inner(s, d):
    return t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("jn02_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey")
def left(s, d):
    return t(s, d, "customer").join(t(s, d, "orders").filter("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("jn03_latest", "SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM customer JOIN orders ON o_custkey = c_custkey) WHERE rn = 1")
def with_latest(s, d):
    both = t(s, d, "customer").join(t(s, d, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    return latest(both, ["c_custkey"], F.col("o_orderdate").desc(), F.col("o_orderkey")).select("c_custkey", "o_orderkey")


@query("jn04_two_left", """SELECT c_custkey, count(DISTINCT o_orderkey) AS orders, count(e.event_id) AS events FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN events e ON e.user_id = c_custkey GROUP BY c_custkey""")
def two_left(s, d):
    # events meet as counts, so that neither join multiplies rows
    ev = t(s, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("events"))
    od = t(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("orders", F.lit(1).cast("long"))
    df = t(s, d, "customer").select("c_custkey").join(od, "c_custkey", "left").join(ev, "c_custkey", "left")
    return df.select("c_custkey", F.coalesce("orders", F.lit(0)).cast("long").alias("orders"), F.coalesce("events", F.lit(0)).cast("long").alias("events"))


@query("jn05_tenant_cost", "SELECT n_name, count(*) AS calls, sum(value::DECIMAL(18,4))::DOUBLE AS cost FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def tenant_cost(s, d):
    # the fact table shrinks to its customers before it meets their names
    ev = t(s, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum(dec("value")).alias("v"))
    df = ev.join(t(s, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return df.groupBy("n_name").agg(F.sum("n").alias("calls"), F.sum("v").cast("double").alias("cost"))


@query("jn06_three_keys", "SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, p.p_brand FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey AND p.p_size = l.l_linenumber AND p.p_brand = 'Brand#1'")
def three_keys(s, d):
    p = t(s, d, "part").filter("p_brand = 'Brand#1'").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("l_linenumber"), "p_brand")
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(p, ["l_partkey", "l_linenumber"], "left").select("l_orderkey", "l_linenumber", "l_partkey", "p_brand")


@query("jn07_chain", "SELECT r_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON p_partkey = l_partkey WHERE p_size < 10 GROUP BY r_name")
def chain(s, d):
    small = t(s, d, "part").filter("p_size < 10").select("p_partkey")
    df = t(s, d, "lineitem").join(small, F.col("l_partkey") == F.col("p_partkey")).join(t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    df = df.join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return df.groupBy("r_name").agg(F.count("*").alias("n"))


@query("jn08_pointer", "WITH cur AS (SELECT o_custkey, max(o_orderkey) AS current FROM orders GROUP BY 1) SELECT c_custkey, o.o_orderkey, o.o_orderstatus FROM cur JOIN customer ON c_custkey = cur.o_custkey JOIN orders o ON o.o_orderkey = cur.current AND o.o_custkey = cur.o_custkey")
def pointer(s, d):
    cur = t(s, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    df = cur.join(t(s, d, "orders"), ["o_orderkey", "o_custkey"]).join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return df.select("c_custkey", "o_orderkey", "o_orderstatus")


@query("jn09_residual", "SELECT l_orderkey, count(*) AS behind FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate < o_orderdate + INTERVAL 30 DAY GROUP BY l_orderkey")
def residual(s, d):
    df = t(s, d, "lineitem").join(t(s, d, "orders"), (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") < F.expr("o_orderdate + INTERVAL '30' DAY")))
    return df.groupBy("l_orderkey").agg(F.count("*").alias("behind"))


@query("jn10_many_to_many", "SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def many(s, d):
    return t(s, d, "orders").join(t(s, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()


@query("jn11_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def not_in(s, d):
    return t(s, d, "customer").join(t(s, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("jn12_discovered", "SELECT DISTINCT user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_acctbal >= 0)")
def discovered(s, d):
    held = t(s, d, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("user_id"))
    return t(s, d, "events").select("user_id").distinct().join(held, "user_id", "left_anti")


@query("jn13_orphans", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def orphans(s, d):
    return t(s, d, "lineitem").select("l_partkey").distinct().join(t(s, d, "part").filter("p_size > 25"), F.col("l_partkey") == F.col("p_partkey"), "left_anti")


@query("jn15_remap", "SELECT n_nationkey, coalesce(CASE n_nationkey WHEN 1 THEN 2 WHEN 5 THEN 7 END, n_nationkey)::BIGINT AS mapped FROM nation")
def remap(s, d):
    to = s.createDataFrame([(1, 2), (5, 7)], "n_nationkey int, new int")
    return t(s, d, "nation").join(F.broadcast(to), "n_nationkey", "left").select("n_nationkey", F.coalesce("new", "n_nationkey").cast("long").alias("mapped"))


@query("jn16_top_one", "SELECT s_suppkey, l.l_orderkey FROM supplier, LATERAL (SELECT l_orderkey FROM lineitem WHERE l_suppkey = s_suppkey ORDER BY l_extendedprice DESC, l_orderkey LIMIT 1) l")
def top_one(s, d):
    # the window keeps one row a supplier before the join
    best = t(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.min_by("l_orderkey", F.struct(-F.col("l_extendedprice"), "l_orderkey")).alias("l_orderkey"))
    return t(s, d, "supplier").join(best, "s_suppkey").select("s_suppkey", "l_orderkey")


@query("jn17_in", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def semi(s, d):
    return t(s, d, "lineitem").join(t(s, d, "orders").filter("o_orderstatus = 'P'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("jn19_shared_neighbours", """WITH e AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS p FROM lineitem)
SELECT x.a AS a, y.a AS b, count(*) AS shared FROM e x JOIN e y ON x.p = y.p AND x.a < y.a GROUP BY ALL""")
def shared(s, d):
    return shared_neighbours(t(s, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")))


@query("jn20_workload", "SELECT c_custkey, count(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS open FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey WHERE n_regionkey = 2 GROUP BY c_custkey HAVING count(o_orderkey) FILTER (WHERE o_orderstatus = 'O') < 5")
def workload(s, d):
    people = t(s, d, "customer").join(t(s, d, "nation").filter("n_regionkey = 2"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey")
    df = people.join(t(s, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return df.groupBy("c_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("open")).filter("open < 5")


@query("jn21_literal_json", "SELECT c_custkey, event_id FROM customer JOIN events ON user_id = c_custkey AND event_type = 'purchase' AND (props->>'k')::BIGINT > 50")
def literal_json(s, d):
    ev = t(s, d, "events").filter((F.col("event_type") == "purchase") & (F.get_json_object("props", "$.k").cast("long") > 50))
    return t(s, d, "customer").join(ev, F.col("user_id") == F.col("c_custkey")).select("c_custkey", "event_id")


@query("jn22_either_end", "SELECT n_nationkey, count(*) AS n FROM nation JOIN (SELECT DISTINCT c_nationkey, s_nationkey FROM customer, supplier WHERE c_custkey = s_suppkey) ON n_nationkey = c_nationkey OR n_nationkey = s_nationkey GROUP BY 1")
def either(s, d):
    pairs = t(s, d, "customer").join(t(s, d, "supplier"), F.col("c_custkey") == F.col("s_suppkey")).select("c_nationkey", "s_nationkey").distinct()
    # OR as two equi joins: the second leaves out what the first has
    first = pairs.select(F.col("c_nationkey").alias("n_nationkey"))
    second = pairs.filter("c_nationkey <> s_nationkey").select(F.col("s_nationkey").alias("n_nationkey"))
    return t(s, d, "nation").select("n_nationkey").join(first.unionByName(second), "n_nationkey").groupBy("n_nationkey").agg(F.count("*").alias("n"))


@query("jn18_all_match", """WITH r(policy, o_orderstatus, least) AS (VALUES ('a', 'O', 100000.0), ('b', 'F', 200000.0))
SELECT o_orderkey, policy, bool_and(m) AS matched FROM (SELECT o.o_orderkey, r.policy, unnest([o.o_orderstatus = r.o_orderstatus, o.o_totalprice >= r.least]) AS m FROM orders o, r) GROUP BY ALL""")
def all_match(s, d):
    rules = [("a", "o_orderstatus = 'O'"), ("a", "o_totalprice >= 100000"), ("b", "o_orderstatus = 'F'"), ("b", "o_totalprice >= 200000")]
    policies = sorted({p for p, _ in rules})
    each = F.array(*[F.struct(F.lit(p).alias("policy"), F.expr(" AND ".join(f"({r})" for q, r in rules if q == p)).alias("matched")) for p in policies])
    return t(s, d, "orders").select("o_orderkey", F.inline(each))
