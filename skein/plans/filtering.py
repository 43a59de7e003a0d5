"""FLT and ST, TK, WN families: filters, sets, queues, windows."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators import filters as f
from skein.operators import ordering as o
from skein.registry import query
from skein.session import table as t

ORDER = "o_orderkey, o_custkey, o_orderstatus, o_orderpriority"


@query("flt01_live", "SELECT c_custkey, c_name FROM customer WHERE NOT coalesce(c_acctbal < 0, false)")
def live(s, d):
    df = t(s, d, "customer").withColumn("is_deleted", F.col("c_acctbal") < 0)
    return f.live(df).select("c_custkey", "c_name")


@query("flt02_optional", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def optional(s, d):
    return f.optional(t(s, d, "customer"), c_mktsegment="BUILDING", c_nationkey=3, c_name=None).select("c_custkey", "c_mktsegment")


@query("flt03_equality", f"SELECT {ORDER} FROM orders WHERE o_orderstatus = 'F'")
def equality(s, d):
    return f.optional(t(s, d, "orders"), o_orderstatus="F").selectExpr(*ORDER.split(", "))


@query("flt04_boolean", "SELECT doc_id, quality FROM labels WHERE toxic = 1")
def boolean(s, d):
    return t(s, d, "labels").filter(F.col("toxic").cast("boolean")).select("doc_id", "quality")


@query("flt05_since", "SELECT event_id, user_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def since(s, d):
    df = t(s, d, "events")
    return df.filter(F.col("ts") > F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")).select("event_id", "user_id", "event_type")


@query("flt06_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def exists(s, d):
    return f.exists(t(s, d, "customer").select("c_custkey"), t(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("flt07_any", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = ANY (['1-URGENT', '2-HIGH'])")
def any_of(s, d):
    return t(s, d, "orders").filter(f.any_of("o_orderpriority", ["1-URGENT", "2-HIGH"])).select("o_orderkey", "o_orderpriority")


@query("flt08_prefix", "SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'STANDARD')")
def prefix(s, d):
    return t(s, d, "part").filter(F.startswith("p_type", F.lit("STANDARD"))).select("p_partkey", "p_type")


@query("flt09_contains", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 're') OR contains(lower(p_brand), 're')")
def contains(s, d):
    return t(s, d, "part").filter(f.contains_text(["p_name", "p_brand"], "RE")).select("p_partkey", "p_name")


@query("flt10_short_form", "SELECT page_id FROM pages WHERE NOT (contains(url, '/en/') OR coalesce(page_id % 7 < page_id % 3, false) OR coalesce(length(html) < 1500, false))")
def short_form(s, d):
    shorts = F.replace("url", F.lit("/en/"), F.lit("/shorts/"))
    hidden = f.short_form(shorts, F.col("page_id") % 7, F.col("page_id") % 3, F.length("html") / 50)
    return t(s, d, "pages").filter(~hidden).select("page_id")


@query("flt11_json_path", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events WHERE props->>'k' = '7'")
def json_path(s, d):
    return t(s, d, "events").filter(F.get_json_object("props", "$.k") == "7").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("flt12_array_contains", "WITH a AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY 1) SELECT l_orderkey FROM a WHERE list_contains(supps, 3)")
def array_holds(s, d):
    return t(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("supps")).filter(F.array_contains("supps", 3)).select("l_orderkey")


@query("flt13_stuck", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'P') AND o_orderdate < TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 4 HOUR")
def stuck(s, d):
    return f.stuck(t(s, d, "orders"), "o_orderstatus", ["F", "P"], "o_orderdate", "2000-01-01 00:00:00").select("o_orderkey")


@query("flt14_stale", "SELECT event_id FROM events WHERE event_type IN ('click', 'view', 'purchase') AND ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 60 MINUTE")
def stale(s, d):
    return f.stale(t(s, d, "events"), "event_type", ["click", "view", "purchase"], "ts", "2024-01-15 00:00:00", 60).select("event_id")


@query("flt15_partial", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 150000")
def partial(s, d):
    return t(s, d, "orders").filter("o_orderstatus = 'O' AND o_totalprice > 150000").select("o_orderkey", "o_orderpriority")


@query("flt16_empty_date", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN strptime(strftime(ts, '%Y-%m-%d'), '%Y-%m-%d')::DATE END AS day FROM events")
def empty_date(s, d):
    stamp = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return t(s, d, "events").withColumn("c", stamp).select("event_id", F.when(F.col("c") != "", F.to_date("c")).alias("day"))


@query("flt17_violations", "SELECT l_orderkey, l_linenumber, l_partkey, 'discount' AS \"check\" FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 0.05) UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'flag' FROM lineitem WHERE NOT (l_returnflag IN ('A', 'N'))")
def violations(s, d):
    return f.violations(t(s, d, "lineitem"), discount="l_discount BETWEEN 0 AND 0.05", flag="l_returnflag IN ('A', 'N')").select("l_orderkey", "l_linenumber", "l_partkey", "check")


@query("flt19_known_types", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')")
def known(s, d):
    return t(s, d, "events").filter(f.any_of("event_type", ["click", "view"])).select("event_id", "event_type")


@query("wn01_archive", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, rn FROM r WHERE rn > 5 AND l_shipdate < TIMESTAMP '2000-01-01 00:00:00'""")
def archive(s, d):
    tie = [F.col(c) for c in ("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")]
    out = o.archive_candidates(t(s, d, "lineitem"), "l_orderkey", F.col("l_linenumber"), "l_shipdate", "2000-01-01 00:00:00", tie=tie)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.col("rn").cast("long").alias("rn"))


@query("wn02_latest", "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest(s, d):
    return t(s, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("wn03_history", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations")
def history(s, d):
    return o.latest(t(s, d, "conversations"), ["conv_id"], F.col("turn").desc(), rank="place", keep=1 << 30).select("conv_id", "turn", F.col("place").cast("long").alias("place"))


WEEK = "OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW)"


@query("wn04_trailing_week", f"SELECT event_id, (sum(value::DECIMAL(18,4)) {WEEK})::DOUBLE AS week_sum, count(*) {WEEK} AS week_n FROM events")
def week(s, d):
    df = t(s, d, "events").withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
    out = o.trailing(df, ["event_type"], "event_id", "micros", 604_800_000_000, F.col("value").cast("decimal(18,4)"), 86_400_000_000)
    return out.select("event_id", F.col("total").cast("double").alias("week_sum"), F.col("n").alias("week_n"))


@query("wn08_retry_schedule", "SELECT attempt, wait, sum(wait) OVER (ORDER BY attempt)::BIGINT AS elapsed FROM (VALUES (1::BIGINT, 60::BIGINT), (2, 300), (3, 900), (4, 3600), (5, 3600)) v(attempt, wait)")
def retries(s, d):

    df = s.createDataFrame([(i + 1, w) for i, w in enumerate(o.RETRY_SECONDS)], "attempt long, wait long")
    return df.withColumn("elapsed", F.sum("wait").over(W.orderBy("attempt")))


PRIO = "CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END"


@query("tk01_priority_queue", f"SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY {PRIO}, o_orderdate, o_orderkey LIMIT 100")
def priority_queue(s, d):
    weight = o.priority_weight(F.col("o_orderpriority"), {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3})
    return o.queue(t(s, d, "orders").filter("o_orderstatus = 'O'"), weight, F.col("o_orderdate"), F.col("o_orderkey"), limit=100).select("o_orderkey", "o_orderpriority")


@query("tk02_next_review", f"SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {PRIO}, o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def next_review(s, d):
    weight = o.priority_weight(F.col("o_orderpriority"), {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3})
    return o.latest(t(s, d, "orders"), ["o_orderstatus"], weight, F.col("o_orderdate"), F.col("o_orderkey")).select("o_orderstatus", "o_orderkey")


@query("tk03_reviewer", """WITH w AS (SELECT c_nationkey, c_custkey, count(o_orderkey) AS load, max(o_orderdate) AS last, c_acctbal FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_nationkey, c_custkey, load FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY load, c_acctbal DESC, last NULLS FIRST, c_custkey) AS rn FROM w) WHERE rn = 1""")
def reviewer(s, d):
    load = t(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("load"), F.max("o_orderdate").alias("last"))
    df = t(s, d, "customer").join(load, "c_custkey", "left").withColumn("load", F.coalesce("load", F.lit(0)).cast("long"))
    return o.latest(df, ["c_nationkey"], F.col("load"), F.col("c_acctbal").desc(), F.col("last").asc_nulls_first(), F.col("c_custkey")).select("c_nationkey", "c_custkey", "load")


@query("tk04_page", """SELECT c_custkey, n::BIGINT AS "totalItems", ceil(n / 20.0)::BIGINT AS "totalPages", 3 < ceil(n / 20.0) AS "hasNext", true AS "hasPrev" FROM customer, (SELECT count(*) AS n FROM customer) ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40""")
def page(s, d):
    out = o.page(t(s, d, "customer"), 3, 20, F.col("c_name"), F.col("c_custkey"))
    return out.select("c_custkey", F.col("totalItems").cast("long").alias("totalItems"), F.col("totalPages").cast("long").alias("totalPages"), "hasNext", "hasPrev")


@query("tk05_slice", "SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS rn FROM part) WHERE rn BETWEEN 51 AND 75")
def slice_(s, d):
    return t(s, d, "part").orderBy("p_name", "p_partkey").offset(50).limit(25).select("p_partkey")


@query("tk06_outbox", "SELECT event_id FROM events WHERE event_type = 'view' ORDER BY ts, event_id LIMIT 100")
def outbox(s, d):
    return t(s, d, "events").filter("event_type = 'view'").orderBy("ts", "event_id").limit(100).select("event_id")


@query("tk07_caps", "SELECT o_custkey, array_to_string(list_slice(list(o_orderkey ORDER BY o_orderdate, o_orderkey), 1, 20), ',') AS warnings, array_to_string(list_slice(list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey), 1, 10), ',') AS issues, count(*) AS n FROM orders GROUP BY 1")
def caps(s, d):
    """The first 20 by date, the first 10 by price; all are counted."""
    per = W.partitionBy("o_custkey")
    ranked = t(s, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(per.orderBy("o_orderdate", "o_orderkey")).alias("i"), F.row_number().over(per.orderBy(F.col("o_totalprice").desc(), "o_orderkey")).alias("j"))
    keep = lambda c, most: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c) <= most, F.struct(c, "o_orderkey")))), lambda v: v["o_orderkey"].cast("string")), ",")
    return ranked.groupBy("o_custkey").agg(keep("i", 20).alias("warnings"), keep("j", 10).alias("issues"), F.count("*").alias("n"))


@query("tk08_first_n", "SELECT conv_id, turn FROM conversations WHERE turn < 2")
def first_n(s, d):
    return o.latest(t(s, d, "conversations"), ["conv_id"], F.col("turn"), keep=2).select("conv_id", "turn")


@query("tk09_merge_hits", "SELECT kind, id FROM (SELECT 'c' AS kind, c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN abs(c_acctbal) / 10000 END AS distance FROM customer UNION ALL SELECT 's', s_suppkey, abs(s_acctbal) / 10000 FROM supplier) ORDER BY coalesce(distance, 1.0), kind, id LIMIT 30")
def hits(s, d):
    c = t(s, d, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 > 0, F.abs("c_acctbal") / 10000).alias("distance"))
    p = t(s, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), (F.abs("s_acctbal") / 10000).alias("distance"))
    return o.merge_hits([c, p], "distance", 30, F.col("kind"), F.col("id")).select("kind", "id")


@query("tk10_breaches", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00'")
def breaches(s, d):
    return t(s, d, "orders").filter("o_orderstatus = 'O' AND o_orderdate < TIMESTAMP_NTZ '1996-01-01 00:00:00'").orderBy("o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@query("st01_union", "SELECT l_suppkey AS a, l_partkey AS b FROM lineitem UNION SELECT l_partkey, l_suppkey FROM lineitem")
def union(s, d):
    df = t(s, d, "lineitem")
    return df.select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).union(df.select("l_partkey", "l_suppkey")).distinct()


@query("st02_union_all", "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier")
def union_all(s, d):
    return t(s, d, "customer").select(F.col("c_name").alias("name")).unionByName(t(s, d, "supplier").select(F.col("s_name").alias("name")))


@query("st04_insert_absent", "SELECT user_id, min(event_id) AS event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY user_id")
def insert_absent(s, d):
    held = t(s, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return o.insert_absent(held, t(s, d, "events").select("user_id", "event_id"), ["user_id"], F.col("event_id")).select("user_id", "event_id")


@query("st05_distinct", "SELECT DISTINCT p_brand, p_size FROM part")
def distinct(s, d):
    return t(s, d, "part").select("p_brand", "p_size").distinct()
