"""AG family: aggregates."""

from pyspark.sql import functions as F

from skein.functions.text import words
from skein.operators import aggregates as a
from skein.registry import query
from skein.session import table as t

SUM = "sum(value::DECIMAL(18,4))::DOUBLE"


@query("ag01_by_status", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def by_status(s, d):
    return t(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("ag02_cost_per_run", "SELECT l_orderkey, sum((l_extendedprice * 100)::BIGINT)::BIGINT AS micro FROM lineitem GROUP BY 1")
def per_run(s, d):
    return t(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.rint(F.col("l_extendedprice") * 100).cast("long")).alias("micro"))


@query("ag03_cost_per_month", f"SELECT user_id, date_trunc('month', ts)::DATE AS month, {SUM} AS cost FROM events GROUP BY ALL")
def per_month(s, d):
    return t(s, d, "events").groupBy("user_id", F.date_trunc("month", "ts").cast("date").alias("month")).agg(a.total("value").alias("cost"))


@query("ag04_per_provider", f"SELECT event_type, {SUM} AS cost, count(*) AS calls FROM events GROUP BY 1")
def per_provider(s, d):
    return t(s, d, "events").groupBy("event_type").agg(a.total("value").alias("cost"), F.count("*").alias("calls")).orderBy(F.col("cost").desc())


TYPES = ("click", "view", "purchase")


@query("ag05_cost_per_tenant_day", "SELECT n_name, ts::DATE AS day, count(*) AS calls, " + SUM + " AS cost, count(DISTINCT user_id) AS users, " + ", ".join(f"(sum(value::DECIMAL(18,4)) FILTER (WHERE event_type = '{x}'))::DOUBLE AS cost_{x}" for x in TYPES) + " FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def tenant_day(s, d):
    # facts shrink to (customer, day) before they meet names; customers of one nation then add up
    ev = t(s, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(
        F.count("*").alias("n"), F.sum(a.money("value")).alias("v"), *[F.sum(F.when(F.col("event_type") == x, a.money("value"))).alias(f"v_{x}") for x in TYPES]
    )
    df = ev.join(t(s, d, "customer").select("c_custkey", "c_nationkey"), F.col("user_id") == F.col("c_custkey")).join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return df.groupBy("n_name", "day").agg(
        F.sum("n").alias("calls"), F.sum("v").cast("double").alias("cost"), F.count("*").alias("users"), *[F.sum(f"v_{x}").cast("double").alias(f"cost_{x}") for x in TYPES]
    )


@query("ag06_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT ts::DATE) AS days FROM events GROUP BY 1")
def distinct(s, d):
    return t(s, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.col("ts").cast("date")).alias("days"))


@query("ag07_guarded_ratio", "SELECT user_id, round(count(*) FILTER (WHERE event_type = 'purchase') / nullif(count(*) FILTER (WHERE event_type = 'view'), 0)::DOUBLE, 6) AS rate FROM events GROUP BY 1")
def guarded(s, d):
    return t(s, d, "events").groupBy("user_id").agg(F.round(a.ratio(F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "view")), 6).alias("rate"))


@query("ag08_daily_trend", f"SELECT ts::DATE AS day, event_type, count(*) AS n, {SUM} AS cost FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY GROUP BY ALL")
def trend(s, d):
    recent = t(s, d, "events").filter("ts >= TIMESTAMP_NTZ '2024-01-31 00:00:00' - INTERVAL '30' DAY")
    return recent.groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.count("*").alias("n"), a.total("value").alias("cost"))


@query("ag09_case_counts", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed FROM orders GROUP BY 1")
def case_counts(s, d):
    return t(s, d, "orders").groupBy("o_orderpriority").agg(*[F.count_if(F.col("o_orderstatus") == k).alias(n) for k, n in (("F", "done"), ("O", "open"), ("P", "failed"))])


@query("ag10_summary", "SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, sum(value::DECIMAL(18,4))::DOUBLE / count(*) AS mean FROM events WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1")
def summary(s, d):
    recent = t(s, d, "events").filter("ts >= TIMESTAMP_NTZ '2024-01-24 00:00:00'")
    return recent.groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), a.mean("value").alias("mean"))


@query("ag11_having", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS open FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderstatus = 'O') < 3")
def having(s, d):
    return t(s, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("open")).filter("open < 3")


@query("ag12_queue_depth", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS waiting, min(o_orderdate) FILTER (WHERE o_orderstatus = 'O') AS oldest FROM orders GROUP BY 1")
def depth(s, d):
    return t(s, d, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "O").alias("waiting"), F.min(F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate"))).alias("oldest"))


@query("ag13_high_water", "SELECT user_id, max(ts) AS high FROM events WHERE event_type = 'purchase' GROUP BY 1")
def high_water(s, d):
    return t(s, d, "events").filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("high"))


@query("ag14_lag", "SELECT event_type, count(*) AS n, sum(epoch(TIMESTAMP '2024-02-01 00:00:00')::BIGINT - floor(epoch(ts))::BIGINT)::DOUBLE / count(*) AS mean, max(epoch(TIMESTAMP '2024-02-01 00:00:00')::BIGINT - floor(epoch(ts))::BIGINT)::BIGINT AS most FROM events GROUP BY 1")
def lag(s, d):
    age = F.unix_timestamp(F.lit("2024-02-01 00:00:00")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return t(s, d, "events").withColumn("age", age).groupBy("event_type").agg(F.count("*").alias("n"), a.mean("age").alias("mean"), F.max("age").alias("most"))


@query("ag15_monthly_summary", f"SELECT date_trunc('month', ts)::DATE AS month, event_type, count(*) AS calls, {SUM} AS cost, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def monthly(s, d):
    return t(s, d, "events").groupBy(F.date_trunc("month", "ts").cast("date").alias("month"), "event_type").agg(F.count("*").alias("calls"), a.total("value").alias("cost"), F.count_distinct("user_id").alias("users"))


@query("ag16_collect", "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS supps FROM lineitem GROUP BY 1")
def collect(s, d):
    return t(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_set("l_suppkey")), lambda x: x.cast("string")), ",").alias("supps"))


@query("ag19_type_token", "WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS w FROM documents) SELECT doc_id, round(len(list_distinct(w)) / len(w)::DOUBLE, 6) AS ttr FROM w WHERE len(w) > 0")
def type_token(s, d):
    df = t(s, d, "documents").select("doc_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    return df.select("doc_id", F.round(F.size(F.array_distinct("w")) / F.size("w"), 6).alias("ttr"))


@query("ag20_duplicate_names", "SELECT lower(p_name) AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicates(s, d):
    return t(s, d, "part").groupBy(F.lower("p_name").alias("name")).agg(F.count("*").alias("n")).filter("n > 1")


@query("ag21_speakers", "SELECT conv_id, count(DISTINCT role) AS speakers FROM conversations GROUP BY 1")
def speakers(s, d):
    nested = t(s, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return nested.select("conv_id", F.size("roles").cast("long").alias("speakers"))


@query("ag22_cost_columns", "SELECT l_orderkey, l_linenumber, l_partkey, ((l_quantity + l_discount + l_tax) * 100)::DECIMAL(18,0)::BIGINT AS cost FROM lineitem")
def cost_columns(s, d):
    parts = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("l_quantity", "l_discount", "l_tax")]
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.rint((parts[0] + parts[1] + parts[2]) * 100).cast("long").alias("cost"))


@query("ag23_null_skipping", "SELECT user_id, sum(CASE WHEN event_type <> 'view' THEN value::DECIMAL(18,4) END)::DOUBLE AS total FROM events GROUP BY 1")
def null_skipping(s, d):
    return t(s, d, "events").groupBy("user_id").agg(a.total_if("value", F.col("event_type") != "view").alias("total"))


@query("ag24_month_to_date", "SELECT c_custkey, coalesce(sum(value::DECIMAL(18,4)), 0)::DOUBLE AS spent FROM customer LEFT JOIN events ON user_id = c_custkey AND ts >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1")
def month_to_date(s, d):
    spent = t(s, d, "events").filter("ts >= TIMESTAMP_NTZ '2024-01-15 00:00:00'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.sum(a.money("value")).alias("v"))
    return t(s, d, "customer").join(spent, "c_custkey", "left").select("c_custkey", F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("spent"))


@query("ag25_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1")
def percentiles(s, d):
    out = t(s, d, "events").groupBy("event_type").agg(*a.percentiles("value", 0.5, 0.95))
    return out.select("event_type", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"))


@query("ag26_consistency", "SELECT label, round(stddev_pop(embedding[1]::DOUBLE), 6) AS spread FROM embeddings GROUP BY 1")
def consistency(s, d):
    return t(s, d, "embeddings").groupBy("label").agg(F.round(F.stddev_pop(F.get("embedding", F.lit(0)).cast("double")), 6).alias("spread"))


@query("ag27_histogram", "SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n FROM events, (VALUES (1.0::DOUBLE), (5.0), (10.0), (30.0), (60.0), (120.0)) b(le) GROUP BY ALL")
def histogram(s, d):
    return a.histogram(t(s, d, "events"), "value", [1, 5, 10, 30, 60, 120], "event_type")


@query("ag28_counters", "SELECT event_type, user_id % 10 AS label, count(*) AS n FROM events GROUP BY ALL")
def counters(s, d):
    return t(s, d, "events").groupBy("event_type", (F.col("user_id") % 10).alias("label")).agg(F.count("*").alias("n"))


@query("ag29_co_occurrence", "WITH e AS (SELECT DISTINCT o_custkey AS c, o_orderpriority AS p FROM orders) SELECT x.p AS a, y.p AS b, count(*) AS n FROM e x JOIN e y USING (c) WHERE x.p < y.p GROUP BY ALL")
def co_occurrence(s, d):
    # pairs within a customer's few priorities, not a join of orders with orders
    sets = t(s, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("p"))
    pairs = sets.select(F.posexplode("p").alias("i", "a"), "p").select("a", F.explode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


@query("ag30_by_json", "SELECT (props->>'k')::BIGINT % 7 AS k, count(*) AS n, sum((props->>'k')::DECIMAL(18,4))::DOUBLE / count(*) AS mean FROM events GROUP BY 1")
def by_json(s, d):
    k = F.variant_get(F.parse_json("props"), "$.k", "long")
    return t(s, d, "events").select(k.alias("v"), (k % 7).alias("k")).groupBy("k").agg(F.count("*").alias("n"), a.mean("v").alias("mean"))


@query("ag31_deployments", "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS rollbacks FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY GROUP BY 1")
def deployments(s, d):
    recent = t(s, d, "events").filter("ts >= TIMESTAMP_NTZ '2024-01-31 00:00:00' - INTERVAL '30' DAY")
    return recent.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("rollbacks"))


@query("ag32_explain_counts", "SELECT l_partkey, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_suppkey) AS supps, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1")
def explain_counts(s, d):
    return t(s, d, "lineitem").groupBy("l_partkey").agg(*[F.count_distinct(c).alias(n) for c, n in (("l_orderkey", "orders"), ("l_suppkey", "supps"), ("l_returnflag", "flags"))])


@query("ag33_crawl_summary", "SELECT count(*) AS videos, count(*) FILTER (WHERE contains(html, '<article>')) AS with_text, count(*) FILTER (WHERE NOT contains(html, '<article>')) AS without_text FROM pages")
def crawl_summary(s, d):
    has = F.contains("html", F.lit("<article>"))
    return t(s, d, "pages").agg(F.count("*").alias("videos"), F.count_if(has).alias("with_text"), F.count_if(~has).alias("without_text"))


@query("rt16_budget", """WITH s AS (SELECT user_id, user_id % 10 AS team, sum(value::DECIMAL(18,4))::DOUBLE AS spent FROM events GROUP BY ALL), g AS (SELECT team, sum(spent::DECIMAL(18,4))::DOUBLE AS spent FROM s GROUP BY 1),
p AS (SELECT user_id, spent * 100 / 500 AS share FROM s UNION ALL SELECT user_id, g.spent * 100 / 40000 FROM s JOIN g USING (team))
SELECT user_id, CASE WHEN max(share) >= 100 THEN 'block' WHEN max(share) >= 90 THEN 'throttle' WHEN max(share) >= 70 THEN 'warn' ELSE 'allow' END AS action FROM p GROUP BY 1""")
def budget(s, d):
    """Two scopes, user and team: the stricter action holds."""
    own = t(s, d, "events").groupBy("user_id").agg(a.total("value").alias("spent")).withColumn("team", F.col("user_id") % 10)
    team = own.groupBy("team").agg(a.total("spent").alias("of_team"))
    return own.join(team, "team").select("user_id", a.strictest(a.budget_action(F.col("spent"), F.lit(500)), a.budget_action(F.col("of_team"), F.lit(40_000))).alias("action"))
