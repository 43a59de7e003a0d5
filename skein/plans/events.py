"""SS family: the streaming jobs' logic on the events table."""

from pyspark.sql import functions as F

from skein.plans.states import RUN, requests_of
from skein.registry import query
from skein.session import table as t
from skein.sources import topics
from skein.storage import scratch
from skein.streaming import jobs, keyed, sinks


@query("ss02_idempotent", "SELECT DISTINCT event_id, user_id FROM (SELECT * FROM events UNION ALL SELECT * FROM events)")
def idempotent(s, d):
    e = t(s, d, "events")
    return jobs.dedup(e.unionByName(e)).select("event_id", "user_id")


@query("ss05_dead_letters", "SELECT event_id, event_type IN ('click', 'view') AND value IS NOT NULL AS good, CASE WHEN NOT (event_type IN ('click', 'view') AND value IS NOT NULL) THEN 'failed: event_type IN (''click'', ''view'') AND value IS NOT NULL' END AS reason FROM events")
def dead(s, d):
    """The rows that pass, and the dead letters with their reason."""
    good, bad = jobs.good_or_dead(t(s, d, "events"), "event_type IN ('click', 'view') AND value IS NOT NULL")
    return good.select("event_id", F.lit(True).alias("good"), F.lit(None).cast("string").alias("reason")).unionByName(bad.select("event_id", F.lit(False).alias("good"), "reason"))


@query("ss01_consume", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def consume(s, d):
    """Two deliveries of each event: at least once in, once in effect."""
    e = t(s, d, "events")
    return jobs.dedup(e.unionByName(e)).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("ss06_order", "SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS ids FROM events GROUP BY 1")
def order(s, d):
    """What a consumer sees of each key, in order."""
    e = t(s, d, "events").select("user_id", "ts", "event_id")
    rows = jobs.in_order(e, "user_id", "ts", "event_id")
    return rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("l")).select("user_id", F.array_join(F.transform("l", lambda v: v["event_id"].cast("string")), ",").alias("ids"))


WINDOWS = """w AS (SELECT time_bucket(INTERVAL '{slide}', ts) - INTERVAL '{slide}' * i AS start, event_type, value FROM events, range(0, {n}) r(i)),
g AS (SELECT start, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS failures, sum(value::DECIMAL(18,4))::DOUBLE AS total, quantile_disc(value, 0.95) AS p95 FROM w GROUP BY 1)"""


@query("ss07_failure_rate", "WITH " + WINDOWS.format(slide="1 minute", n=5) + " SELECT start, events, failures, failures / events AS rate, total, p95, concat_ws(',', CASE WHEN failures / events > 0.2 THEN 'failure_rate' END, CASE WHEN total / 300 * 0.000075 > 1 THEN 'cost_rate' END, CASE WHEN p95 > 30 THEN 'duration' END) AS alerts FROM g")
def failure_rate(s, d):
    """Steps over five minutes, sliding by one."""
    return jobs.alerts(jobs.rates(t(s, d, "events"))).select("start", "events", "failures", "rate", "total", "p95", F.array_join("alerts", ",").alias("alerts"))


@query("ss07_job_failures", "WITH " + WINDOWS.format(slide="5 minutes", n=3) + " SELECT start, failures / events AS rate, failures / events > 0.1 AS alert FROM g")
def job_failures(s, d):
    """Jobs over fifteen minutes, sliding by five."""
    return jobs.alerts(jobs.rates(t(s, d, "events"), span="15 minutes", slide="5 minutes"), jobs=True).select("start", "rate", F.array_contains("alerts", "failure_rate").alias("alert"))


@query("ss07_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) FILTER (WHERE event_type = 'error') / count(*) AS rate FROM events GROUP BY 1")
def tumbling(s, d):
    return jobs.rates(t(s, d, "events"), span="1 hour", slide="1 hour").select("start", "events", "failures", "rate")


@query("ss08_sliding", "WITH " + WINDOWS.format(slide="15 minutes", n=4) + " SELECT start, events, failures / events AS rate, failures / events > 0.10 AS alert FROM g")
def sliding(s, d):
    """The share of bad calls in any hour, by quarters."""
    out = jobs.rates(t(s, d, "events"), span="1 hour", slide="15 minutes")
    return out.select("start", "events", "rate", (F.col("rate") > jobs.HOUR_SHARE).alias("alert"))


@query("ss08_rolling_week", """WITH d AS (SELECT event_type, ts::DATE AS day, sum(value::DECIMAL(18,4))::DOUBLE / count(*) AS score FROM events GROUP BY ALL), w AS (SELECT *, avg(score) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS week FROM d)
SELECT event_type, day, round(score, 6) AS score, round(week, 6) AS week, coalesce(score < 0.95 * week, false) AS dropped FROM w""")
def rolling_week(s, d):
    """Each day's mean against the mean of the seven days before."""
    days = t(s, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg((F.sum(F.col("value").cast("decimal(18,4)")).cast("double") / F.count("*")).alias("score"))
    return jobs.rolling_week(days, "event_type", "day", "score").select("event_type", "day", F.round("score", 6).alias("score"), F.round("week", 6).alias("week"), "dropped")


@query("ss03_retention", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY")
def retention(s, d):
    """Ids that are still remembered: those of the last thirty days, the others are purged."""
    e = t(s, d, "events").select("event_id", "ts")
    return e.join(F.broadcast(e.agg(F.max("ts").alias("_last")))).filter("ts >= _last - INTERVAL '30' DAY").select("event_id")


@query("ss12_replay", "SELECT event_id FROM events WHERE event_type = 'error' AND event_id NOT IN (SELECT event_id FROM events WHERE event_id % 2 = 0)")
def replay(s, d):
    e = t(s, d, "events")
    return jobs.replay(e.filter("event_type = 'error'"), e.filter("event_id % 2 = 0")).select("event_id")


@query("ss_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, k")
def sessions(s, d):
    return jobs.sessions(t(s, d, "events")).select("user_id", "start", "events")


@query("ss10_keyed_stream", RUN + "SELECT event_id, state, retries, ok FROM f JOIN s ON s.i = f.i WHERE event_id IS NOT NULL")
def keyed_stream(s, d):
    """The state machine of all events as a stream: batches that hold every fourth event of a time, so that each is late by the next one's rows."""
    rows = requests_of(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    edges = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    folder = scratch(s, "requests")
    span = F.unix_micros(F.lit(edges["b"])) - F.unix_micros(F.lit(edges["a"])) + 1
    block = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(edges["a"]))) * 4 / span)
    for b in range(4):
        # what is odd of a quarter comes with the next one
        rows.filter((block + F.pmod("event_id", F.lit(2)) == b) | ((block == 3) & (F.lit(b) == 3))).write.parquet(f"{folder}/in/b{b}")
    last = rows.limit(1).select(F.lit(-1).cast(rows.schema["user_id"].dataType).alias("user_id"), F.lit(-1).cast("long").alias("event_id"), F.lit(edges["b"] + (edges["b"] - edges["a"])).alias("ts"), F.lit("QUEUED").alias("new"))
    last.write.parquet(f"{folder}/in/b4")
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1_000_000).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    late = f"{(edges['b'] - edges['a']).total_seconds() / 2 + 60:.0f} seconds"
    out = keyed.run_stream(stream, "user_id", late)
    out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return s.read.schema(out.schema).parquet(f"{folder}/out").filter("kind = 'move' AND user_id >= 0").select("event_id", "state", "retries", "ok")


@query("ss10_stuck", RUN + """, g AS (SELECT f.user_id, epoch_us(ts) AS us, f.event_id, f.i FROM f JOIN events USING (event_id) WHERE ok),
l AS (SELECT *, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS gone, min(CASE WHEN i > 1 THEN us END) OVER (PARTITION BY user_id) AS started FROM g),
w AS (SELECT *, greatest(us, started + 3600000000) AS due FROM l JOIN s USING (i) WHERE state LIKE '%ING')
SELECT user_id, due // 1000 AS ms, state FROM w WHERE (gone IS NULL OR (gone + 999) // 1000 > due // 1000 + 1) AND (due // 1000 + 1) * 1000 <= (SELECT max(epoch_us(ts)) FROM events)""")
def stuck(s, d):
    """Videos at work for over sixty minutes, from their moves."""
    from skein.operators import routing

    rows = requests_of(s, d)
    upto = rows.agg(F.max("ts")).first()[0]
    found = keyed.stuck(routing.run_moves(rows, "user_id", "ts", "event_id"), "user_id", F.lit(upto).cast("timestamp"))
    return found.select("user_id", F.floor(F.unix_micros("ts") / 1000).alias("ms"), "state")


PARTED = "CAST('0x' || substr(md5(user_id::VARCHAR), 1, 8) AS BIGINT) % 3"


def events_log(s, d):
    """The events as a topic of three partitions, in order of time within each: its path."""
    topics.register(s)
    folder = scratch(s, "topics")
    e = t(s, d, "events").select(F.col("user_id").cast("string").alias("video_id"), "event_id", "event_type", F.col("ts").cast("timestamp").alias("time"), F.col("event_id").alias("_e"))
    rows = jobs.records(e, beside=("time", "_e"))
    part = topics.partition_column(F.col("key"), F.col("value"))
    dealt = rows.withColumn("_p", part).repartition(topics.PARTITIONS, "_p").sortWithinPartitions("_p", "time", "_e")
    dealt.select("time", "key", "value").write.format("topic_log").options(path=folder, topic="events").mode("append").save()
    return folder


@query("src03_topic_log", f"SELECT ({PARTED})::INT AS partition, row_number() OVER (PARTITION BY {PARTED} ORDER BY ts, event_id) - 1 AS \"offset\", user_id::VARCHAR AS key, event_id, event_type FROM events")
def topic_log(s, d):
    """All events through a topic: written under their key, read back with partition and offset."""
    rows = s.read.format("topic_log").options(path=events_log(s, d), topics="events").load()
    value = F.from_json("value", "event_id long, event_type string")
    return rows.select("partition", "offset", "key", value["event_id"].alias("event_id"), value["event_type"].alias("event_type"))


@query("ss09_group_lag", f"""WITH p AS (SELECT ({PARTED})::INT AS partition, epoch_us(ts) AS us, row_number() OVER (PARTITION BY {PARTED} ORDER BY ts, event_id) - 1 AS o FROM events),
n AS (SELECT partition, count(*) AS n, count(*) * partition // 3 AS done FROM p GROUP BY 1), l AS (SELECT partition, n - done AS lag, (SELECT (max(us) - min(us)) / 1e6 FROM p WHERE p.partition = n.partition AND o >= done) AS behind FROM n)
SELECT partition, lag, coalesce(behind, 0) AS behind_seconds, CASE WHEN lag > 5000 THEN 'critical' WHEN lag > 1000 OR behind > 60 THEN 'warning' ELSE 'ok' END AS alert FROM l""")
def group_lag(s, d):
    """How far a group is behind that has read nothing of the first partition, a third of the second, two of the third."""
    path = events_log(s, d)
    log = topics.Log(path)
    ends = log.ends(["events"])
    log.commit_group("reader", {name: end * int(name.rsplit("/", 1)[1]) // 3 for name, end in ends.items()})
    return jobs.lag(topics.group_lag(s, path, ["events"], "reader"), None).select("partition", "lag", "behind_seconds", "alert")


@query("ss05_once", "SELECT event_id, NOT coalesce(event_type IN ('click', 'view'), false) AS dead, 1::BIGINT AS times FROM events")
def once(s, d):
    """Good rows and dead letters of a batch that is delivered three times, twice of them whole."""
    e = t(s, d, "events").select("event_id", "event_type")
    sink = sinks.OnceSink(s, scratch(s, "once"))
    route = sinks.route_once(sink, "event_type IN ('click', 'view')")
    for _ in range(3):
        route(e, 0)
    kept = "event_id long, event_type string"
    both = sink.read("good", kept).select("event_id", F.lit(False).alias("dead")).unionByName(sink.read("dead", kept).select("event_id", F.lit(True).alias("dead")))
    return both.groupBy("event_id", "dead").agg(F.count("*").alias("times"))
