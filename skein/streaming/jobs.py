"""Structured Streaming jobs over file or broker sources.

Each takes a streaming (or batch) frame of events and returns the transformed
one, so the same code runs on a backfill and on a stream.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.scalars import json_or_self


def file_source(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New parquet files of a folder, from the earliest on."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def broker_source(spark: SparkSession, servers: str, topics: list[str], schema: str, rate: int | None = None) -> DataFrame:
    """Topics from their earliest offset; null values are skipped, values that don't parse have null fields."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", "earliest")
    raw = (reader.option("maxOffsetsPerTrigger", rate) if rate else reader).load()
    value = F.from_json(F.col("value").cast("string"), schema)
    return raw.filter(F.col("value").isNotNull()).select("topic", "partition", "offset", F.col("timestamp").alias("received"), F.col("key").cast("string").alias("key"), value.alias("event"))


#: The fields that key a record, the first that is there.
KEYS = ("video_id", "pipeline_id")


def records(df: DataFrame, keys: tuple[str, ...] = KEYS, beside: tuple[str, ...] = ()) -> DataFrame:
    """Rows as (key, value) records: JSON under the video's id, else the run's; rows with neither have no key. Columns ``beside`` stay columns."""
    held = [F.col(k).cast("string") for k in keys if k in df.columns]
    return df.select((F.coalesce(*held) if held else F.lit(None).cast("string")).alias("key"), F.to_json(F.struct(*[c for c in df.columns if c not in beside])).alias("value"), *beside)


def broker_sink(df: DataFrame, servers: str, topic: str, checkpoint: str, keys: tuple[str, ...] = KEYS):
    """A writer of the records to a topic."""
    return records(df, keys).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)


def dedup(df: DataFrame, key: str = "event_id", time: str = "ts", keep: str = "30 days") -> DataFrame:
    """Each event id once within the retention; state is dropped behind the watermark."""
    return df.withWatermark(time, keep).dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])


def rates(df: DataFrame, time: str = "ts", span: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes", value: str = "value") -> DataFrame:
    """Events, failures, failure rate, the sum of ``value`` (tokens, seconds) and its 95th percentile in sliding windows."""
    df = df.withWatermark(time, late) if df.isStreaming else df
    out = df.groupBy(F.window(time, span, slide)).agg(
        F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("failures"),
        F.sum(F.col(value).cast("decimal(18,4)")).cast("double").alias("total"), F.percentile_approx(value, 0.95, 10_000).alias("p95"),
    )
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "events", "failures", (F.col("failures") / F.col("events")).alias("rate"), "total", "p95")


#: Price of a token, and the limits of alerts: failure rates of steps and jobs, cost of an hour, seconds of a call.
TOKEN_PRICE, STEP_FAILURES, JOB_FAILURES, HOURLY_COST, CALL_SECONDS = 0.000075, 0.2, 0.1, 1.0, 30.0


def alerts(windows: DataFrame, jobs: bool = False) -> DataFrame:
    """Add ``alerts``: which limits a window of ``rates`` passes."""
    seconds = F.unix_timestamp(F.col("end").cast("timestamp")) - F.unix_timestamp(F.col("start").cast("timestamp"))
    return windows.withColumn("alerts", F.array_compact(F.array(
        F.when(F.col("rate") > (JOB_FAILURES if jobs else STEP_FAILURES), "failure_rate"),
        F.when(F.col("total") / seconds * TOKEN_PRICE > HOURLY_COST, "cost_rate"),
        F.when(F.col("p95") > CALL_SECONDS, "duration"),
    )))


#: Share of hallucinations in an hour that raises an alert; drop against the rolling week that does.
HOUR_SHARE, WEEK_DROP = 0.10, 0.05


def rolling_week(days: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Add ``week`` (mean of the seven days before) and ``dropped`` (more than 5 % below it) to one row for each key and day."""
    at = F.datediff(F.col(day), F.lit("1970-01-01"))
    before = W.partitionBy(key).orderBy(at).rangeBetween(-7, -1)
    return days.withColumn("week", F.avg(value).over(before)).withColumn("dropped", F.coalesce(F.col(value) < (1 - WEEK_DROP) * F.col("week"), F.lit(False)))


def in_order(df: DataFrame, key: str, *order: str, partitions: int | None = None) -> DataFrame:
    """Rows of one key in one partition, in order there: what a consumer of a keyed topic sees. Keys are dealt by their hash, as a broker does."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key).sortWithinPartitions(key, *order)


def since_high_water(found: DataFrame, known: DataFrame, key: str, time: str, mark_only: bool = False) -> DataFrame:
    """Rows to fetch: those whose key isn't known; with ``mark_only`` those after the latest known time instead.

    The mark alone misses rows that arrive late, so the keys decide by default
    and the mark is reported by ``high_water``.
    """
    if mark_only:
        mark = known.agg(F.max(time).alias("_mark"))
        return found.join(F.broadcast(mark)).filter(F.col("_mark").isNull() | (F.col(time) > F.col("_mark"))).drop("_mark")
    return found.join(known.select(key), key, "left_anti")


def high_water(known: DataFrame, time: str) -> DataFrame:
    return known.agg(F.max(time).alias("high_water"), F.count("*").alias("known"))


def sessions(df: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    df = df.withWatermark(time, late) if df.isStreaming else df
    out = df.groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("events"))
    return out.select(key, F.col("session_window.start").alias("start"), "events")


def decode(df: DataFrame, nested: str, record: str) -> DataFrame:
    """The nested JSON payload as a variant, or the record where it doesn't parse."""
    return df.withColumn("payload", json_or_self(F.col(nested), F.col(record)))


def good_or_dead(df: DataFrame, valid: str) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the condition, and all others (unknown too) as dead letters with the reason."""
    marked = df.withColumn("_ok", F.coalesce(F.expr(valid), F.lit(False)))
    return marked.filter("_ok").drop("_ok"), marked.filter("NOT _ok").drop("_ok").withColumn("reason", F.lit(f"failed: {valid}"))


def split_bad(valid: str, good: Callable[[DataFrame], None], dead: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows that meet the condition go one way, all others (unknown too) to the dead letters."""

    def route(batch: DataFrame, number: int) -> None:
        batch.persist()
        fine, bad = good_or_dead(batch, valid)
        good(fine)
        dead(bad.withColumn("batch", F.lit(number)))
        batch.unpersist()

    return route


def consume(source: DataFrame, handle: Callable[[DataFrame], None], checkpoint: str, key: str = "event_id", time: str = "ts"):
    """Run a stream to the end of what is there, each event handled at least once and, by its id, once in effect."""

    def batch(df: DataFrame, number: int) -> None:
        handle(df)

    return dedup(source, key, time).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state_machine(requests: DataFrame, key: str, moves: dict[str, tuple[str, ...]], max_retries: int = 3) -> DataFrame:
    """The stateful form of the state machine on a stream: (key, event_id, state, retries, ok) for each request (key, event_id, new).

    State is a video's current state and retries; the requests of a batch are
    taken by event id. A refused request changes nothing.
    """

    def run(name, frames, state):
        at, retries = state.get if state.exists else ("SUBMITTED", 0)
        for frame in frames:
            rows = []
            for r in frame.sort_values("event_id").itertuples():
                fails = r.new.startswith("FAILED_")
                ok = r.new in moves.get(at, ()) and not (fails and retries >= max_retries)
                if ok:
                    at, retries = r.new, retries + fails
                rows.append((name[0], r.event_id, at, retries, ok))
            yield pd.DataFrame(rows, columns=[key, "event_id", "state", "retries", "ok"])
        state.update((at, int(retries)))

    kind = requests.schema[key].dataType.simpleString()
    return requests.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, event_id long, state string, retries int, ok boolean", "state string, retries int", "append", "NoTimeout")


def replay(dead: DataFrame, processed: DataFrame, key: str = "event_id") -> DataFrame:
    """Dead letters that have not been processed since."""
    return dead.join(processed.select(key), key, "left_anti")


#: Messages behind that raise an alert, and a graver one; seconds behind that raise one.
LAG, MOST_LAG, LAG_SECONDS = 1000, 5000, 60


def lag(ends: DataFrame, committed: DataFrame | None, warn: int = LAG, critical: int = MOST_LAG, seconds: float = LAG_SECONDS) -> DataFrame:
    """Messages behind for each topic and partition, with their alert.

    ends: (topic, partition, end), with ``committed`` where no other frame has
    it, and ``behind_seconds`` where that is known.
    """
    both = ends.join(committed, ["topic", "partition"], "left") if committed is not None else ends
    both = both.withColumn("lag", F.col("end") - F.coalesce("committed", F.lit(0)))
    slow = F.coalesce(F.col("behind_seconds") > seconds, F.lit(False)) if "behind_seconds" in both.columns else F.lit(False)
    return both.withColumn("alert", F.when(F.col("lag") > critical, "critical").when((F.col("lag") > warn) | slow, "warning").otherwise("ok"))
