"""Streams in several batches: topics, once-only sinks, keyed state with timers."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from skein.operators import routing
from skein.sources import topics
from skein.streaming import jobs, keyed, sinks

BEGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)


def requests(n=400, keys=7, seed=3):
    rng = random.Random(seed)
    rows, at = [], {k: "SUBMITTED" for k in range(keys)}
    for i in range(n):
        k = rng.randrange(keys)
        new = rng.choice(routing.MOVES[at[k]] or ("QUEUED",)) if rng.random() < 0.8 else rng.choice(routing.STATES)
        if new in routing.MOVES[at[k]]:
            at[k] = new
        rows.append((k, i, BEGIN + timedelta(minutes=7 * i, microseconds=rng.randrange(10**6)), new))
    return rows


def test_state_machine_out_of_order(spark, tmp_path):
    """Batches cut and shuffled at will give the rows of the sorted table, stuck videos included."""
    rows = requests()
    order = sorted(range(len(rows)), key=lambda i: i + random.Random(i).randrange(8))  # up to an hour late
    schema = "video long, event_id long, ts timestamp, new string"
    end = BEGIN + timedelta(days=60)
    for b in range(5):
        part = [rows[i] for i in order[b * 80 : b * 80 + 80]]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{b}"))
    # one more event lets the watermark pass all others; its own video is then left out
    spark.createDataFrame([(999, 10_000, end, "QUEUED")], schema).coalesce(1).write.parquet(str(tmp_path / "in/5"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = keyed.run_stream(stream, "video", late="2 hours")
    query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).filter("video < 999").collect()
    table = spark.createDataFrame(rows, schema)
    moves = routing.run_moves(table, "video", "ts", "event_id")
    wanted = {(r["video"], r["event_id"], r["state"], r["retries"], r["ok"]) for r in moves.collect()}
    assert {(r["video"], r["event_id"], r["state"], r["retries"], r["ok"]) for r in got if r["kind"] == "move"} == wanted
    assert sum(r["kind"] == "move" for r in got) == len(rows)
    late = keyed.stuck(moves, "video", F.lit(end - timedelta(hours=2)))
    told = sorted((r["video"], r["ts"], r["state"]) for r in late.collect())
    assert sorted((r["video"], r["ts"], r["state"]) for r in got if r["kind"] == "stuck") == told and told


class Store:
    """One key's state in this process; counts the messages that Spark's would take."""

    def __init__(self):
        self.calls, self.timers, self.held = 0, set(), {}

    def state(self, name, schema):
        store = self

        class State:
            def __getattr__(self, call):
                def run(*args):
                    store.calls += 1
                    now = store.held.get(name)
                    if call == "exists":
                        return now is not None
                    if call in ("get", "iterator", "keys"):
                        return iter(dict(now or {}).items()) if call == "iterator" else iter(dict(now or {})) if call == "keys" else now if "list" not in kind else iter(list(now or []))
                    store.held[name] = {"clear": lambda: None, "update": lambda v: v, "put": list, "appendValue": lambda v: [*(now or []), v], "updateValue": lambda k, v: {**(now or {}), k: v}, "removeKey": lambda k: {x: v for x, v in (now or {}).items() if x != k}}[call](*args)

                return run

        kind = "list" if "array" in schema else "value"
        return State()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def getValueState(self, name, schema):
        return self.state(name, schema)

    getListState = getValueState

    def getMapState(self, name, key, value):
        return self.state(name, value)


def test_state_is_called_by_batch_and_not_by_request():
    """A video's requests in three batches, the last ones not due before the end: the calls of the state store don't grow with the requests."""
    rows = [{"_us": 60_000_000 * i, "event_id": i, "new": routing.STATES[1 + i % 15]} for i in range(300)]
    machine, store, got = keyed.Machine("video", 3, 60, 30), Store(), []
    machine.init(store)
    for b, now in ((0, 40), (1, 90), (2, 1_000)):
        list(machine.handleInputRows((1,), iter(rows[b * 100 : b * 100 + 100][::-1]), None))
        clock = type("T", (), {"getCurrentWatermarkInMs": lambda self, now=now: now * 60_000, "getExpiryTimeInMs": lambda self, now=now: now * 60_000})()
        for at in sorted(t for t in store.timers if t <= now * 60_000):
            store.timers.discard(at)
            got += machine.handleExpiredTimer((1,), clock, clock)
    assert [r["event_id"] for r in got if r["kind"] == "move"] == list(range(300))
    assert store.calls < 60


@pytest.fixture
def log(spark, tmp_path):
    topics.register(spark)
    return f"file://{tmp_path}/log"


def put(spark, path, topic, rows, **options):
    df = spark.createDataFrame(rows, "key string, value string").coalesce(1)
    df.write.format("topic_log").options(path=path, topic=topic, **options).mode("append").save()


def read(spark, path, names, **options):
    return spark.read.format("topic_log").options(path=path, topics=names, **options).load()


def test_topics_batch(spark, log):
    put(spark, log, "a", [("k1", "v1"), ("k2", None), ("k1", "v2"), (None, "v3")])
    put(spark, log, "a", [("k1", "v4")])
    put(spark, log, "b.dlq", [("x", "y"), ("z", "y")])
    rows = read(spark, log, "a, b.dlq").collect()
    assert sorted((r["topic"], r["value"]) for r in rows) == [("a", "v1"), ("a", "v2"), ("a", "v3"), ("a", "v4"), ("b.dlq", "y"), ("b.dlq", "y")]
    one = [(r["partition"], r["offset"]) for r in sorted(rows, key=lambda r: r["value"]) if r["key"] == "k1"]
    assert len({p for p, _ in one}) == 1 and [o for _, o in one] == sorted(o for _, o in one)  # a key's records in one partition, in order
    assert {r["partition"] for r in rows if r["topic"] == "b.dlq"} == {0}
    assert one[0][0] == topics.partition_of("k1", "v1", 3) == spark.range(1).select(topics.partition_column(F.lit("k1"), F.lit("v1"))).first()[0]
    found = topics.ends(spark, log, ["a"]).collect()
    assert sum(r["end"] for r in found) == 5
    assert read(spark, log, "none").count() == 0 and read(spark, log, "a", startingOffsets="latest").count() == 0
    with pytest.raises(Exception, match="startingOffsets"):
        read(spark, log, "a", startingOffsets="odd").count()


def test_topics_stream_restarts_without_loss(spark, log, tmp_path):
    def run(fail=None, group="g"):
        seen = []

        def handle(df, number):
            rows = [(r["topic"], r["partition"], r["offset"], r["value"]) for r in df.collect()]
            if fail is not None and any(r[3] == fail for r in rows):
                raise RuntimeError("on purpose")
            seen.extend(rows)

        stream = spark.readStream.format("topic_log").options(path=log, topics="a,b", group=group).load()
        q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception:
            if fail is None:
                raise
        return seen

    put(spark, log, "a", [(f"k{i}", f"a{i}") for i in range(20)])
    put(spark, log, "b", [(f"k{i}", f"b{i}") for i in range(10)])
    first = run()
    assert sorted(r[3] for r in first) == sorted([f"a{i}" for i in range(20)] + [f"b{i}" for i in range(10)])
    put(spark, log, "a", [(f"k{i}", f"c{i}") for i in range(15)])
    assert run(fail="c7") == []  # stops in the middle of a batch
    again = run()
    assert sorted(r[3] for r in again) == sorted(f"c{i}" for i in range(15))
    # a batch's offsets are committed when the next begins: everything is once one more came
    put(spark, log, "b", [("k", "last")])
    assert [r[3] for r in run()] == ["last"]
    held = {(r["topic"], r["partition"]): r["committed"] for r in topics.committed(spark, log, "g").collect()}
    assert sum(held.values()) >= 45
    lag = topics.group_lag(spark, log, ["a", "b"], "g").collect()
    assert sum(r["end"] - r["committed"] for r in lag) == 46 - sum(held.values())
    assert read(spark, log, "a,b", group="g", startingOffsets="committed").count() == 46 - sum(held.values())


def test_topic_sink_of_a_stream_writes_a_batch_once(spark, log, tmp_path):
    spark.range(30).select(F.col("id").cast("string").alias("video_id"), F.lit("x").alias("state")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("video_id string, state string").parquet(str(tmp_path / "in"))

    def run(checkpoint):
        q = jobs.records(source).writeStream.format("topic_log").options(path=log, topic="t", writer="w", checkpointLocation=str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination()

    run("cp1")
    run("cp2")  # the checkpoint is lost, the batch comes again under the same name
    rows = read(spark, log, "t").collect()
    assert sorted(int(r["key"]) for r in rows) == list(range(30))
    assert json.loads(rows[0]["value"])["state"] == "x"
    for p in range(3):
        assert sorted(r["offset"] for r in rows if r["partition"] == p) == list(range(sum(r["partition"] == p for r in rows)))


def test_once_sink(spark, tmp_path):
    """A batch that fails between its two writes and is tried again is there once."""
    schema = "event_id long, value double, reason string"
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, -1.0)], "event_id long, value double")
    sink = sinks.OnceSink(spark, f"file://{tmp_path}/out")
    good, dead = jobs.good_or_dead(df, "value > 0")
    with pytest.raises(Exception, match="on purpose"):
        sink.write(0, {"good": good, "dead": dead.withColumn("reason", F.raise_error(F.lit("on purpose")).cast("string"))})
    assert sink.committed() == [] and sink.read("good", "event_id long, value double").count() == 0
    assert sink.write(0, {"good": good, "dead": dead}) and not sink.write(0, {"good": good, "dead": dead})
    assert [r["event_id"] for r in sink.read("good", "event_id long, value double").collect()] == [1]
    assert sorted((r["event_id"], r["batch"]) for r in sink.read("dead", schema).collect()) == [(2, 0), (3, 0)]
    assert len(sink.clean()) == 2 and sink.clean() == []  # both folders of the try that failed
    assert sink.read("good", "event_id long, value double").count() == 1
    # two writers of one batch: the second finds it taken
    other = sinks.OnceSink(spark, f"file://{tmp_path}/out")
    other.committed = lambda: []
    assert not other.write(0, {"good": good})
    assert sink.read("good", "event_id long, value double").count() == 1
    done = spark.createDataFrame([(2,)], "event_id long")
    assert sinks.replay_once(sink, schema, done, "event_id", 1, lambda x: x) and not sinks.replay_once(sink, schema, done, "event_id", 1, lambda x: x)
    assert [r["event_id"] for r in sink.read("replayed", schema).collect()] == [3]


def test_route_once_survives_a_restart(spark, tmp_path):
    spark.range(20).select(F.col("id").alias("event_id"), F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("value")).write.parquet(str(tmp_path / "in"))
    sink = sinks.OnceSink(spark, f"file://{tmp_path}/out")
    stream = spark.readStream.schema("event_id long, value double").parquet(str(tmp_path / "in"))
    for checkpoint in ("cp", "cp", "other"):  # the last one has lost its checkpoint and sees the batch again
        stream.writeStream.foreachBatch(sinks.route_once(sink, "value IS NOT NULL")).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
    assert sink.committed() == [0]
    assert sink.read("good", "event_id long, value double").count() == 13 and sink.read("dead", "event_id long, value double, reason string").count() == 7
