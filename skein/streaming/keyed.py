"""Keyed state with time: the videos' state machine over events that come out of order.

Requests wait in state until the watermark has passed them and are then taken in
order of time, so the result of a stream is that of the sorted table, however its
batches are cut. Timers on event time work off what waits, report videos that are
stuck, and drop finished ones after a while. Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skein.operators.routing import MAX_RETRIES, MOVES
from skein.storage import ship

#: States in which a video can be stuck, and after how many minutes it is.
WORKING = ("METADATA_EXTRACTING", "TRANSCRIPT_EXTRACTING", "CANONICALIZING", "KNOWLEDGE_EXTRACTING", "GRAPH_SYNCING", "ARTICLES_GENERATING")
STUCK_MINUTES = 60
#: How long a finished video's state is kept: what comes later is taken for a new video's.
KEEP_DAYS = 30
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "event_id bigint, ts timestamp, kind string, state string, retries int, ok boolean"

_MS, _DAY = 1000, 86_400_000


class Machine(StatefulProcessor):
    """One video: its state, retries, first start and last change; the requests that wait."""

    def __init__(self, key: str, max_retries: int, stuck_minutes: int, keep_days: int):
        self.key, self.max_retries, self.stuck, self.keep = key, max_retries, stuck_minutes * 60_000_000, keep_days * _DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.video = handle.getValueState("video", "state string, retries int, started long, since long, told boolean")
        # a batch's requests are one entry: each call of the state store is a message to another process
        self.waiting = handle.getListState("waiting", "ts array<long>, event_id array<long>, new array<string>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self._wait([(r["_us"], r["event_id"], r["new"]) for r in rows])
        return iter(())

    def _wait(self, requests: list[tuple], alone: bool = False) -> None:
        """Let requests wait, ``alone`` in place of those that do; a timer for the first of them is enough, as all that is due is worked off at once."""
        entry = tuple(map(list, zip(*requests, strict=True)))
        self.waiting.put([entry]) if alone else self.waiting.appendValue(entry)
        self.handle.registerTimer(-(-min(entry[0]) // _MS))

    def _move(self, held: tuple, us: int, new: str | None) -> tuple[tuple, bool]:
        """The video after a request, and whether it was granted; a refused one changes nothing."""
        state, retries, started, since, told = held
        fails = (new or "").startswith("FAILED_")
        if new not in MOVES.get(state, ()) or (fails and retries >= self.max_retries):
            return held, False
        started = us if started is None and new not in ("SUBMITTED", "QUEUED") else started
        return (new, retries + fails, started, us, False), True

    def _late(self, held: tuple, now: int) -> int | None:
        """Since when the video is stuck, if it is at ``now`` (milliseconds) and was not reported yet."""
        state, _, started, since, told = held
        at = None if state not in WORKING or told else max(since, started + self.stuck)
        return at if at is not None and now > at // _MS else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # all that the watermark has passed is worked off at once; timers of the same round then find nothing to do
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        before = held = tuple(self.video.get() or ("SUBMITTED", 0, None, None, False))
        # a request that came twice is one
        waiting = {(us, event): new for entry in self.waiting.get() for us, event, new in zip(*entry, strict=True)}
        due = sorted((k, new) for k, new in waiting.items() if -(-k[0] // _MS) <= now)
        out = []
        for (us, event), new in [*due, ((now * _MS, None), None)]:
            # timers are for what is left after the round: time goes on with each request
            at = self._late(held, -(-us // _MS) - (event is not None))
            if at is not None:
                out.append(self._row(key, None, at, "stuck", held, None))
                held = (*held[:4], True)
            if event is not None:
                held, ok = self._move(held, us, new)
                out.append(self._row(key, event, us, "move", held, ok))
        later = [(*k, new) for k, new in waiting.items() if -(-k[0] // _MS) > now]
        if due and later:
            self._wait(later, alone=True)
        elif due:
            self.waiting.clear()
        state, _, started, since, told = held
        if not MOVES[state] and now >= since // _MS + self.keep and not later:
            self.video.clear()
        elif held != before:
            self.video.update(held)
            if state in WORKING and not told:
                self.handle.registerTimer(max(since, started + self.stuck) // _MS + 1)
            if not MOVES[state]:
                self.handle.registerTimer(since // _MS + self.keep)
        return iter(out)

    def _row(self, key, event, us, kind, held, ok) -> Row:
        at = datetime.fromtimestamp(us // 1_000_000, timezone.utc).replace(microsecond=us % 1_000_000)
        return Row(**{self.key: key[0], "event_id": event, "ts": at, "kind": kind, "state": held[0], "retries": int(held[1]), "ok": ok})

    def close(self) -> None:
        pass


def run_stream(requests: DataFrame, key: str, late: str = "10 minutes", max_retries: int = MAX_RETRIES, stuck_minutes: int = STUCK_MINUTES, keep_days: int = KEEP_DAYS) -> DataFrame:
    """(key, event_id, ts, kind, state, retries, ok) on a stream of requests (key, event_id, ts, new).

    A ``move`` for each request, in order of (ts, event_id) for each key; a
    ``stuck`` row (without an event) once a video has been at work for too long
    since it was first started. Requests later than ``late`` are dropped by the
    watermark. Rows come out when the watermark passes them.
    """
    spark = requests.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    kind = requests.schema[key].dataType.simpleString()
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("_us", F.unix_micros("ts")).withWatermark("ts", late)
    return timed.groupBy(key).transformWithState(Machine(key, max_retries, stuck_minutes, keep_days), f"{key} {kind}, {OUT}", "Append", "EventTime")


def stuck(moves: DataFrame, key: str, upto, minutes: int = STUCK_MINUTES) -> DataFrame:
    """(key, ts, state): the same reports from the table of moves (key, event_id, ts, state, ok), up to the time ``upto``.

    A video is stuck in a state of work from the sixtieth minute after its first
    start on, or from when it came into the state if that is later, unless it
    has left the state by then.
    """
    granted = moves.filter("ok").withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    line = W.partitionBy(key).orderBy("_us", "event_id")
    rows = granted.withColumns({
        "_left": F.lead("_us").over(line),
        "_started": F.min(F.when(~F.col("state").isin("SUBMITTED", "QUEUED"), F.col("_us"))).over(W.partitionBy(key)),
    }).filter(F.col("state").isin(*WORKING))
    at = F.greatest("_us", F.col("_started") + minutes * 60_000_000)
    # timers are those of milliseconds: one that leaves in the same one is not stuck
    told = F.floor(at / _MS) + 1
    known = rows.withColumn("_at", at).filter((F.col("_left").isNull() | (F.ceil(F.col("_left") / _MS) > told)) & (told * _MS <= F.unix_micros(upto)))
    return known.select(key, F.timestamp_micros("_at").alias("ts"), "state")
