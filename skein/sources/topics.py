"""Topics without a broker: partitioned logs of records as files, as a data source for batches and streams.

A topic is a folder with one folder for each partition; a file's name says the
offset of its first record and how many it holds, so where a partition ends is
known from names alone. Writers stage files and, once all tasks are done, the
driver gives them their offsets by renaming them; a batch of a stream that comes
again finds its note and does nothing. Consumer groups keep the offsets up to
which they have read in files that are written once.

    register(spark)
    df.write.format("topic_log").option("path", p).option("topic", "source.submitted").mode("append").save()
    spark.readStream.format("topic_log").option("path", p).option("topics", "a,b").option("group", "crawler").load()
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

#: Partitions of a topic, and of a dead-letter topic.
PARTITIONS, DEAD_PARTITIONS = 3, 1
SCHEMA = "topic string, partition int, offset bigint, time timestamp, key string, value string"
#: Records that one task reads at least, if there are that many in a partition.
TASK_RECORDS = 500_000
_ARROW = pa.schema([("topic", pa.string()), ("partition", pa.int32()), ("offset", pa.int64()), ("time", pa.timestamp("us", "UTC")), ("key", pa.string()), ("value", pa.string())])


def partition_of(key: str | None, value: str | None, partitions: int) -> int:
    """Records of one key lie in one partition; those without a key are dealt by their value."""
    held = value if key is None else key
    return int(hashlib.md5((held or "").encode()).hexdigest()[:8], 16) % partitions


def partition_column(key: Column, value: Column, partitions: int = PARTITIONS) -> Column:
    """The same as a column."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key, value, F.lit(""))), 1, 8), 16, 10).cast("long"), F.lit(partitions)).cast("int")


class Log:
    """The files of topics under a path of any store that pyarrow has a file system for."""

    def __init__(self, path: str):
        self.fs, self.root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)

    def at(self, *parts: object) -> str:
        return posixpath.join(self.root, *map(str, parts))

    def listed(self, *parts: object) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(self.at(*parts), allow_not_found=True))
        return sorted(x.base_name for x in found)

    def files(self, topic: str, partition: int) -> list[tuple[int, int, str]]:
        """(first offset, records, file), in order."""
        out = []
        for name in self.listed(topic, partition):
            first, many = name.split(".")[0].split("-")
            out.append((int(first), int(many), self.at(topic, partition, name)))
        return out

    def ends(self, topics: list[str]) -> dict[str, int]:
        """Where each partition of the topics ends: "topic/partition" -> the next offset."""
        out = {}
        for topic in topics:
            for p in self.listed(topic):
                files = self.files(topic, int(p))
                out[f"{topic}/{p}"] = files[-1][0] + files[-1][1] if files else 0
        return out

    def read(self, path: str) -> bytes:
        with self.fs.open_input_stream(path) as f:
            return f.read()

    def put(self, path: str, data: bytes) -> bool:
        """Write a file whole; False if it is there already. The driver is the only writer of these."""
        if self.fs.get_file_info(path).type != pafs.FileType.NotFound:
            return False
        self.fs.create_dir(posixpath.dirname(path))
        part = self.at("_staged", f"{uuid.uuid4().hex}.part")
        self.fs.create_dir(posixpath.dirname(part))
        with self.fs.open_output_stream(part) as f:
            f.write(data)
        self.fs.move(part, path)
        return True

    def commit_group(self, group: str, offsets: dict[str, int]) -> None:
        known = self.listed("_groups", group)
        if self.committed(group) != offsets:
            number = int(known[-1].split(".")[0]) + 1 if known else 0
            self.put(self.at("_groups", group, f"{number:012d}.json"), json.dumps(offsets, sort_keys=True).encode())

    def committed(self, group: str) -> dict[str, int]:
        known = self.listed("_groups", group)
        return json.loads(self.read(self.at("_groups", group, known[-1]))) if known else {}


@dataclass
class Range(InputPartition):
    topic: str
    partition: int
    start: int
    end: int


def _ranges(start: dict[str, int], end: dict[str, int]) -> list[Range]:
    out = []
    for name, last in sorted(end.items()):
        topic, p = name.rsplit("/", 1)
        first = start.get(name, 0)
        out += [Range(topic, int(p), a, min(a + TASK_RECORDS, last)) for a in range(first, last, TASK_RECORDS)]
    return out


def _records(path: str, r: Range) -> Iterator[pa.RecordBatch]:
    """The records of a range, file by file; those with a null value are skipped."""
    log = Log(path)
    for first, many, file in log.files(r.topic, r.partition):
        if first + many <= r.start or first >= r.end:
            continue
        lines = log.read(file).splitlines()
        rows = [(first + i, *json.loads(line)) for i, line in enumerate(lines) if r.start <= first + i < r.end]
        rows = [x for x in rows if x[3] is not None]
        if rows:
            offset, time, key, value = zip(*rows, strict=True)
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.topic] * n), pa.array([r.partition] * n, pa.int32()), pa.array(offset, pa.int64()), pa.array(time, pa.timestamp("us", "UTC")), pa.array(key, pa.string()), pa.array(value, pa.string())],
                schema=_ARROW,
            )


def _start(log: Log, options, topics: list[str]) -> dict[str, int]:
    """Where a new reader begins: the earliest records, the latest, or where its group has stopped."""
    kind = options.get("startingOffsets", "earliest")
    if kind not in ("earliest", "latest", "committed"):
        raise ValueError(f"startingOffsets: {kind}")
    if kind == "latest":
        return log.ends(topics)
    group = options.get("group")
    return log.committed(group) if group and kind == "committed" else {}


class TopicReader(DataSourceReader):
    def __init__(self, options):
        self.options, self.path = options, options["path"]

    def partitions(self) -> list[Range]:
        log, topics = Log(self.path), _topics(self.options)
        return _ranges(_start(log, self.options, topics), log.ends(topics)) or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.end > partition.start:
            yield from _records(self.path, partition)


class TopicStreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.options, self.path, self.topics = options, options["path"], _topics(options)

    def initialOffset(self) -> dict:
        return _start(Log(self.path), self.options, self.topics)

    def latestOffset(self) -> dict:
        return Log(self.path).ends(self.topics)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return _ranges(start, end)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _records(self.path, partition)

    def commit(self, end: dict) -> None:
        """Spark has worked off everything up to here."""
        if group := self.options.get("group"):
            log = Log(self.path)
            log.commit_group(group, log.committed(group) | end)


@dataclass
class Staged(WriterCommitMessage):
    """What a task has written: partition, file, records."""

    files: list[tuple[int, str, int]]


class _Writing:
    """Both writers: tasks stage a file for each partition, the driver puts them in place in the order of tasks."""

    def __init__(self, options):
        self.path, self.topic = options["path"], options["topic"]
        self.partitions = int(options.get("partitions", DEAD_PARTITIONS if self.topic.endswith(".dlq") else PARTITIONS))
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        log, out = Log(self.path), {}
        for batch in iterator:
            names = batch.schema.names
            keys, values = (batch.column(c).to_pylist() if c in names else [None] * batch.num_rows for c in ("key", "value"))
            times = batch.column("time").cast(pa.timestamp("us")).cast(pa.int64()).to_pylist() if "time" in names else [None] * batch.num_rows
            for time, key, value in zip(times, keys, values, strict=True):
                p = partition_of(key, value, self.partitions)
                if p not in out:
                    file = log.at("_staged", self.job, f"{uuid.uuid4().hex}-{p}")
                    log.fs.create_dir(posixpath.dirname(file))
                    out[p] = [file, log.fs.open_output_stream(file), 0]
                out[p][1].write(json.dumps([time, key, value]).encode() + b"\n")
                out[p][2] += 1
        for _, stream, _ in out.values():
            stream.close()
        return Staged([(p, file, many) for p, (file, _, many) in sorted(out.items())])

    def place(self, messages: list[Staged | None]) -> None:
        log = Log(self.path)
        ends = log.ends([self.topic])
        for p in range(self.partitions):
            log.fs.create_dir(log.at(self.topic, p))
            end = ends.get(f"{self.topic}/{p}", 0)
            for message in messages:
                for q, file, many in message.files if message else []:
                    if q == p:
                        log.fs.move(file, log.at(self.topic, p, f"{end:020d}-{many}.jsonl"))
                        end += many

    def drop(self, messages: list[Staged | None]) -> None:
        log = Log(self.path)
        for message in messages:
            for _, file, _ in message.files if message else []:
                if log.fs.get_file_info(file).type != pafs.FileType.NotFound:
                    log.fs.delete_file(file)


class TopicWriter(_Writing, DataSourceArrowWriter):
    def commit(self, messages) -> None:
        self.place(messages)

    def abort(self, messages) -> None:
        self.drop(messages)


class TopicStreamWriter(_Writing, DataSourceStreamArrowWriter):
    """``writer`` (an option) names the query; its batch is placed under a plan that is written first, so a batch that comes again is completed or left alone, never doubled."""

    def __init__(self, options):
        super().__init__(options)
        self.writer = options["writer"]

    def commit(self, messages, batchId: int) -> None:
        log = Log(self.path)
        note = log.at("_written", self.writer, f"{batchId:012d}.json")
        ends, plan = log.ends([self.topic]), []
        for p in range(self.partitions):
            log.fs.create_dir(log.at(self.topic, p))
            end = ends.get(f"{self.topic}/{p}", 0)
            for message in messages:
                for q, file, many in message.files if message else []:
                    if q == p:
                        plan.append([file, log.at(self.topic, p, f"{end:020d}-{many}.jsonl")])
                        end += many
        if not log.put(note, json.dumps(plan).encode()):  # an earlier try of this batch: what it planned stands
            self.drop(messages)
            plan = json.loads(log.read(note))
        for file, target in plan:
            if log.fs.get_file_info(file).type != pafs.FileType.NotFound:
                log.fs.move(file, target)

    def abort(self, messages, batchId: int) -> None:
        self.drop(messages)


def _topics(options) -> list[str]:
    return [t.strip() for t in (options.get("topics") or options["topic"]).split(",") if t.strip()]


class TopicLog(DataSource):
    """Options: path; topics (a list with commas) or topic; startingOffsets (earliest, latest, committed); group; partitions and writer to write."""

    @classmethod
    def name(cls) -> str:
        return "topic_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TopicReader:
        return TopicReader(self.options)

    def streamReader(self, schema) -> TopicStreamReader:
        return TopicStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> TopicWriter:
        return TopicWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> TopicStreamWriter:
        return TopicStreamWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known; its classes travel to workers by value."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(TopicLog)


def ends(spark: SparkSession, path: str, topics: list[str]) -> DataFrame:
    """(topic, partition, end): where partitions end; a row for each partition."""
    rows = [(*name.rsplit("/", 1), end) for name, end in Log(path).ends(topics).items()]
    return spark.createDataFrame([(t, int(p), e) for t, p, e in rows], "topic string, partition int, end long")


def committed(spark: SparkSession, path: str, group: str) -> DataFrame:
    """(topic, partition, committed): how far a group has read."""
    rows = [(*name.rsplit("/", 1), end) for name, end in Log(path).committed(group).items()]
    return spark.createDataFrame([(t, int(p), e) for t, p, e in rows], "topic string, partition int, committed long")


def group_lag(spark: SparkSession, path: str, topics: list[str], group: str) -> DataFrame:
    """(topic, partition, end, committed, behind_seconds): behind is the time between the last record and the first that the group has not read."""
    both = ends(spark, path, topics).join(committed(spark, path, group), ["topic", "partition"], "left").withColumn("committed", F.coalesce("committed", F.lit(0)))
    rest = spark.read.format("topic_log").option("path", path).option("topics", ",".join(topics)).option("group", group).option("startingOffsets", "committed").load()
    unread = rest.groupBy("topic", "partition").agg((F.unix_micros(F.max("time")) - F.unix_micros(F.min("time"))).alias("_us"))
    return both.join(unread, ["topic", "partition"], "left").select("topic", "partition", "end", "committed", F.coalesce(F.col("_us") / 1e6, F.lit(0.0)).alias("behind_seconds"))
