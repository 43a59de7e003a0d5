"""WARC: a deterministic sharded writer of web archives, and their reader.

Records are dealt to shards by ranges of (id, payload key). The borders are exact
quantiles of payload bytes, from running sums over all keys in order, so they
depend on the data alone, whatever the ids look like. A task sorts a shard and writes one gzip member for each record, with headers and
digests made anew, into a file with a temporary name; a file that reaches its
compressed size is closed and renamed, and the next begins. Names follow from
shard and number, so a task that runs again, or twice, puts the same bytes in the
same place. A manifest of the files, itself written under a temporary name and
renamed last, commits the archive: readers open only what it lists.

Of equal payloads the record with the smallest id is a response, the others
revisit it and carry the digest and length without the payload.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.common import cut, folder, partitions, ship, table

#: Smallest payload that a revisit may stand for.
REVISIT_BYTES = 100
#: Compressed bytes at which a file is closed.
ROLL_BYTES = 8 << 20
#: Payload bytes of a shard, about, and how many shards there are at most: beyond, shards grow (a task streams its shard).
SHARD_BYTES = 16 << 20
SHARDS = 100_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record as a gzip member of its own; the same input gives the same bytes."""
    lines = [f"{k}: {v}" for k, v in headers]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode()
    made = zlib.compressobj(6, zlib.DEFLATED, 31)  # 31: a gzip header without name and time
    return made.compress(head + block + b"\r\n\r\n") + made.flush()


def _one_line(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def make_record(page_id: int | None, url: str | None, body: bytes, digest: str, refers_to: int | None, number: int) -> bytes:
    """A response, or a revisit of record ``refers_to``."""
    name = uuid.UUID(hashlib.sha256(f"{page_id}|{url}|{digest}|{number}".encode()).hexdigest()[:32])
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + body
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", _one_line(url)))
    headers += [
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
    ]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", str(refers_to))]
    return _record(headers, block)


def read_records(data: bytes) -> Iterator[tuple[dict, dict, bytes]]:
    """(WARC headers, HTTP headers, payload) of each member; a broken digest or member raises."""
    while data:
        member = zlib.decompressobj(31)
        raw = member.decompress(data) + member.flush()
        if not member.eof:
            raise ValueError("the archive ends inside a record")
        data = member.unused_data
        head, _, rest = raw.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        warc = dict(line.split(": ", 1) for line in lines)
        block = rest[: int(warc["Content-Length"])]
        if f"sha256:{hashlib.sha256(block).hexdigest()}" != warc["WARC-Block-Digest"]:
            raise ValueError("the block does not match its digest")
        top, _, payload = block.partition(b"\r\n\r\n")
        http = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
        if warc["WARC-Type"] == "response" and f"sha256:{hashlib.sha256(payload).hexdigest()}" != warc["WARC-Payload-Digest"]:
            raise ValueError("the payload does not match its digest")
        yield warc, http, payload


class _Rolling:
    """Files of one shard, in any store that pyarrow knows by its URI."""

    def __init__(self, uri: str, shard: int, roll: int):
        from pyarrow.fs import FileSystem

        self.fs, self.root = FileSystem.from_uri(uri)
        self.shard, self.roll, self.number, self.done = shard, roll, 0, []
        self.open = None

    def write(self, record: bytes, page_id: int | None) -> None:
        if self.open is None:
            self.name = f"part-{self.shard:06d}-{self.number:06d}.warc.gz"
            self.temporary = f"{self.root}/_temporary-{self.name}-{uuid.uuid4().hex}"
            self.open, self.size, self.rows, self.sha = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
            self.first = page_id
        self.open.write(record)
        self.sha.update(record)
        self.size += len(record)
        self.rows += 1
        self.last = page_id
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.open is not None:
            self.open.close()
            self.fs.move(self.temporary, f"{self.root}/{self.name}")
            self.done.append((self.name, self.shard, self.rows, self.size, self.sha.hexdigest(), self.first, self.last))
            self.open = None
            self.number += 1


FILES = "name string, shard int, records long, bytes long, sha256 string, first long, last long"


def _write(uri: str, roll: int):
    """Sorted rows (shard, page_id, tag, url, html, digest, refers_to) -> one row for each file."""

    def run(batches):
        files: list = []
        out: _Rolling | None = None
        known: dict = {}  # the current id's digests that revisit another record
        at: object = ()
        number = 0
        for batch in batches:
            for shard, page_id, tag, url, html, digest, refers in zip(*(batch.column(i) for i in range(7)), strict=True):
                shard, page_id = shard.as_py(), page_id.as_py()
                if out is None or out.shard != shard:
                    if out is not None:
                        out.close()
                        files += out.done
                    out = _Rolling(uri, shard, roll)
                    at = ()
                if at != (page_id,):
                    at, known, number = (page_id,), {}, 0
                digest = digest.as_py()
                if tag.as_py() == 0:
                    known[digest] = refers.as_py()
                    continue
                target = known.get(digest)
                if target is not None and target == page_id:  # the first row of this id and payload is the response
                    known[digest], target = (page_id,), None
                elif isinstance(target, tuple):
                    target = page_id
                body = html.as_buffer().to_pybytes() if html.is_valid else b""
                out.write(make_record(page_id, url.as_py(), body, digest, target, number), page_id)
                number += 1
        if out is not None:
            out.close()
            files += out.done
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*files, strict=True) if files else [[]] * 7, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["name", "shard", "records", "bytes", "sha256", "first", "last"])

    return run


def _payload_key(page_id: Column, url: Column, digest: Column) -> Column:
    """What splits an id between shards: its payload, as equal payloads of an id belong together; without an id the url too."""
    return F.xxhash64(digest, F.when(page_id.isNull(), url))


def shard_borders(facts: DataFrame, shard_bytes: int) -> list[tuple[int | None, int]]:
    """The least (page_id, key) of each shard but the first: exact quantiles of bytes, SHARDS of them at most.

    Keys are dealt to ranges; bytes are summed up within each range, and over the
    ranges, so no task sees all keys.
    """
    spark = facts.sparkSession
    keys = facts.groupBy("page_id", "key").agg(F.sum("bytes").alias("b"))
    keys = keys.repartitionByRange(partitions(spark), F.col("page_id").asc_nulls_first(), "key").withColumn("p", F.spark_partition_id())
    keys = cut(keys, "keys")
    sums = keys.groupBy("p").agg(F.sum("b").alias("s")).orderBy("p").collect()  # one row for each range
    total, base = 0, {}
    for r in sums:
        base[r["p"]] = total
        total += r["s"]
    step = max(shard_bytes, math.ceil(total / SHARDS))
    if total <= step:
        return []
    bases = spark.createDataFrame(list(base.items()), "p int, base long")
    order = W.partitionBy("p").orderBy(F.col("page_id").asc_nulls_first(), "key").rowsBetween(W.unboundedPreceding, -1)
    placed = keys.withColumn("before", F.coalesce(F.sum("b").over(order), F.lit(0))).join(F.broadcast(bases), "p")
    placed = placed.withColumn("shard", F.floor((F.col("base") + F.col("before")) / step))
    firsts = placed.groupBy("shard").agg(F.min(F.struct("page_id", "key")).alias("f")).orderBy("shard").select("f.*").collect()
    return [(r["page_id"], r["key"]) for r in firsts[1:]]


def _shard_of(borders: list[tuple[int | None, int]]) -> Column:
    """How many borders are not above (page_id, key): a binary search in a constant."""
    if not borders:
        return F.lit(0)
    rows = json.dumps([{"page_id": i, "key": k} for i, k in borders])
    edges = F.from_json(F.lit(rows), "array<struct<page_id:bigint,key:bigint>>")
    steps = F.array(*[F.lit(1 << b) for b in range(len(borders).bit_length() - 1, -1, -1)])
    own = F.struct("page_id", "key")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(borders)) & (F.get(edges, at + step - 1) <= own), at + step).otherwise(at))


def write_warc(pages: DataFrame, uri: str, key: str = "page_id", url: str = "url", html: str = "html",
               shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` under ``uri`` and commit; -> the manifest's rows.

    Null payloads are empty. Null urls have no target header. Rows without an id
    come first and are responses. Repeated rows have records of their own: the
    first is the response, the others revisit it. Many rows of one id are split
    between shards by payload. An empty table gives a manifest without files. A
    reader that finds no manifest finds no archive.
    """
    spark = pages.sparkSession
    ship(spark)
    body = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    plain = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("html")).withColumn("digest", F.sha2("html", 256))
    plain = plain.withColumn("key", _payload_key(F.col("page_id"), F.col("url"), F.col("digest")))
    facts = cut(plain.select("page_id", "key", F.octet_length("html").cast("long").alias("bytes"), "digest"), "facts")
    borders = shard_borders(facts, shard_bytes)
    # ids by payload: sums meet, not rows; only payloads that occur again go on
    equal = facts.filter((F.col("bytes") >= revisit_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    again = facts.filter(F.col("page_id").isNotNull()).join(equal.filter("n > 1"), "digest").select("page_id", "key", "digest", "refers_to").distinct()
    rows = plain.select("page_id", "key", F.lit(1).alias("tag"), "url", "html", "digest", F.lit(None).cast("long").alias("refers_to"))
    marks = again.select("page_id", "key", F.lit(0).alias("tag"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"), "digest", "refers_to")
    both = rows.unionByName(marks).withColumn("shard", _shard_of(borders).cast("int"))
    dealt = both.repartitionByRange(len(borders) + 1, "shard").sortWithinPartitions("shard", "page_id", "tag", "url", "digest")
    files = dealt.select("shard", "page_id", "tag", "url", "html", "digest", "refers_to").mapInArrow(_write(uri, roll_bytes), FILES)
    files.write.mode("overwrite").parquet(f"{uri}/_manifest-temporary")
    _rename(spark, f"{uri}/_manifest-temporary", f"{uri}/_manifest")
    return manifest(spark, uri)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(path(new), True)
    if not fs.rename(path(old), path(new)):
        raise OSError(f"{old} could not be renamed")


def manifest(spark: SparkSession, uri: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(f"{uri}/_manifest")


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_warc(spark: SparkSession, uri: str, payloads: bool = True) -> DataFrame:
    """The committed archive's records; files that the manifest doesn't list are not read, listed ones that are short or changed raise."""
    ship(spark)
    # rows of the manifest are files, not records: a task opens its files itself
    listed = manifest(spark, uri).select("name", "bytes", "sha256")
    files = listed.repartition(max(partitions(spark), math.ceil(listed.count() / 8)), "name")

    def run(batches):
        from pyarrow.fs import FileSystem

        store, root = FileSystem.from_uri(uri)
        for batch in batches:
            for name, size, sha in zip(*(batch.column(i) for i in range(3)), strict=True):
                with store.open_input_stream(f"{root}/{name.as_py()}", compression=None) as f:  # bytes of ROLL_BYTES and a record
                    data = f.read()
                if len(data) != size.as_py() or hashlib.sha256(data).hexdigest() != sha.as_py():
                    raise ValueError(f"{name.as_py()} is not what the manifest lists")
                out: list[list] = [[] for _ in range(7)]
                held = 0
                for warc, http, payload in read_records(data):
                    row = (
                        int(warc["X-Page-ID"]) if "X-Page-ID" in warc else None,
                        _unline(warc["WARC-Target-URI"]) if "WARC-Target-URI" in warc else None,
                        int(http["Content-Length"]), warc["WARC-Payload-Digest"].removeprefix("sha256:"), warc["WARC-Type"],
                        int(warc["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in warc else None,
                        payload if payloads and warc["WARC-Type"] == "response" else None,
                    )
                    for x, v in zip(out, row, strict=True):
                        x.append(v)
                    held += len(payload)
                    if held > 8 << 20:
                        yield batch_of(out)
                        out, held = [[] for _ in range(7)], 0
                yield batch_of(out)

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return files.mapInArrow(run, RECORDS)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = folder(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), uri)
    return read_warc(spark, uri, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least,
             row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS place FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND place > 1 AND page_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND place > 1 AND page_id IS NOT NULL THEN least END AS refers_to
FROM f
"""
