"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space that ends a word.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"

#: A small side is broadcast only up to this many rows; beyond, it is shuffled.
BROADCAST_ROWS = 50_000


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, also where only the driver has it on its path."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parents[2]
    known = {Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)}
    if context.applicationId in _shipped or root in known:
        return
    _shipped.add(context.applicationId)
    out = Path(tempfile.mkdtemp(prefix="skein-")) / "skein.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted((root / "skein").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(out))


def packed(df: DataFrame, *without: str) -> Column:
    """A row's columns as one struct, whatever their names; a struct of none gets a field."""
    names = [c for c in df.columns if c not in without]
    return F.struct(*[df[quoted(c)].alias(c) for c in names]) if names else F.struct(F.lit(True).alias("alone"))


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def fields(first: T.DataType, ddl: str) -> T.StructType:
    """A schema of ``_row``, of a type whose fields may have any name, and what the DDL says."""
    return T.StructType([T.StructField("_row", first), *T.StructType.fromDDL(ddl).fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master (tests, one machine) gets a temporary
    folder once; on a cluster no machine-local folder will do, so that raises.
    """
    ship(spark)
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skein-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


class Scope:
    """The stored tables of one piece of work; ``drop`` deletes them, and only them, once their readers are done."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/skein/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
        self.tables: list[str] = []

    def drop(self) -> None:
        while self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop()}")
        delete(self.spark, self.folder)


_scopes: list[Scope] = []


@contextmanager
def scope(spark: SparkSession, label: str) -> Iterator[Scope]:
    """What ``cut`` and ``clustered`` store inside belongs to the scope that this gives; its ``drop`` is up to the caller."""
    _scopes.append(Scope(spark, label))
    try:
        yield _scopes[-1]
    finally:
        _scopes.pop()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    context = spark.sparkContext
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(context._jsc.hadoopConfiguration()).delete(found, True)


def folder(spark: SparkSession, label: str) -> str:
    """A new path for stored data in the current scope, or outside of any in the session's folder."""
    top = _scopes[-1].folder if _scopes else f"{shared_dir(spark)}/skein/{spark.sparkContext.applicationId}"
    return f"{top}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: ends its lineage.

    The table survives the loss of any executor. Tables stored in a ``scope``
    go with its ``drop``; others stay for the readers of the result that is
    returned, until ``sweep``.
    """
    spark = df.sparkSession
    path = folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_clustered: list[str] = []


def clustered(df: DataFrame, key: str, label: str) -> DataFrame:
    """Like ``cut``, in buckets by ``key``: joins on it need not shuffle this table again."""
    spark = df.sparkSession
    name = f"skein_{label}_{uuid.uuid4().hex}"
    path = folder(spark, name)
    df.write.option("compression", "zstd").option("path", path).bucketBy(partitions(spark), key).saveAsTable(name)
    (_scopes[-1].tables if _scopes else _clustered).append(name)
    return spark.table(name)


def sweep(spark: SparkSession) -> None:
    """Delete all that this session has stored, scopes included: for the end of a session, when no result is still to be read."""
    while _clustered:
        spark.sql(f"DROP TABLE IF EXISTS {_clustered.pop()}")
    delete(spark, f"{shared_dir(spark)}/skein/{spark.sparkContext.applicationId}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_join(left: DataFrame, small: DataFrame, on, how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join a side whose row count is checked: broadcast it only while it is small."""
    rows = small.count() if rows is None else rows
    return left.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def unit(*cols: Column, seed: int = 0) -> Column:
    """A uniform number in (0, 1) that depends on the columns and the seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def sum_before(df: DataFrame, value: str, order: str, name: str, by: str | None = None, chunk: int = 1024) -> DataFrame:
    """Add ``name``: the sum of ``value`` over rows of less ``order`` (whole numbers from 0 on), for each ``by``.

    Summed in two steps, within chunks of the order and over the chunks, so no
    task orders all rows.
    """
    df = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    near = W.partitionBy(*([by] if by else []), "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    far = W.partitionBy(*([by] if by else [])).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = df.groupBy(*([by] if by else []), "_chunk").agg(F.sum(value).alias("_sum"))
    sums = sums.select(F.col("_chunk").alias("_c"), *([F.col(by).alias("_b")] if by else []), F.coalesce(F.sum("_sum").over(far), F.lit(0)).alias("_far"))
    same = F.col("_chunk") == F.col("_c")
    if by:
        same = same & F.col(by).eqNullSafe(F.col("_b"))
    out = df.withColumn("_near", F.coalesce(F.sum(value).over(near), F.lit(0))).join(sums, same)
    return out.withColumn(name, F.col("_near") + F.col("_far")).drop("_chunk", "_c", "_b", "_near", "_far")
