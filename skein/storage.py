"""The shared store: folders for intermediate tables, small files that are written once, the package for Python workers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

#: Spark's setting by which a query's shuffle files go when it has ended, and not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, also where only the driver has it on its path."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parents[1]
    known = {Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)}
    if context.applicationId in _shipped or root in known:
        return
    _shipped.add(context.applicationId)
    out = Path(tempfile.mkdtemp(prefix="skein-")) / "skein.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted((root / "skein").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(out))


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder for files that a query writes and reads back: in spark.checkpoint.dir; a local master may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skein-")
    return f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared store and read it back: ends its lineage, and survives the loss of any executor. What was shuffled for it is deleted."""
    path, conf = scratch(df.sparkSession, label), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole or not at all; False, and nothing changed, if there is one of that name already."""
    jvm, target, fs = _store(spark, path)
    _, part, _ = _store(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(part, target, none)
        return True
    except Exception as e:
        fs.delete(part, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise


def read_text(spark: SparkSession, path: str) -> str:
    jvm, found, fs = _store(spark, path)
    stream = fs.open(found)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds, sorted; nothing if it isn't there."""
    _, found, fs = _store(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(found)) if fs.exists(found) else []


def remove(spark: SparkSession, path: str) -> None:
    _, found, fs = _store(spark, path)
    fs.delete(found, True)
