"""Stored tables that change: upserts by key bucket, and summaries kept up by their changes.

A table is a folder of files in key buckets and a line of manifests, each of which
says for every bucket which folder holds it. A change rewrites the buckets that
its keys touch, into new folders, and puts the next manifest in place, whole or
not at all: readers see the table before or after it. Two writers of one version
can't both win; the one that comes second starts again from the new table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.storage import names, put_once, read_text, remove

#: Buckets of a table unless it says otherwise; its manifest has as many lines.
BUCKETS = 16


class Conflict(RuntimeError):
    """Another writer was first, more often than this one would try again."""


class Table:
    """A stored table with a key (one column or several)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.lit(8), *self.keys), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """The last one; -1 before the first."""
        held = [int(n.split(".")[0]) for n in names(self.spark, f"{self.path}/_manifests") if n.endswith(".json")]
        return max(held, default=-1)

    def _commit(self, version: int | None) -> dict:
        version = self.version() if version is None else version
        return json.loads(read_text(self.spark, f"{self.path}/_manifests/{version:012d}.json")) if version >= 0 else {"buckets": {}, "note": None}

    def manifest(self, version: int | None = None) -> dict[str, str]:
        """Bucket -> folder."""
        return self._commit(version)["buckets"]

    def note(self, version: int | None = None):
        """What the writer of a version has put down with it."""
        return self._commit(version)["note"]

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version, the last unless named; ``only`` those of some buckets."""
        folders = [f for b, f in sorted(self.manifest(version).items()) if only is None or int(b) in only]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def _change(self, changed: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], tries: int, note=None) -> tuple[int, DataFrame]:
        """Rewrite the buckets of ``changed`` as ``merge(old rows, changed)``; -> the version made, the touched buckets' number as a frame of changes."""
        changed = changed.withColumn("_b", self.bucket()).persist()
        try:
            touched = [r[0] for r in changed.select("_b").distinct().collect()]  # as many as there are buckets, at most
            for _ in range(tries):
                base = self.version()
                if not touched:
                    return base, self._difference(base, base, [])
                out = f"{self.path}/data/{base + 1:012d}-{uuid.uuid4().hex}"
                merged = merge(self.read(base, touched), changed.drop("_b")).select(*self.schema.names)
                merged.withColumn("_b", self.bucket()).repartition("_b").write.partitionBy("_b").parquet(out)
                written = {n.split("=")[1] for n in names(self.spark, out) if n.startswith("_b=")}
                kept = {b: f for b, f in self.manifest(base).items() if int(b) not in touched}
                now = kept | {b: f"{out}/_b={b}" for b in written}
                if put_once(self.spark, f"{self.path}/_manifests/{base + 1:012d}.json", json.dumps({"buckets": now, "note": note}, sort_keys=True)):
                    return base + 1, self._difference(base, base + 1, touched)
                remove(self.spark, out)
            raise Conflict(self.path)
        finally:
            changed.unpersist()

    def upsert(self, rows: DataFrame, order: str, tries: int = 5) -> tuple[int, DataFrame]:
        """The last row of each key by ``order``, of old and new ones; an old row stays where a new one is not later.

        -> (version, changes), changes as ``changes`` gives them. Rows with a null key are rows of that key.
        """

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            both = old.select("*", F.lit(0).alias("_new")).unionByName(new.select(*self.schema.names, F.lit(1).alias("_new")))
            last = W.partitionBy(*self.keys).orderBy(F.col(order).desc_nulls_last(), "_new", F.to_json(F.struct(*self.schema.names)))
            return both.withColumn("_r", F.row_number().over(last)).filter("_r = 1")

        return self._change(rows.select(*self.schema.names), merge, tries)

    def delete(self, keys: DataFrame, tries: int = 5) -> tuple[int, DataFrame]:
        """Remove the rows of these keys; keys that aren't there do nothing. -> (version, changes)"""

        def merge(old: DataFrame, gone: DataFrame) -> DataFrame:
            same = F.lit(True)
            for k in self.keys:
                same = same & old[k].eqNullSafe(F.col("_gone_" + k))
            return old.join(gone.select(*[F.col(k).alias("_gone_" + k) for k in self.keys]).distinct(), same, "left_anti")

        return self._change(keys.select(*self.keys), merge, tries)

    def changes(self, since: int, upto: int | None = None) -> DataFrame:
        """What differs between two versions: rows that went with ``_sign`` -1, rows that came with 1. Only buckets whose folder changed are read."""
        upto = self.version() if upto is None else upto
        a, b = self.manifest(since), self.manifest(upto)
        return self._difference(since, upto, [int(k) for k in a.keys() | b.keys() if a.get(k) != b.get(k)])

    def _difference(self, since: int, upto: int, buckets: list[int]) -> DataFrame:
        gone, come = self.read(since, buckets) if since >= 0 else self.read(-1), self.read(upto, buckets)
        signed = gone.withColumn("_sign", F.lit(-1)).unionByName(come.withColumn("_sign", F.lit(1)))
        net = signed.groupBy(*self.schema.names).agg(F.sum("_sign").cast("int").alias("_sign"))
        return net.filter("_sign <> 0")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove folders that none of the last ``keep`` versions uses, and older manifests. Not while a change is being written."""
        last = self.version()
        held = {f.rsplit("/", 1)[0] for v in range(max(0, last - keep + 1), last + 1) for f in self.manifest(v).values()}
        gone = [f"{self.path}/data/{n}" for n in names(self.spark, f"{self.path}/data") if f"{self.path}/data/{n}" not in held]
        gone += [f"{self.path}/_manifests/{v:012d}.json" for v in range(0, last - keep + 1)]
        for path in gone:
            remove(self.spark, path)
        return gone


class Summary:
    """A stored aggregate of a changing table: count and decimal sums by keys, kept up by changes with retractions.

    measures: name -> SQL expression, summed as decimals; one of every row of
    a key counts in ``n``. A key without rows left has no row. Each version of a
    summary notes that of the source, so a change that comes twice counts once,
    and of two refreshers one loses.
    """

    SUM = "decimal(28,4)"

    def __init__(self, spark: SparkSession, path: str, keys: T.StructType | str, measures: dict[str, str], buckets: int = BUCKETS):
        self.keys = keys if isinstance(keys, T.StructType) else T.StructType.fromDDL(keys)
        self.measures = measures
        columns = [T.StructField(f.name, f.dataType) for f in self.keys.fields] + [T.StructField("n", T.LongType())] + [T.StructField(m, T.DecimalType(28, 4)) for m in measures]
        self.table = Table(spark, path, T.StructType(columns), self.keys.names, buckets)
        self.spark = spark

    def upto(self) -> int:
        """The version of the source that is in; -1 for nothing."""
        note = self.table.note()
        return -1 if note is None else note

    def _sums(self, rows: DataFrame, sign: Column) -> DataFrame:
        of = [F.sum(F.expr(e).cast(self.SUM) * sign).cast(self.SUM).alias(m) for m, e in self.measures.items()]
        return rows.groupBy(*self.keys.names).agg(F.sum(sign).cast("long").alias("n"), *of)

    def refresh(self, source: Table) -> int:
        """Bring in what has changed in the source since the last time; only the summary's touched buckets are rewritten."""
        now = source.version()
        if now <= self.upto():
            return self.table.version()
        delta = self._sums(source.changes(self.upto(), now), F.col("_sign").cast("decimal(4,0)"))

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            both = old.unionByName(new.select(*self.table.schema.names))
            sums = [F.sum(F.coalesce(F.col(m), F.lit(0))).cast(self.SUM).alias(m) for m in self.measures]
            return both.groupBy(*self.keys.names).agg(F.sum("n").alias("n"), *sums).filter("n <> 0")

        version, _ = self.table._change(delta, merge, 1, note=now)
        return version

    def read(self) -> DataFrame:
        return self.table.read()

    def full(self, source: DataFrame) -> DataFrame:
        """The same from all rows."""
        out = self._sums(source, F.lit(1).cast("decimal(4,0)"))
        return out.withColumns({m: F.coalesce(F.col(m), F.lit(0).cast(self.SUM)) for m in self.measures})
