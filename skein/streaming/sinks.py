"""File sinks that commit a batch of a stream once, however often it is tried."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.storage import names, put_once, read_text, remove
from skein.streaming.jobs import good_or_dead


class OnceSink:
    """Several outputs of a batch under one folder, committed together.

    A batch is written to folders of names of its own; then one manifest, that
    of the batch's number, names them all. It is put in place whole or not at
    all, and only where none is: whoever comes second has written for nothing.
    Readers see the folders that manifests name, so neither half a batch nor
    one that was tried twice.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _manifest(self, batch: int) -> str:
        return f"{self.path}/_manifests/{batch:012d}.json"

    def committed(self) -> list[int]:
        return [int(n.split(".")[0]) for n in names(self.spark, f"{self.path}/_manifests") if n.endswith(".json")]

    def write(self, batch: int, outputs: dict[str, DataFrame]) -> bool:
        """Commit the outputs as this batch; False if it was committed before."""
        if batch in self.committed():
            return False
        folders = {name: f"{self.path}/{name}/{batch:012d}-{uuid.uuid4().hex}" for name in outputs}
        for name, df in outputs.items():
            df.write.parquet(folders[name])
        if put_once(self.spark, self._manifest(batch), json.dumps(folders, sort_keys=True)):
            return True
        for folder in folders.values():
            remove(self.spark, folder)
        return False

    def read(self, name: str, schema) -> DataFrame:
        """All committed rows of an output, with the number of their batch."""
        spark = self.spark
        folders = [(b, json.loads(read_text(spark, self._manifest(b))).get(name)) for b in self.committed()]
        found = [(b, f) for b, f in folders if f]
        if not found:
            return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("long"))
        rows = spark.read.schema(schema).parquet(*[f for _, f in found])
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{12})-[0-9a-f]{32}/", 1).cast("long")
        return rows.select("*", number.alias("batch"))

    def clean(self) -> list[str]:
        """Remove folders that no manifest names: those of tries that failed. Not to be called while a batch is written."""
        known = {f for b in self.committed() for f in json.loads(read_text(self.spark, self._manifest(b))).values()}
        gone = []
        for name in names(self.spark, self.path):
            if not name.startswith("_"):
                gone += [f"{self.path}/{name}/{x}" for x in names(self.spark, f"{self.path}/{name}") if f"{self.path}/{name}/{x}" not in known]
        for folder in gone:
            remove(self.spark, folder)
        return gone


def route_once(sink: OnceSink, valid: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows that meet the condition to ``good``, all others to ``dead`` with the reason, both once."""

    def route(batch: DataFrame, number: int) -> None:
        if number in sink.committed():
            return
        batch = batch.persist()
        good, dead = good_or_dead(batch, valid)
        sink.write(number, {"good": good, "dead": dead})
        batch.unpersist()

    return route


def replay_once(sink: OnceSink, schema, processed: DataFrame, key: str, batch: int, handle: Callable[[DataFrame], DataFrame]) -> bool:
    """Replay the dead letters that have not been processed since, as one more batch; again with the same number: nothing."""
    dead = sink.read("dead", schema).drop("batch")
    return sink.write(batch, {"replayed": handle(dead.join(processed.select(key), key, "left_anti").dropDuplicates([key]))})
