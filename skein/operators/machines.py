"""State machines over long histories: blocks of requests as functions, composed.

Where a machine ends up after a block of requests depends only on where it began,
and it can begin in few places (a state and a number of retries). So blocks are
run from all of them at once, independently of each other; composing the blocks
of a key in order says where each really begins, and then each is replayed from
there. A key with very many requests is many blocks in many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.storage import ship, stored


class Machine:
    """Moves (state -> states) with a ceiling of retries as tables over places: state * (most + 1) + retries."""

    def __init__(self, moves: dict[str, tuple[str, ...]], most: int):
        self.states, self.most = list(moves), most
        self.number = {s: i for i, s in enumerate(self.states)}
        n, r = len(self.states), most + 1
        place = np.arange(n * r)
        at, retries = place // r, place % r
        #: For each requested state, and one more for all others: the place after it, and whether it is granted.
        self.after = np.tile(place, (n + 1, 1))
        self.granted = np.zeros((n + 1, n * r), bool)
        for new, i in self.number.items():
            fails = new.startswith("FAILED_")
            ok = np.array([new in moves[self.states[s]] for s in at]) & ~(fails & (retries >= most))
            self.granted[i] = ok
            self.after[i] = np.where(ok, i * r + retries + (ok & fails), place)

    def requested(self, names: list[str | None]) -> list[int]:
        other = len(self.states)
        return [self.number.get(n, other) for n in names]


def _runs(keys: list) -> Iterator[tuple[int, int]]:
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start]:
            yield start, i
            start = i


def _functions(machine: Machine):
    """(key, block, new) sorted by key and order within a block -> (key, block, to): the place each place leads to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, to, kind = None, None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([held[0]], kind), pa.array([held[1]], pa.int32()), pa.array([to.tolist()], pa.list_(pa.int32()))], ["key", "block", "to"])

        for batch in batches:
            kind = batch.column(0).type
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            new = machine.requested(batch.column(2).to_pylist())
            for a, e in _runs(keys):
                if keys[a] != held:
                    if held is not None:
                        yield out()
                    held, to = keys[a], np.arange(machine.after.shape[1])
                for i in new[a:e]:
                    to = machine.after[i][to]
        if held is not None:
            yield out()

    return run


def _replay(machine: Machine):
    """(key, block, start, row, new) sorted likewise -> (row, state, retries, ok)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place = None, 0
        r = machine.most + 1
        after, granted = machine.after.tolist(), machine.granted.tolist()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            start, new = batch.column(2).to_pylist(), machine.requested(batch.column(4).to_pylist())
            places, ok = [], []
            for key, s, i in zip(keys, start, new, strict=True):
                if key != held:
                    held, place = key, s
                ok.append(granted[i][place])
                place = after[i][place]
                places.append(place)
            state = [machine.states[p // r] for p in places]
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(state), pa.array([p % r for p in places], pa.int32()), pa.array(ok, pa.bool_())], ["_rest", "state", "retries", "ok"])

    return run


def run_blocks(requests: DataFrame, key: str, order: list[str], moves: dict[str, tuple[str, ...]], most: int, first: str, blocks: int | None = None) -> DataFrame:
    """All columns of requests (key, order, new, ...) with state, retries and ok after each, run in order for each key from the state ``first``.

    The last column of ``order`` is unique within a key. A refused request, and
    one for an unknown or null state, changes nothing. A null key is a key.
    """
    spark = requests.sparkSession
    ship(spark)
    machine = Machine(moves, most)
    n = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in requests.columns if c != key]
    # ranges of (key, order): a hot key lies in several, one after the other; what is stored keeps its block
    dealt = requests.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col("new").alias("_new"), F.struct(*rest).alias("_rest"))
    by = ["_key", *[f"_o{i}" for i in range(len(order))]]
    dealt = stored(dealt.repartitionByRange(n, *by).withColumn("_block", F.spark_partition_id()), "requests")
    near = dealt.repartition("_block", "_key").sortWithinPartitions("_block", *by)
    kind = dealt.schema["_key"].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("block", T.IntegerType()), T.StructField("to", T.ArrayType(T.IntegerType()))])
    functions = near.select("_key", "_block", "_new").mapInArrow(_functions(machine), schema)
    # a key has a function for each range that it reaches into
    lists = functions.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "to"))).alias("all"))
    begin = machine.number[first] * (most + 1)
    zero = F.struct(F.lit(begin).alias("at"), F.array().cast("array<struct<block:int,start:int>>").alias("out"))
    step = lambda s, f: F.struct(F.element_at(f["to"], s["at"] + 1).alias("at"), F.concat(s["out"], F.array(F.struct(f["block"].alias("block"), s["at"].alias("start")))).alias("out"))
    starts = stored(lists.select(F.col("key").alias("_k"), F.inline(F.aggregate("all", zero, step, lambda s: s["out"]))), "starts")
    met = dealt.join(starts, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("block")))
    near = met.repartition("_block", "_key").sortWithinPartitions("_block", *by).select("_key", "_block", "start", F.struct("_key", "_rest").alias("_rest"), "_new")
    schema = T.StructType([T.StructField("_rest", near.schema["_rest"].dataType), *T.StructType.fromDDL("state string, retries int, ok boolean").fields])
    out = near.mapInArrow(_replay(machine), schema)
    return out.select(F.col("_rest._key").alias(key), *[F.col("_rest._rest").getField(c).alias(c) for c in rest], "state", "retries", "ok")
