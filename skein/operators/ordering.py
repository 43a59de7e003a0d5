"""Windows, queues, pages and top-k. Every order ends in a unique key, so results are stable."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queue order of priorities; others come last.
PRIORITY = {"HIGH": 1, "MEDIUM": 2, "LOW": 3, "SKIP": 4}
RETRY_SECONDS = (60, 300, 900, 3600, 3600)


def latest(df: DataFrame, keys: list[str], *order: Column, rank: str = "rn", keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of each key in the given order, with their rank."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= keep)


def archive_candidates(df: DataFrame, key: str, version: Column, created: str, before: str, keep: int = 5, tie: list[Column] | None = None) -> DataFrame:
    """Versions beyond the newest ``keep`` of their key that are older than ``before``."""
    ranked = df.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(version.desc(), *(tie or []))))
    return ranked.filter((F.col("rn") > keep) & (F.col(created) < F.expr(f"TIMESTAMP_NTZ '{before}'")))


def priority_weight(column: Column, order: dict[str, int] | None = None) -> Column:
    order = order or PRIORITY
    weight = F.lit(max(order.values()) + 1)
    for name, n in order.items():
        weight = F.when(column == name, n).otherwise(weight)
    return weight


def queue(df: DataFrame, weight: Column, *order: Column, limit: int) -> DataFrame:
    """The next rows of a queue: a top-k, not a sort of the table."""
    return df.orderBy(weight, *order).limit(limit)


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page ``number`` (from 1) with the envelope: totalItems, totalPages, hasNext, hasPrev."""
    total = df.count()
    pages = math.ceil(total / size)
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.withColumns({"totalItems": F.lit(total), "totalPages": F.lit(pages), "hasNext": F.lit(number < pages), "hasPrev": F.lit(number > 1)})


def trailing(df: DataFrame, keys: list[str], id: str, at: str, span: int, value: Column, chunk: int) -> DataFrame:
    """(keys, ``id``, total, n): sum of ``value`` (a decimal) and number of the rows of equal keys from ``at`` - ``span`` to ``at``, both included.

    A difference of running sums at the two ends, so the work doesn't grow with
    the span. Running sums are taken within chunks of ``at`` (a whole number,
    such as microseconds) and over the chunks: no task orders all rows of a key.
    """
    ends = df.select(*keys, id, F.col(at).alias("_t"), F.lit(1).alias("_end"), value.alias("_v"), F.lit(1).alias("_n"))
    starts = df.select(*keys, id, (F.col(at) - span).alias("_t"), F.lit(0).alias("_end"), F.lit(0).cast(ends.schema["_v"].dataType).alias("_v"), F.lit(0).alias("_n"))
    both = ends.unionByName(starts).withColumn("_c", F.floor(F.col("_t") / chunk))
    near = W.partitionBy(*keys, "_c").orderBy("_t", "_end").rangeBetween(W.unboundedPreceding, W.currentRow)
    far = W.partitionBy(*keys).orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    sums = both.groupBy(*keys, "_c").agg(F.sum("_v").alias("_sv"), F.sum("_n").alias("_sn"))
    sums = sums.select(*keys, "_c", F.coalesce(F.sum("_sv").over(far), F.lit(0)).alias("_fv"), F.coalesce(F.sum("_sn").over(far), F.lit(0)).alias("_fn"))
    upto = both.withColumns({"_uv": F.sum("_v").over(near), "_un": F.sum("_n").over(near)}).join(sums, [*keys, "_c"])
    signed = lambda c: F.when(F.col("_end") == 1, c).otherwise(-c)
    return upto.groupBy(*keys, id).agg(F.sum(signed(F.col("_uv") + F.col("_fv"))).alias("total"), F.sum(signed(F.col("_un") + F.col("_fn"))).alias("n"))


def merge_hits(parts: list[DataFrame], distance: str, limit: int, *tie: Column) -> DataFrame:
    """Hits of several collections as one list by distance; an unknown distance counts as 1."""
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    return hits.orderBy(F.coalesce(F.col(distance), F.lit(1.0)), *tie).limit(limit)


def roll_back(history: DataFrame, targets: DataFrame, key: str, version: str) -> DataFrame:
    """History with a new version for each target (key, to): the payload of version ``to``, numbered after the last, with ``restored_from``.

    Nothing that is there changes. Targets that don't exist make no version; a
    key that is named several times is rolled back to the largest of its targets.
    """
    last = history.groupBy(key).agg(F.max(version).alias("_last"))
    to = targets.groupBy(F.col(key)).agg(F.max("to").alias("_to"))
    made = history.join(to, key).filter(F.col(version) == F.col("_to")).join(last, key)
    made = made.withColumn("restored_from", F.col(version)).withColumn(version, (F.col("_last") + 1).cast(history.schema[version].dataType)).drop("_to", "_last")
    return history.withColumn("restored_from", F.lit(None).cast(history.schema[version].dataType)).unionByName(made)


def insert_absent(target: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Rows that ON CONFLICT DO NOTHING would add: no key of the target, one row a key."""
    return latest(new.join(target.select(*keys), keys, "left_anti"), keys, *order).drop("rn")
