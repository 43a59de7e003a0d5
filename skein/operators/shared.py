"""Sources that point at the same nodes, counted by ranges of sources.

Writing down every pair that meets at a node, to count it elsewhere, takes many
times the space of the edges. Here a node's sources are one sorted list, and the
list goes, as differences, to each range of sources that it has some of; the
pairs exist only within the task that counts a range. Ranges are cut so that each
has about the same number of pairs; a source with more than that is dealt out by
its partners. Where near sources point at near nodes a list goes to few ranges;
at worst it goes to as many as it has sources, which is a list for an edge.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.storage import ship, stored

#: Pairs that a range is cut for, and rows of the sample, drawn by pairs, that a range's bounds come from. They balance tasks; every row is counted.
PAIRS, DRAWN = 4_000_000, 200
#: Ranges at most; beyond, they grow.
RANGES = 10_000
WIDTHS = (np.uint16, np.uint32, np.uint64)
SENT = "part int, share int, low long, first int, many int, width int, steps binary"


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... ``size[0]`` of them, then those from first[1] on, ..."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(8)


def _send(bounds: np.ndarray, shares: np.ndarray, both: bool):
    """Sorted lists -> for each range that a list has sources of: these and their partners. ``shares`` is over 1 for bounds that are sources of many ranges' pairs."""

    def table(part, share, low, first, many, place, size, step):
        """Messages by the width that their steps need; place: where the first of each message's steps is."""
        most = np.zeros(len(part), np.int64)
        held = np.flatnonzero(size)
        every = step[_spread(place, size)]
        if len(held):
            most[held] = np.maximum.reduceat(every, (np.cumsum(size) - size)[held])
        width = (most >= 1 << 16).astype(int) + (most >= 1 << 32)
        for w, kind in enumerate(WIDTHS):
            own = np.flatnonzero(width == w)
            if len(own):
                data = every[np.repeat(width == w, size)].astype(kind)
                edges = np.concatenate([[0], np.cumsum(size[own])]) * kind().itemsize
                steps = pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
                cols = [pa.array(c[own].astype(t)) for c, t in ((part, np.int32), (share, np.int32), (low, np.int64), (first, np.int32), (many, np.int32))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(own), w, np.int32)), steps], names=["part", "share", "low", "first", "many", "width", "steps"])

    def run(batches):
        for batch in batches:
            size = pc.list_value_length(batch.column(0)).to_numpy().astype(np.int64)
            s = pc.list_flatten(batch.column(0)).to_numpy()
            if not len(s):
                continue
            row = np.repeat(np.arange(len(size)), size)
            step = np.diff(s, prepend=s[:1])
            at = np.searchsorted(bounds, s)
            near = np.minimum(at, len(bounds) - 1)
            hot = (bounds[near] == s) & (shares[near] > 1) if len(bounds) else np.zeros(len(s), bool)
            # a source of its own has the number after those of the ranges
            part = np.where(hot, len(bounds) + 1 + at, at)
            begin = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (row[1:] != row[:-1])))
            end = np.append(begin[1:], len(s))
            start, stop = (np.cumsum(size) - size)[row[begin]], np.cumsum(size)[row[begin]]
            plain = ~hot[begin]
            x, y, o, e = begin[plain], end[plain], start[plain], stop[plain]
            from_ = o if both else x
            yield from table(part[x], np.zeros(len(x), int), s[from_], x - from_, y - x, from_ + 1, e - from_ - 1, step)
            for b, o, e in zip(begin[~plain], start[~plain], stop[~plain], strict=True):
                others = np.delete(s[o:e], b - o) if both else s[b + 1 : e]
                deal = _mixed(others) % np.uint64(shares[at[b]])
                for q in np.unique(deal):
                    own = others[deal == q]
                    yield from table(np.array([part[b]]), np.array([q]), own[:1], np.array([0]), np.array([-1]), np.array([1]), np.array([len(own) - 1]), np.diff(own, prepend=own[:1]))

    return run


def _pairs(group: pa.Table, bounds: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a range's messages."""
    a, b = [], []
    for w, kind in enumerate(WIDTHS):
        own = group.filter(pc.equal(group.column("width"), w))
        if not own.num_rows:
            continue
        part, low, first, many = (own.column(c).to_numpy() for c in ("part", "low", "first", "many"))
        steps = np.concatenate([np.frombuffer(x.as_buffer(), kind) for c in own.column("steps").chunks for x in c]).astype(np.int64)
        size = pc.binary_length(own.column("steps")).to_numpy().astype(np.int64) // kind().itemsize + 1
        start = np.cumsum(size) - size
        value = np.zeros(int(size.sum()), np.int64)
        value[start] = low
        value[_spread(start + 1, size - 1)] = steps
        value = np.cumsum(value)
        value -= np.repeat(value[start] - low, size)
        alone = many < 0
        a.append(np.repeat(bounds[part[alone] - len(bounds) - 1], size[alone]))
        b.append(value[_spread(start[alone], size[alone])])
        start, size, first, many = (c[~alone] for c in (start, size, first, many))
        mine = _spread(start + first, many)
        begin, end = np.repeat(start, many), np.repeat(start + size, many)
        begin = begin if both else mine + 1
        to = _spread(begin, end - begin)
        of = np.repeat(mine, end - begin)
        if both:
            of, to = of[of != to], to[of != to]
        a.append(value[of])
        b.append(value[to])
    return np.concatenate(a), np.concatenate(b)


def _count(bounds: np.ndarray, both: bool, least: int, k: int | None):
    def run(group: pa.Table) -> pa.Table:
        a, b = _pairs(group, bounds, both)
        if len(a):
            low, wide = int(b.min()), int(b.max()) - int(b.min()) + 1
            base = int(a.min())
            if (int(a.max()) - base + 1) * wide < 1 << 62:
                code, n = np.unique((a - base) * wide + (b - low), return_counts=True)
                a, b = code // wide + base, code % wide + low
            else:
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
                a, b, n = a[at], b[at], np.diff(np.append(at, len(a)))
            a, b, n = (c[n >= least] for c in (a, b, n))
            if k is not None:
                order = np.lexsort((b, -n, a))
                a, b, n = a[order], b[order], n[order]
                top = np.arange(len(a)) - np.searchsorted(a, a) < k
                a, b, n = a[top], b[top], n[top]
        else:
            n = a
        return pa.table({"a": a, "b": b, "shared": pa.array(n, pa.int64())})

    return run


def _shared(edges: DataFrame, both: bool, least: int, k: int | None, pairs: int) -> DataFrame:
    spark = edges.sparkSession
    ship(spark)
    kind = edges.schema["src"].dataType.simpleString()
    rows = edges.select(F.col("src").cast("long").alias("src"), "dst").filter("src IS NOT NULL AND dst IS NOT NULL").repartition("dst").distinct()
    lists = stored(rows.groupBy("dst").agg(F.sort_array(F.collect_list("src")).alias("near")).filter("size(near) > 1").select("near"), "near")
    total = lists.agg(F.sum(F.size("near").cast("long") * F.size("near"))).first()[0] or 0
    ranges = min(max(1, math.ceil(total / pairs)), RANGES)
    bounds, shares = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if ranges > 1:
        often = F.size("near") * F.lit(ranges * DRAWN / total) + F.pmod(F.xxhash64("src", F.size("near")), F.lit(1 << 20)) / F.lit(1 << 20)
        drawn = lists.select("near", F.explode("near").alias("src")).select(F.explode(F.array_repeat("src", F.floor(often).cast("int"))).alias("src"))
        cuts = drawn.agg(F.percentile_approx("src", [i / ranges for i in range(1, ranges)], ranges * 20)).first()[0] or []
        bounds, shares = np.unique(np.array(cuts, np.int64), return_counts=True)
        shares = np.where(shares > 2, shares, 1)
    sent = lists.mapInArrow(_send(bounds, shares, both), SENT).repartition(max(ranges, int(spark.conf.get("spark.sql.shuffle.partitions"))), "part", "share")
    found = sent.groupBy("part", "share").applyInArrow(_count(bounds, both, least, k), "a long, b long, shared long")
    return found.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "shared")


def shared_neighbours(edges: DataFrame, least: int = 1, pairs: int = PAIRS) -> DataFrame:
    """(a, b, shared) of sources, whole numbers, that point at the same nodes, a < b."""
    return _shared(edges, False, least, None, pairs)


def most_shared(edges: DataFrame, k: int, pairs: int = PAIRS) -> DataFrame:
    """(a, b, shared): for each source the k others with the most nodes in common, equal ones by their number."""
    found = _shared(edges, True, 1, k, pairs)
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.col("shared").desc(), "b"))
    return found.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")
