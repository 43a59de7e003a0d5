"""Blocked comparisons: a block of rows is held while others stream past it.

A task of a product of blocks reads the rows of one key after the other, those
to be held first. Only one block of held rows and one batch of the others are in
memory, however many meet it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import partitions

#: Vector components of a held block, and of what is compared with it at once.
HELD_CELLS = 1 << 22


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones are filled up with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == len(sizes) * dim and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def held_block_rows(dim: int) -> int:
    return max(256, min(65_536, HELD_CELLS // max(dim, 1)))


def meet(held: DataFrame, passing: DataFrame, keys: list[str], run: Callable[[pa.Table, pa.RecordBatch], pa.RecordBatch | None], schema: str, order: str) -> DataFrame:
    """Every batch of ``passing`` rows together with all ``held`` rows of its key (both frames have the same columns).

    The rows of a key come to one task, sorted by ``order``; the caller's keys
    bound how many are held.
    """
    both = held.withColumn("_passing", F.lit(False)).unionByName(passing.withColumn("_passing", F.lit(True)))
    near = both.repartition(partitions(held.sparkSession), *keys).sortWithinPartitions(*keys, "_passing", order)
    return near.mapInArrow(_blocks(keys, run), schema)


def _blocks(keys: list[str], run: Callable):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block = None, [], None
        for batch in batches:
            many = batch.num_rows
            if not many:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            passing = batch.column("_passing").to_numpy(zero_copy_only=False).astype(bool)
            change = np.zeros(many, bool)
            change[0] = True
            for c in (*columns, passing):
                change[1:] |= c[1:] != c[:-1]
            edges = np.append(np.flatnonzero(change), many)
            for a, e in zip(edges, edges[1:], strict=False):
                key = tuple(int(c[a]) for c in columns)
                if key != now:
                    now, parts, block = key, [], None
                own = batch.slice(a, e - a)
                if not passing[a]:
                    parts.append(own)
                elif parts:
                    block = block or pa.Table.from_batches(parts).combine_chunks()
                    out = run(block, own)
                    if out is not None and out.num_rows:
                        yield out

    return go
