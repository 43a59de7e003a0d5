"""Shared neighbours by ranges of sources, against pairs written down one by one."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from skein.operators import shared


def edges():
    draw = random.Random(8)
    rows = [(a, 0) for a in range(120)] + [(draw.randrange(-50, 70), draw.randrange(1, 30)) for _ in range(900)]
    rows += [(11, n) for n in range(30)] * 2 + [(draw.choice([5, 2**40, -(2**41), 2**61]), n) for n in range(60)]
    return rows


@pytest.mark.parametrize("pairs", [150, 3000, 10**9])
def test_counts_by_ranges(spark, pairs):
    """Few pairs a range: many ranges, and sources that are dealt out by their partners."""
    rows, want = edges(), Counter()
    for node in {n for _, n in rows}:
        want.update(combinations(sorted({a for a, n in rows if n == node}), 2))
    frame = spark.createDataFrame([*rows, (None, 0), (1, None)], "src long, dst long").repartition(3)
    got = [tuple(r) for r in shared.shared_neighbours(frame, pairs=pairs).collect()]
    assert len(got) == len(want) and {(a, b): n for a, b, n in got} == want
    assert {(r["a"], r["b"]) for r in shared.shared_neighbours(frame, least=3, pairs=pairs).collect()} == {p for p, n in want.items() if n >= 3}
    near: dict = {}
    for (a, b), n in want.items():
        near.setdefault(a, []).append((-n, b))
        near.setdefault(b, []).append((-n, a))
    top = {(a, b, -n) for a, found in near.items() for n, b in sorted(found)[:5]}
    assert {tuple(r) for r in shared.most_shared(frame, 5, pairs=pairs).collect()} == top
    assert shared.shared_neighbours(frame.filter("src = 0"), pairs=pairs).count() == 0


def test_a_source_of_many_pairs_is_dealt_out():
    lists = pa.RecordBatch.from_arrays([pa.array([[1, 5, 9, 2**40], [5, 6], [2, 3]], pa.list_(pa.int64()))], names=["near"])
    sent = pa.Table.from_batches(shared._send(np.array([3, 5]), np.array([1, 4]), True)([lists]))
    assert len(set(zip(sent["part"].to_pylist(), sent["share"].to_pylist(), strict=True))) > 4
    assert sent.nbytes < 400
    a, b = shared._pairs(sent, np.array([3, 5]), True)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted((x, y) for n in ([1, 5, 9, 2**40], [5, 6], [2, 3]) for x in n for y in n if x != y)


def test_pairs_are_not_shuffled(spark, data):
    """What the queries store and shuffle is lists: no exchange holds rows of pairs before they are counted."""
    import __spark_entry__

    for name in ("jn19_shared_neighbours", "gr04_two_hops"):
        plan = __spark_entry__.queries()[name](spark, data)._jdf.queryExecution().toString()
        assert "Join" not in plan and "FlatMapGroupsInArrow" in plan
