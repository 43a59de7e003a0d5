"""Histories of requests in blocks against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import resolve, routing


def plain(rows):
    at, out = {}, {}
    for k, t, i, new in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        state, retries = at.get(k, ("SUBMITTED", 0))
        fails = (new or "").startswith("FAILED_")
        ok = new in routing.MOVES[state] and not (fails and retries >= 3)
        if ok:
            state, retries = new, retries + fails
        at[k] = state, retries
        out[i] = state, retries, ok
    return out


@pytest.mark.parametrize("blocks", [1, 3, 17])
def test_a_hot_key_in_many_blocks(spark, blocks):
    rng = random.Random(blocks)
    rows, at = [], {}
    for i in range(1500):
        k = 0 if rng.random() < 0.6 else rng.choice([None, 1, 2, 3])
        options = routing.MOVES[at.get(k, "SUBMITTED")] or ("QUEUED",)
        new = rng.choice(options) if rng.random() < 0.9 else rng.choice([*routing.STATES, "ODD", None])
        if new in options:
            at[k] = new
        rows.append((k, i // 3, i, new))
    df = spark.createDataFrame(rows, "k long, t long, i long, new string").withColumn("a.b", F.col("i")).withColumnRenamed("a.b", "extra").repartition(5)
    got = routing.run_moves(df, "k", "t", "i", blocks=blocks).collect()
    assert {r["i"]: (r["state"], r["retries"], r["ok"]) for r in got} == plain(rows)
    assert len(got) == len(rows) and all(r["extra"] == r["i"] and (r["k"], r["t"], r["new"]) == (rows[r["i"]][0], rows[r["i"]][1], rows[r["i"]][3]) for r in got)
    assert routing.run_moves(df.limit(0), "k", "t", "i").count() == 0


def test_references_follow_merges(spark):
    claims = spark.createDataFrame([("d", 1, ["a", "b", "a", None]), ("d", 2, []), ("e", 3, ["a"]), ("d", 4, None), (None, 5, ["a"])], "doc string, place int, ids array<string>")
    log = spark.createDataFrame([("d", "x", "a"), ("d", "z", "a"), ("f", "y", "a")], "doc string, target string, source string")
    got = {r["place"]: r["ids"] for r in resolve.rewrite_references(claims, log, "doc", "ids").collect()}
    assert got == {1: ["x", "b", "x", None], 2: [], 3: ["a"], 4: None, 5: ["a"]}
