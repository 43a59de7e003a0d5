"""Stored tables: only touched buckets are rewritten, summaries follow their table."""

import random

import pytest
from pyspark.sql import functions as F

from skein.sources import payloads
from skein.sources.store import Conflict, Summary, Table

SCHEMA = "id long, tenant string, cost decimal(18,4), at long"


def table(spark, tmp_path, **options):
    return Table(spark, f"file://{tmp_path}/t", SCHEMA, ["id"], **options)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, c, a) for i, t, c, a in rows], "id long, tenant string, cost double, at long").withColumn("cost", F.col("cost").cast("decimal(18,4)"))


def rows_of(df):
    return sorted((r["id"] if r["id"] is not None else -1, r["tenant"], None if r["cost"] is None else float(r["cost"]), r["at"]) for r in df.collect())


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.version() == -1 and t.read().count() == 0
    first = [(i, f"t{i % 3}", float(i), 1) for i in range(200)]
    version, changes = t.upsert(frame(spark, first), "at")
    assert version == 0 and changes.count() == 200 and rows_of(t.read()) == sorted(first)
    before = {b: set(spark.read.parquet(f).inputFiles()) for b, f in t.manifest().items()}
    new = [(5, "t9", 50.0, 2), (6, "late", 1.0, 0), (1000, "t1", 1.0, 1)]
    version, changes = t.upsert(frame(spark, new), "at")
    touched = {r[0] for r in frame(spark, new).select(t.bucket()).collect()}
    after = {b: set(spark.read.parquet(f).inputFiles()) for b, f in t.manifest().items()}
    assert {int(b) for b in after if after[b] != before.get(b)} == touched and 0 < len(touched) < 16
    wanted = sorted([r for r in first if r[0] != 5] + [new[0], new[2]])  # an older row changes nothing
    assert rows_of(t.read()) == wanted
    assert sorted((r["id"], r["_sign"]) for r in changes.collect()) == [(5, -1), (5, 1), (1000, 1)]
    assert rows_of(t.read(0)) == sorted(first)  # the version before is still there
    old = payloads.upsert(frame(spark, first), frame(spark, new), "id", "at")
    assert rows_of(old) == wanted
    assert t.upsert(frame(spark, []), "at")[0] == 1  # nothing to do makes no version


def test_nulls_ties_repeats_and_deletes(spark, tmp_path):
    t = table(spark, tmp_path, buckets=4)
    t.upsert(frame(spark, [(None, "n", 1.0, 1), (1, "a", 1.0, None), (1, "b", 2.0, 5), (1, "c", 2.0, 5), (2, None, None, 1), (2, None, None, 1)]), "at")
    assert rows_of(t.read()) == [(-1, "n", 1.0, 1), (1, "b", 2.0, 5), (2, None, None, 1)]
    t.upsert(frame(spark, [(1, "again", 9.0, 5)]), "at")  # as late as the row that is there: that one stays
    assert rows_of(t.read())[1] == (1, "b", 2.0, 5)
    version, changes = t.delete(spark.createDataFrame([(2,), (None,), (77,)], "id long"))
    assert rows_of(t.read()) == [(1, "b", 2.0, 5)] and sorted(r["_sign"] for r in changes.collect()) == [-1, -1]
    t.delete(spark.createDataFrame([(1,)], "id long"))
    assert t.read().count() == 0
    assert t.vacuum(keep=1) and t.read().count() == 0


def test_second_writer_starts_again(spark, tmp_path):
    a, b = table(spark, tmp_path), table(spark, tmp_path)
    a.upsert(frame(spark, [(1, "a", 1.0, 1)]), "at")
    stale = iter([-1])
    real = b.version
    b.version = lambda: next(stale, real())
    version, _ = b.upsert(frame(spark, [(2, "b", 1.0, 1)]), "at")  # believes the table is new, loses, tries again
    assert version == 1 and rows_of(a.read()) == [(1, "a", 1.0, 1), (2, "b", 1.0, 1)]
    b.version = lambda: -1
    with pytest.raises(Conflict):
        b.upsert(frame(spark, [(3, "c", 1.0, 1)]), "at", tries=2)
    assert rows_of(a.read()) == [(1, "a", 1.0, 1), (2, "b", 1.0, 1)]


def test_summary_follows_upserts_and_deletes(spark, tmp_path):
    rng = random.Random(2)
    t = table(spark, tmp_path, buckets=5)
    s = Summary(spark, f"file://{tmp_path}/s", "tenant string", {"cost": "cost", "large": "CASE WHEN cost > 50 THEN cost END"}, buckets=3)

    def same():
        key = lambda df: sorted((r["tenant"] or "", r["n"], r["cost"], r["large"]) for r in df.collect())
        assert key(s.read()) == key(s.full(t.read()))

    for step in range(5):
        rows = [(rng.randrange(60), rng.choice(["x", "y", "z", None]), rng.choice([None, rng.randrange(1000) / 7]), step) for _ in range(20)]
        t.upsert(frame(spark, rows), "at")
        if step == 3:
            t.delete(t.read().filter("tenant = 'x'").select("id"))
        if step != 1:  # the changes of two versions at once
            s.refresh(t)
            same()
            assert s.upto() == t.version()
    version = s.table.version()
    s.refresh(t)
    assert s.table.version() == version  # nothing new, nothing written
    t.delete(t.read().select("id"))
    s.refresh(t)
    assert s.read().count() == 0
