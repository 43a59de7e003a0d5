"""Graph queries over whole tables: pairs by brute force, hot keys split into blocks."""

import random
from collections import Counter
from itertools import combinations

import pytest

import __spark_entry__  # noqa: F401  registers the queries
from skein.operators import graph
from skein.registry import QUERIES


def test_shared_neighbours_of_hot_nodes(spark):
    draw = random.Random(5)
    edges = [(a, 0) for a in range(90)] + [(draw.randrange(90), draw.randrange(1, 12)) for _ in range(400)] + [(3, 5)] * 3
    want = Counter()
    for node in range(12):
        want.update(combinations(sorted({a for a, b in edges if b == node}), 2))
    frame = spark.createDataFrame([*edges, (None, 0), (1, None)], "src long, dst long")
    for size in (7, 256):
        assert {(r["a"], r["b"]): r["shared"] for r in graph.shared_neighbours(frame, size=size).collect()} == want
    assert {(r["a"], r["b"]) for r in graph.shared_neighbours(frame, least=3, size=7).collect()} == {p for p, n in want.items() if n >= 3}


@pytest.fixture(scope="module")
def lines(spark, data):
    return {(r["l_suppkey"], r["l_partkey"]) for r in spark.read.parquet(f"{data}/lineitem.parquet").select("l_suppkey", "l_partkey").collect()}


def test_every_edge_counts(spark, data, lines):
    parts: dict = {}
    for a, p in lines:
        parts.setdefault(p, set()).add(a)
    assert max(parts) > 60
    degree = {r["src"]: r["degree"] for r in QUERIES["gr12_degrees"](spark, data).collect()}
    assert degree == Counter(a for a, _ in lines)
    hops = {(r["a"], r["b"]) for r in QUERIES["gr04_two_hops"](spark, data).collect()}
    both = {(a, b) for near in parts.values() for a in near for b in near if a != b}
    assert hops == both if len(parts) and max(Counter(a for a, _ in both).values()) <= 50 else hops <= both
    shared = Counter(p for near in parts.values() for p in combinations(sorted(near), 2))
    top = sorted(((-n, *p) for p, n in shared.items()))[:10]
    assert sorted((-r["shared"], r["a"], r["b"]) for r in QUERIES["gr08_similarity"](spark, data).collect()) == top
    near = {r["s_suppkey"]: r["near"] for r in QUERIES["gr03_neighbours"](spark, data).select("s_suppkey", "near").collect()}
    both = {(a, b) for x, y in lines for a, b in ((x, y), (y, x))}
    assert all(v == ",".join(map(str, sorted(b for a, b in both if a == k))) for k, v in near.items())


def test_whole_tables(spark, data, lines):
    """Pairs, edges and unions reach past the rows of the queries cut at small ids."""
    vectors = [(r["vec_id"], r["label"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "label").collect()]
    want = {(a, b) for a, k in vectors for b, m in vectors if k == m and a < b}
    assert {(r["a"], r["b"]) for r in QUERIES["gr13_vector_similarity"](spark, data).collect()} == want
    assert max(b for _, b in want) > 100
    orders: dict = {}
    for r in spark.read.parquet(f"{data}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct().collect():
        orders.setdefault(r[1], []).append(r[0])
    shared = Counter(p for near in orders.values() for p in combinations(sorted(near), 2))
    assert {(r["a"], r["b"]): r["shared"] for r in QUERIES["jn19_shared_neighbours"](spark, data).collect()} == shared
    both = lines | {(p, a) for a, p in lines}
    assert {(r["a"], r["b"]) for r in QUERIES["st01_union"](spark, data).collect()} == both


def test_story_edges_are_dealt_by_story(spark, data):
    """One shuffle of whole stories, none of single edges; shuffle files of what is stored are deleted, and the setting is as before."""
    from skein.storage import CLEANUP

    before = spark.conf.get(CLEANUP, None)
    plan = QUERIES["gr02_edges"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(story_id" in plan and "hashpartitioning(type" not in plan and "hashpartitioning(label" in plan
    assert spark.conf.get(CLEANUP, None) == before
