"""Indexes and selections against plain versions."""

import random
from statistics import quantiles

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import search, selection, vector_index


@pytest.mark.parametrize("few", [1, 40, 100_000])
def test_exact_percentiles(spark, few):
    rng = random.Random(4)
    rows = [("a", rng.gauss(0, 1) * 10 ** rng.randint(-8, 8)) for _ in range(3000)]
    rows += [("b", float(i % 2)) for i in range(2000)]  # two values, half of the rows each
    rows += [("c", 7.0)] * 500 + [("d", 1.5), ("d", 2.5), ("e", None), (None, 3.0), (None, 5.0)]
    rows += [("f", float(rng.choice([0, 0, 0, 1, 2, 3, 1e9, -1e9]))) for _ in range(1500)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    shares = (0.0, 0.25, 0.5, 0.95, 1.0)
    got = {r["g"]: list(r)[1:] for r in selection.exact_percentiles(df, ["g"], "v", shares, few=few).collect()}
    wanted = {g: list(np.quantile([v for k, v in rows if k == g and v is not None], shares)) for g in ("a", "b", "c", "d", "f", None)}
    assert got.keys() == wanted.keys()
    for g, values in wanted.items():
        assert np.allclose(got[g], values, rtol=1e-12, atol=0), g
    assert quantiles([1.5, 2.5], n=4, method="inclusive")[1] == got["d"][2]


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert selection.exact_percentiles(df, ["g"], "v", (0.5,)).count() == 0
    one = spark.createDataFrame([(1,), (2,), (4,)], "v int")
    assert [tuple(r) for r in selection.exact_percentiles(one, [], "v", (0.5, 0.75)).collect()] == [(2.0, 3.0)]


def test_small_world_recall(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((40, 24))
    v = np.concatenate([centres[rng.integers(0, 40, 1500)] + 0.4 * rng.standard_normal((1500, 24)), rng.standard_normal((1500, 24))])
    rows = [(i, [float(np.float32(y)) for y in x]) for i, x in enumerate(v)]
    rows += [(5000, None), (5001, [0.0] * 24), (None, rows[0][1]), (5002, [float("nan")] * 24), (5003, rows[3][1])]
    df = spark.createDataFrame(rows, "id long, e array<float>").repartition(3)
    asked = df.filter("id % 50 = 0 OR id = 5003").select(F.col("id").alias("query"), F.col("e").alias("vector"))
    index = vector_index.build(df, "id", "e", shard_rows=1000)
    assert index.select("shard").distinct().count() == 4 and index.count() == 3001
    got = {(r["query"], r["key"]) for r in vector_index.search(index, asked, 10).collect()}
    wanted = {(r["query"], r["key"]) for r in vector_index.exact(df.filter("id < 5000 OR id = 5003"), asked.filter("query < 5000 OR query = 5003"), "id", "e", 10).collect()}
    assert len(wanted) == 610 and len(got & wanted) / len(wanted) >= 0.95
    assert len(got) == 610


def test_links_are_within_bounds():
    rng = np.random.default_rng(2)
    v = vector_index._matrix(pa.chunked_array([list(rng.standard_normal((300, 8)))]))
    links = vector_index.links_of(v, 16)
    assert links.shape == (300, 16) and links.max() < 300
    assert all(i not in row for i, row in enumerate(links.tolist()))
    assert vector_index.links_of(v[:1], 16).max() == -1
    for n in (1, 2, 5):
        rows, _ = vector_index.beam(v[:n], vector_index.links_of(v[:n], 16), v[:3], 10)
        assert [sorted(r[r >= 0]) for r in rows] == [list(range(n))] * 3


def test_graph_recall_on_the_tables(spark, data):
    from skein.registry import QUERIES

    found, exact = ({(r["query"], r["vec_id"]) for r in QUERIES[q](spark, data).collect()} for q in ("vs02_graph", "vs02_exact"))
    assert len(found) == len(exact) and len(found & exact) / len(exact) >= 0.9


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8])
def test_similar_pairs(spark, least):
    rng = random.Random(1)
    parts = ["siti", "nur", "haliza", "pocong", "hantu", "kuntilanak", "bali", "jawa", "a", ""]
    names = sorted({" ".join(rng.choice(parts) + rng.choice(["", "h", "x"]) for _ in range(rng.randint(1, 3))) for _ in range(150)} | {"", " ", "é中", "A", "aaaaaa"})
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(-1, None)], "k long, name string").repartition(3)

    def grams(n):
        p = "  " + n.lower() + " "
        return {p[i : i + 3] for i in range(len(p) - 2)}

    wanted = {}
    for i, x in enumerate(names):
        for j in range(i + 1, len(names)):
            a, b = grams(x), grams(names[j])
            if len(a & b) / len(a | b) >= least:
                wanted[i, j] = round(len(a & b) / len(a | b), 9)
    got = {(r["a"], r["b"]): round(r["score"], 9) for r in search.similar_pairs(df, "k", "name", least).collect()}
    assert got == wanted and wanted


def odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, [float(x) for x in rng.integers(-2, 3, 5)]) for i in range(80)]  # few different ones: many ties
    nan, inf = float("nan"), float("inf")
    rows += [(100, 0, None), (101, 0, [0.0] * 5), (102, 0, [1.0, None, 2.0, 0.0, 0.0]), (103, 0, [1.0, 2.0]), (104, 0, []), (105, 1, [nan] * 5), (106, 1, [inf, 1.0, 0.0, 0.0, 0.0])]
    rows += [(107, None, [1.0] * 5), (None, 0, [1.0] * 5), (3, 0, [2.0, 1.0, 0.0, 0.0, 1.0])]
    return spark.createDataFrame(rows, "k long, g int, v array<float>").repartition(3)


@pytest.mark.parametrize("block", [7, 4096])
def test_exact_scan_in_blocks(spark, block):
    """The blocks' result is that of one join of all rows, ties and odd vectors included."""
    rows = odd_vectors(spark).filter("k IS NOT NULL")
    asked = rows.filter("k % 4 = 0").select(F.col("k").alias("query"), F.col("v").alias("vector"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "key"))
    plain = rows.join(asked).select("query", F.col("k").alias("key"), search.cosine(F.col("v"), F.col("vector")).alias("score")).filter("score IS NOT NULL")
    wanted = plain.withColumn("rank", rank).filter("rank <= 10").select("query", "rank", "key", F.col("score").cast("string"))
    found = vector_index.exact(rows, asked, "k", "v", 10, block=block).select("query", "rank", "key", F.col("score").cast("string"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("block", [7, 1024])
def test_pair_scores_in_blocks(spark, block):
    rows = odd_vectors(spark)
    a, b = rows.select(F.col("k").alias("a"), "g", F.col("v").alias("x")), rows.select(F.col("k").alias("b"), "g", F.col("v").alias("y"))
    wanted = a.join(b, "g").filter("a < b").select("a", "b", F.round(search.cosine(F.col("x"), F.col("y")), 6).alias("score"))
    found = vector_index.pair_scores(rows, "k", "g", "v", 6, block=block)
    plain = lambda df: sorted((r["a"], r["b"], "" if r["score"] is None else str(r["score"] + 0.0)) for r in df.collect())
    assert plain(found) == plain(wanted)
    assert vector_index.pair_scores(rows.filter("k < 0"), "k", "g", "v").count() == 0
