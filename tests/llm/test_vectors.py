"""Hard negatives and vector near-duplicates against plain versions."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import op11_hard_negatives as negatives
from skein.llm import op12_vector_dedup as op12

VECTORS = "vec_id long, embedding array<float>, label int, `a.b` int, id long, v long, block long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], VECTORS).repartition(3)


def odd_rows():
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8)], int(rng.integers(0, 3))) for i in range(300)]
    for i in range(300, 340):  # ties: copies of one vector
        rows.append((i, rows[7][1], i % 3))
    nan, inf = float("nan"), float("inf")
    rows += [(400, None, 1), (500, [1.0] * 8, None), (600, [nan] + [1.0] * 7, 1), (700, [inf] + [1.0] * 7, 1), (800, [None] + [1.0] * 7, 1), (None, [1.0] * 8, 1)]
    rows += [(900, [0.5, 0.25], 1), (901, [], 0), (902, [0.0] * 8, 2), (902, [0.0] * 8, 2), (1000, [-1.0] * 8, 7)]
    return rows


def plain_negatives(rows):
    kept = {}
    for key, v, label in rows:
        if key is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept[key] = (label, np.array([int(np.floor(256 * x)) for x in v] + [0] * (8 - len(v)), object))
    out = set()
    for a, (label, v) in kept.items():
        if a % 100:
            continue
        scored = sorted((-int(v @ w), k, m) for k, (m, w) in kept.items() if k != a)
        for s, p, m in [x for x in scored if x[2] == label][:5]:
            found = [(k, -t) for t, k, m in scored if m != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out |= {(a, p, r, k, -s, t) for r, (k, t) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("block_rows", [None, 37])
def test_hard_negatives(spark, block_rows):
    rows = odd_rows()
    got = negatives.mine(frame(spark, rows), F.col("id") % 100 == 0, block_rows=block_rows).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == plain_negatives(rows)


def test_hard_negatives_empty_and_large(spark):
    assert negatives.mine(frame(spark, []), F.col("id") % 100 == 0).count() == 0
    large = [(i, [float(1 << 17) * (1 + i % 5), 3.0], i % 2) for i in range(0, 60)]  # longer than doubles hold exactly
    got = negatives.mine(frame(spark, large), F.col("id") % 20 == 0)
    scores = {(r["anchor_id"], r["negative_id"]): r["negative_score"] for r in got.collect()}
    assert scores and all(s == 256 * 256 * ((1 << 34) * (1 + a % 5) * (1 + b % 5) + 9) for (a, b), s in scores.items())


def test_hard_negatives_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    df = negatives.op11_hard_negatives(spark, data)
    twin = con.execute(negatives.ORACLE)
    names = [c[0] for c in twin.description]
    found = twin.fetchall()
    assert len(found) > 20 and sorted(map(tuple, df.select(*names).collect())) == sorted(found)


def plain_links(rows, least=0.93):
    able = [i for i, (_, v, label) in enumerate(rows) if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    dim = max((len(rows[i][1]) for i in able), default=0)
    unit = np.array([np.pad(np.array(rows[i][1], float), (0, dim - len(rows[i][1]))) for i in able]).reshape(len(able), dim)
    unit /= np.sqrt((unit * unit).sum(1))[:, None]
    label = np.array([rows[i][2] for i in able])
    linked = (unit @ unit.T >= least) & (label[:, None] == label)
    np.fill_diagonal(linked, False)
    links, root = [0] * len(rows), list(range(len(rows)))
    for a, i in enumerate(able):
        links[i] = int(linked[a].sum())

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in np.argwhere(linked):
        x, y = top(able[a]), top(able[b])
        root[max(x, y)] = min(x, y)
    return links, [top(i) for i in range(len(rows))]


def test_vector_dedup_whole(spark):
    """With a recall of 1 every cell that can hold a link is visited: equal to brute force, dense spots and odd rows included."""
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(16)
        for _ in range(1 + 12 * (c % 4)):
            rows.append((len(rows), [float(np.float32(x)) for x in centre + 0.15 * rng.standard_normal(16)], c % 3))
    centre = rng.standard_normal(16)
    for _ in range(300):  # a dense spot and what lies around it
        rows.append((len(rows), [float(np.float32(x)) for x in centre + rng.choice([0.05, 0.2, 0.35]) * rng.standard_normal(16)], 1))
    rows += [(i, v, label) for i, v, label in odd_rows() if i is None or i >= 400]
    rows += [(2000, rows[0][1], 0), (2000, rows[0][1], 0), (2001, [2 * x for x in rows[0][1]], 0), (2002, rows[0][1], None), (2003, rows[0][1][:3], 0), (None, rows[0][1], 0)]
    out = op12.dedup(frame(spark, [(k, v, label) for k, v, label in rows]).withColumn("at", F.lit(0)), recall=1.0)
    assert set(out.columns) == {"vec_id", "embedding", "label", "a.b", "id", "v", "block", "at", "n_links", "component_id", "kept"}
    links, top = plain_links(rows)
    name = {t: min((rows[i][0] for i in range(len(rows)) if top[i] == t and rows[i][0] is not None), default=None) for t in top}
    wanted = sorted((repr(k), links[i], repr(name[top[i]])) for i, (k, _, _) in enumerate(rows))
    got = out.collect()
    assert sorted((repr(r["vec_id"]), r["n_links"], repr(r["component_id"])) for r in got) == wanted
    assert all(r["kept"] == (r["component_id"] is None or r["vec_id"] == r["component_id"]) for r in got)
    assert max(links) > 150


def test_vector_dedup_recall(spark, data):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    links, top = plain_links(rows)
    got = {r["vec_id"]: r for r in op12.op12_vector_dedup(spark, data).collect()}
    assert len(got) == len(rows)
    assert sum(got[k]["n_links"] for k, _, _ in rows) >= 0.9 * sum(links)
    assert all(got[k]["n_links"] <= n for (k, _, _), n in zip(rows, links, strict=True))


def test_visits_reach_the_hardest_partners():
    """Random vectors, partners at exactly the least cosine: the visits find the share that was asked for."""
    rng = np.random.default_rng(1)
    v = op12._unit(rng.standard_normal((4000, 32)))
    index = op12.fit(v, np.full(len(v), "a"), 200_000, 0.93, 0.95)
    assert 1 < index.visits < len(index.words[0]) ** 2 / 2
    x = op12._unit(rng.standard_normal((1000, 32)))
    aside = rng.standard_normal(x.shape)
    aside = op12._unit(aside - (aside * x).sum(1)[:, None] * x)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * aside
    assert (index.order(x) == index.order(y)[:, :1]).any(1).mean() >= 0.9
    d = index.distances(x[:50])
    for i, cells in enumerate(index.order(x[:50])):
        every = (d[0][i][:, None] + d[1][i]).ravel()
        assert np.allclose(every[cells], np.sort(every)[: index.visits])


def test_vector_dedup_empty(spark):
    assert op12.dedup(frame(spark, [])).count() == 0
    got = op12.dedup(frame(spark, [(1, None, 1), (None, [0.0], 2)])).collect()
    assert sorted((repr(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in got) == [("1", 0, 1, True), ("None", 0, None, True)]
