"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of a vector, form a grid of cells; every vector
is kept in the cell of its two nearest words. As a query it visits cells in
multi-sequence order, by the sum of the squared distances of its halves to the
two words, as many as bring the target recall. That number is measured: partners
made at exactly the least similarity, the hardest to find, from a bounded sample.
Every meeting is then verified by the cosine of whole vectors in double precision.

Dense spots hold many alike vectors whose pairs are all links. Vectors within half
the linking distance of a spot's centre link with each other for certain, so they
are counted, not compared; all others are verified, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import cut, packed, quoted, ship, small_join, table
from skein.llm.components import connected_components
from skein.llm.grid import held_block_rows, matrix, meet

#: Least cosine of a link.
LEAST = 0.93
#: Share of partners at the least cosine that the visits of one side must find.
RECALL = 0.98
#: Vectors on which words and visits are fitted, and partners made for the latter.
SAMPLE, PARTNERS = 16_384, 1_000
#: Vectors of a cell on average, and most words of a codebook.
CELL_ROWS, MOST_WORDS = 2_048, 1_024
#: Vectors of the sample that make a dense spot.
DENSE = 32
#: Rows of passing vectors to one block and task.
PASSING = 65_536


@dataclass(frozen=True)
class Index:
    """Words of both halves, cells that a query visits, dense spots (centre, label, radius)."""

    split: int
    words: tuple[np.ndarray, np.ndarray]
    visits: int
    spots: np.ndarray
    spot_label: np.ndarray
    radius: float

    def distances(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _squared(v[:, : self.split], self.words[0]), _squared(v[:, self.split :], self.words[1])

    def order(self, v: np.ndarray) -> np.ndarray:
        """The cells that each vector visits, the nearest first: multi-sequence order, ties by place."""
        d = self.distances(v)
        near = [np.argsort(x, 1, kind="stable")[:, : self.visits] for x in d]
        low = [np.take_along_axis(x, o, 1) for x, o in zip(d, near, strict=True)]
        # a cell with i words before its own on one side and j on the other comes after (i + 1) * (j + 1) - 1 others
        i, j = np.divmod(np.arange(near[0].shape[1] * near[1].shape[1]), near[1].shape[1])
        able = (i + 1) * (j + 1) <= self.visits
        i, j = i[able], j[able]
        first = np.argsort(low[0][:, i] + low[1][:, j], 1, kind="stable")[:, : self.visits]
        return np.take_along_axis(near[0][:, i], first, 1) * len(self.words[1]) + np.take_along_axis(near[1][:, j], first, 1)

    def spot(self, v: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The dense spot of its label in whose radius a vector lies, the nearest one; -1 without any."""
        out = np.full(len(v), -1, np.int64)
        for name in np.unique(self.spot_label):
            own, mine = np.flatnonzero(self.spot_label == name), np.flatnonzero(label == name)
            if len(mine):
                d = _squared(v[mine], self.spots[own])
                best = d.argmin(1)
                out[mine] = np.where(d[np.arange(len(mine)), best] <= self.radius**2, own[best], -1)
        return out


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1), 0)


def _unit(v: np.ndarray) -> np.ndarray:
    """Vectors of length 1, scaled first so that no square overflows or vanishes."""
    v = v / np.abs(v).max(1, initial=0)[:, None].clip(np.finfo(float).tiny)
    return v / np.sqrt((v * v).sum(1))[:, None].clip(np.finfo(float).tiny)


def _codebook(v: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    words = v[rng.choice(len(v), k, replace=len(v) < k)]
    for _ in range(rounds):
        own = _squared(v, words).argmin(1)
        many = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, v[:, c], k) for c in range(v.shape[1])], 1) if v.shape[1] else words
        words = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], words)
    return words


def _spots(v: np.ndarray, label: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres with DENSE or more of the sample's vectors of one label in the radius, the densest first, each vector in one."""
    centres, names = [], []
    for name in np.unique(label):
        own = v[label == name]
        many = np.concatenate([(_squared(own[i : i + 1024], own) <= radius**2).sum(1) for i in range(0, len(own), 1024)])
        free = np.ones(len(own), bool)
        for i in np.argsort(-many, kind="stable"):
            if many[i] < DENSE:
                break
            if not free[i]:
                continue
            near = free & (_squared(own[i : i + 1], own)[0] <= radius**2)
            centre = own[near].mean(0)
            near = free & (_squared(centre[None], own)[0] <= radius**2)
            if near.sum() >= DENSE:
                centres.append(centre)
                names.append(name)
                free &= ~near
    return np.array(centres).reshape(len(centres), v.shape[1]), np.array(names)


def fit(v: np.ndarray, label: np.ndarray, n: int, least: float, recall: float, seed: int = 7) -> Index:
    """An index for n rows from a sample of unit vectors."""
    rng = np.random.default_rng(seed)
    k = max(4, min(MOST_WORDS, len(v), math.ceil(math.sqrt(n / CELL_ROWS))))
    split = v.shape[1] // 2
    words = (_codebook(v[:, :split], k, rng), _codebook(v[:, split:], k, rng))
    radius = math.sqrt(2 - 2 * least) / 2 - 1e-6
    spots, names = _spots(v, label, radius)
    index = Index(split, words, k * k, spots, names, radius)
    x = v[rng.choice(len(v), min(PARTNERS, len(v)), replace=False)]
    aside = rng.standard_normal(x.shape)
    aside = _unit(aside - (aside * x).sum(1)[:, None] * x)
    y = index.distances(least * x + math.sqrt(max(0.0, 1 - least * least)) * aside)
    rank = np.zeros(len(x), np.int64)
    for i, (a, b) in enumerate(zip(*index.distances(x), strict=True)):
        rank[i] = (a[:, None] + b < a[y[0][i].argmin()] + b[y[1][i].argmin()]).sum()
    visits = int(np.sort(rank)[min(len(x) - 1, math.ceil(recall * len(x)) - 1)]) + 1
    return Index(split, words, visits, spots, names, radius)


def _assign(sent, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                own = batch.slice(at, 1024)
                v = _unit(matrix(own.column("v"), dim))
                cells = index.order(v).astype(np.int64)
                spot = index.spot(v, np.array(own.column("label").to_pylist(), object).astype(str))
                flat = pa.ListArray.from_arrays(np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32), cells.ravel())
                yield pa.RecordBatch.from_arrays([own.column(c) for c in ("row", "label", "v")] + [pa.array(cells[:, 0]), pa.array(spot), flat], ["row", "label", "v", "cell", "spot", "visits"])

    return run


def _joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least vertex of each component of a block's links a-b over vertices 0..n-1."""
    top = np.arange(n)
    while True:
        low = np.minimum(top[a], top[b])
        new = top.copy()
        np.minimum.at(new, top[a], low)
        np.minimum.at(new, top[b], low)
        new = np.minimum(new, new[new])
        if (new == top).all():
            return top
        top = new


def _verify(dim: int, least: float):
    state: dict = {"of": None}

    def run(block: pa.Table, own: pa.RecordBatch) -> pa.RecordBatch | None:
        """A block of a cell's vectors against vectors that visit the cell: (row, links, joined: a row of the same component).

        A pair is counted once: where both visit each other's cell, in the task in
        which the passing row is the smaller one. Pairs in one dense spot are
        counted elsewhere.
        """
        if state["of"] is not block:
            state.update(of=block, v=_unit(matrix(block.column("v"), dim)), row=block.column("row").to_numpy(), visits=_table(block.column("visits")))
        row, visits = state["row"], state["visits"]
        out = []
        for at in range(0, own.num_rows, 1024):
            some = own.slice(at, 1024)
            mine, home = some.column("row").to_numpy(), some.column("cell").to_numpy()
            cells, which = np.unique(home, return_inverse=True)
            back = np.stack([(visits == c).any(1) for c in cells])[which]  # does the held row visit the passing one's cell
            met = (_unit(matrix(some.column("v"), dim)) @ state["v"].T >= least) & (~back | (mine[:, None] < row))
            i, j = np.nonzero(met)
            if not len(i):
                continue
            # vertices: passing rows, then held ones; a row of both kinds is joined through its number
            label = _joined(i, len(mine) + j, len(mine) + len(row))
            every = np.concatenate([mine, row])
            links = np.concatenate([np.bincount(i, minlength=len(mine)), np.bincount(j, minlength=len(row))])
            hit = links > 0
            out.append((every[hit], links[hit], every[label[hit]]))
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], ["row", "links", "joined"])

    return run


def _table(lists) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return pc.list_flatten(lists).to_numpy().reshape(len(lists), -1)


def dedup(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """The columns of vectors with n_links, component_id and kept.

    Rows link if their labels are equal and not null and their cosine is at least
    ``least``. Vectors that are null, zero or hold null or non-finite components
    link with nothing, nor do rows without a label. Each row counts as a vector of
    its own, rows that repeat an id or a vector too. A null key names no component:
    such a row links as others do, and its component is named by the least key
    that there is; without one it has none, and is kept. Vectors of different
    length are compared as if the shorter one went on with zeros. An empty table
    gives an empty result. Columns of the new names are replaced, others are kept
    whatever their names.
    """
    spark = vectors.sparkSession
    ship(spark)
    new = ("n_links", "component_id", "kept")
    component = lambda x: x.cast("double")
    v = vectors[quoted(vector)]
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(component(x)) & (F.abs(component(x)) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(packed(vectors).alias("_rest"), F.coalesce(sound & vectors[quoted(label)].isNotNull(), F.lit(False)).alias("_able"))
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    able = rows.filter("_able").select(F.col("_row").alias("row"), F.col("_rest")[label].cast("string").alias("label"), F.col("_rest")[vector].alias("v"))
    facts = able.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    n, dim = facts["n"], facts["dim"] or 0
    links = _links(able, n, dim, least, recall) if n else None
    if links is None:
        found = rows.select("_rest", "_row").withColumns({"_links": F.lit(None).cast("long"), "_comp": F.lit(None).cast("long")})
    else:
        counts, edges = links
        comps = connected_components(edges, "row", "joined").select(F.col("k").alias("_row"), F.col("comp").alias("_comp"))
        found = rows.select("_rest", "_row").join(counts.select(F.col("row").alias("_row"), F.col("links").alias("_links")), "_row", "left").join(comps, "_row", "left")
    found = cut(found.withColumn("_comp", F.coalesce("_comp", "_row")), "found")
    name = F.col("_rest")[key]
    least_key = found.groupBy("_comp").agg(F.min(name).alias("_name"))
    out = found.join(least_key, "_comp")
    kept = [F.col("_rest")[c].alias(c) for c in vectors.columns if c not in new]
    return out.select(*kept, F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.col("_name").alias("component_id"), F.coalesce(name == F.col("_name"), F.col("_name").isNull()).alias("kept"))


def _links(able: DataFrame, n: int, dim: int, least: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(row, links) of rows that have any, and edges (row, joined) that hold each component together."""
    spark = able.sparkSession
    some = able.orderBy(F.xxhash64(F.lit(12), "row"), "row").limit(SAMPLE).toArrow()
    index = fit(_unit(matrix(some.column("v"), dim)), np.array(some.column("label").to_pylist(), object).astype(str), n, least, recall)
    sent = spark.sparkContext.broadcast(index)  # at most MOST_WORDS words and SAMPLE / DENSE spots
    kind = able.schema["v"].dataType.simpleString()
    placed = cut(able.mapInArrow(_assign(sent, dim), f"row long, label string, v {kind}, cell long, spot long, visits array<long>"), "placed")

    # groups of rows to be held: a label's cell, its dense spots apart; in blocks
    full = held_block_rows(dim)
    groups = cut(
        placed.groupBy("label", "cell", "spot").agg(F.count("*").alias("many")).withColumn("blocks", F.ceil(F.col("many") / full)).withColumn("group", F.monotonically_increasing_id()),
        "groups",
    )
    of = ["row", "v", "cell", "visits", "group", "block", "split"]
    visitors = placed.select("label", F.explode("visits").alias("at")).groupBy("label", "at").agg(F.count("*").alias("visitors"))
    met = groups.select("label", F.col("cell").alias("at"), F.col("spot").alias("_spot"), "group", "blocks").join(visitors, ["label", "at"])
    met = cut(met.withColumn("splits", F.ceil(F.col("visitors") / PASSING)), "met")
    many = met.count()
    seen = placed.select("row", "label", "v", "cell", "spot", "visits", F.explode("visits").alias("at"))
    passing = small_join(seen, met, ["label", "at"], rows=many).filter("spot < 0 OR spot <> _spot")
    passing = passing.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("split", F.pmod(F.xxhash64(F.lit(2), "row"), "splits"))
    held = small_join(placed, met.select("label", F.col("at").alias("cell"), F.col("_spot").alias("spot"), "group", "blocks", "splits"), ["label", "cell", "spot"], rows=many)
    held = held.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "row"), "blocks")).withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)))
    found = meet(held.select(of), passing.select(of), ["group", "block", "split"], _verify(dim, least), "row long, links long, joined long", "row")
    found = cut(found.groupBy("row", "joined").agg(F.sum("links").alias("links")), "links")

    # a dense spot: every row links with every other, joined through its smallest row
    dense = placed.filter("spot >= 0").groupBy("spot").agg(F.count("*").alias("many"), F.min("row").alias("joined"))
    dense = placed.filter("spot >= 0").select("row", "spot").join(F.broadcast(dense), "spot").select("row", (F.col("many") - 1).alias("links"), "joined")  # SAMPLE / DENSE spots at most
    every = found.select("row", "links", "joined").unionByName(dense)
    return every.groupBy("row").agg(F.sum("links").alias("links")), every.select("row", "joined")


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")
