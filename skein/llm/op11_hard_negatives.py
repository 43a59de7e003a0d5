"""Hard negatives: for each positive of an anchor the rows of other labels that score just below it.

Scores are integer inner products. Candidates lie in blocks; every anchor meets
every block and sorts all its scores there, by score and id. First the blocks'
best of the anchor's own label meet, which gives its positives; then each block
looks up, by binary search, where a positive's upper limit lies in the sorted
scores and reads the first rows of other labels from there on, down to the lower
limit. Blocks' few rows meet in the end, so a result is that of one sort of all
scores, and no task holds them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.common import cut, partitions, ship, table
from skein.llm.grid import held_block_rows, matrix, meet

#: Scale of components, positives of an anchor, negatives of a positive, least share (per cent) of the positive's score.
SCALE, POSITIVES, NEGATIVES, LEAST = 256, 5, 5, 80
#: Squared length of a vector of integers from which scores would no longer fit longs with a factor of 100.
TOO_LONG = 1 << 56
#: Up to this squared length, doubles hold all sums exactly.
EXACT = float(1 << 53)


def usable(vectors: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """(id, label, ints) of the rows that take part, each id once."""
    component = lambda x: x.cast("double")
    rows = vectors.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(component(x)) & (F.abs(component(x)) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & sound)
    whole = F.transform("v", lambda x: F.floor(component(x) * SCALE).cast("double"))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows = rows.select("id", "label", whole.alias("v"))
    checked = F.when(length < float(TOO_LONG), F.col("v")).otherwise(F.raise_error(F.concat(F.lit("components too large for integer scores: id "), F.col("id").cast("string"))))
    return rows.groupBy("id").agg(F.min(F.struct("label", checked.alias("v"))).alias("_r")).select("id", "_r.label", F.col("_r.v").alias("v"))


def _scores(block: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Integer inner products, asked x block: by doubles while these are exact."""
    most = max((block * block).sum(1).max(initial=0), (asked * asked).sum(1).max(initial=0))
    if most < EXACT:
        return (asked @ block.T).astype(np.int64)
    return asked.astype(np.int64) @ block.astype(np.int64).T


class _Held:
    """A block's rows by id, kept while its anchors pass."""

    def __init__(self, dim: int):
        self.dim, self.of = dim, None

    def load(self, block: pa.Table) -> None:
        if self.of is not block:
            self.of = block
            self.id, self.label = block.column("id").to_numpy(), block.column("label").to_numpy()
            self.v = matrix(block.column("v"), self.dim)
            self.step = max(1, (1 << 21) // max(len(self.id), 1))


def _positives(dim: int, k: int):
    held = _Held(dim)

    def run(block: pa.Table, own: pa.RecordBatch) -> pa.RecordBatch:
        """The block's k best rows of each anchor's label."""
        held.load(block)
        anchor, label, asked = own.column("id").to_numpy(), own.column("label").to_numpy(), matrix(own.column("v"), dim)
        out = []
        for name in np.unique(label):
            same, mine = np.flatnonzero(held.label == name), np.flatnonzero(label == name)
            for at in range(0, len(mine) if len(same) else 0, held.step):
                some = mine[at : at + held.step]
                for i, score in zip(some, _scores(held.v[same], asked[some]), strict=True):
                    other = np.flatnonzero(held.id[same] != anchor[i])
                    if len(other) > k:  # all that are not below the k-th best, ties included
                        bar = np.partition(score[other], len(other) - k)[len(other) - k]
                        other = other[score[other] >= bar]
                    best = other[np.lexsort((held.id[same][other], -score[other]))[:k]]
                    out.append((np.full(len(best), anchor[i]), held.id[same][best], score[best]))
        return _batch(out, ["anchor", "row", "score"])

    return run


def _negatives(dim: int, k: int, least: int):
    held = _Held(dim)

    def run(block: pa.Table, own: pa.RecordBatch) -> pa.RecordBatch:
        """For each anchor and positive the block's first k rows of other labels between the limits."""
        held.load(block)
        anchor, label, asked = own.column("id").to_numpy(), own.column("label").to_numpy(), matrix(own.column("v"), dim)
        found = own.column("positives").to_pylist()
        out = []
        for at in range(0, len(anchor), held.step):
            scores = _scores(held.v, asked[at : at + held.step])
            for i, score in enumerate(scores, at):
                order = np.lexsort((held.id, -score))
                order = order[held.label[order] != label[i]]
                fall = -score[order]  # ascending
                for p in found[i]:
                    first = int(np.searchsorted(fall, -p["score"], "left"))
                    rows = order[first : first + k]
                    rows = rows[100 * score[rows] >= least * p["score"]]
                    out.append((np.full(len(rows), anchor[i]), np.full(len(rows), p["row"]), np.full(len(rows), p["score"]), held.id[rows], score[rows]))
        return _batch(out, ["anchor", "positive", "positive_score", "row", "score"])

    return run


def _batch(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch | None:
    if not parts:
        return None
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts, strict=True)], names)


def mine(
    vectors: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, block_rows: int | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchors`` (a condition on ``id``) chooses.

    Null keys, labels and vectors and vectors with null or non-finite components
    take no part. Rows that repeat an id count once, the one of least label, then
    vector. Vectors of different length are compared as if the shorter one went
    on with zeros. Equal scores rank by id. A positive score below 0 has no
    negatives, as its lower limit is above it. Anchors without positives, and
    positives without negatives, have no rows. An empty table gives an empty
    result. Integers of 2**56 squared length and beyond raise an error. Other
    columns of vectors are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = cut(usable(vectors, key, vector, F.col(label) if isinstance(label, str) else label), "vectors")
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    n, dim = facts["n"], facts["dim"] or 0
    full = block_rows or held_block_rows(dim)
    blocks = max(math.ceil(n / full), min(partitions(spark), math.ceil(n / 1024)), 1)
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(blocks)).cast("long"))
    asked = rows.filter(anchors).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    first = meet(rows, asked, ["block"], _positives(dim, positives), "anchor long, row long, score long", "id")
    place = W.partitionBy("anchor").orderBy(F.col("score").desc(), "row")
    best = first.withColumn("_r", F.row_number().over(place)).filter(F.col("_r") <= positives)
    best = cut(best.groupBy("anchor").agg(F.collect_list(F.struct("row", "score")).alias("positives")), "positives")

    none = F.lit(None).cast(best.schema["positives"].dataType)
    second = meet(
        rows.withColumn("positives", none), asked.join(best, asked["id"] == best["anchor"]).drop("anchor"), ["block"], _negatives(dim, negatives, least),
        "anchor long, positive long, positive_score long, row long, score long", "id",
    )
    place = W.partitionBy("anchor", "positive").orderBy(F.col("score").desc(), "row")
    second = second.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= negatives)
    return second.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("row").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors, F.col("id") % 100 == 0, label=label)


ORACLE = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.id AS anchor_id, a.label = b.label AS same, b.id, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id
),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 5
"""
