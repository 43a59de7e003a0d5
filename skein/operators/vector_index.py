"""Approximate nearest vectors by small-world graphs, one for each shard of bounded size.

A shard's graph is built once and stored: every vector points at diverse near
ones and is pointed at by them, which lets a beam walk from a few entries to the
neighbourhood of any query. Queries meet every shard, in batches that share a
beam search; the shards' best meet exactly. The index is a table, nothing of it is
held on the driver.
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

#: Vectors of a shard, candidates that a beam keeps, links of a vector, entries of a graph.
SHARD, EF, LINKS, ENTRIES = 4_096, 128, 64, 16
#: Of a vector's links, how many lead to far ones, drawn at random: they make the graph a small world.
FAR = 8
#: Queries that meet a shard in one task, and that share a beam search.
ASKED, BATCH = 8_192, 64


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors as rows."""
    lists = lists.combine_chunks()
    v = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    return v / np.sqrt((v * v).sum(1))[:, None]


def links_of(v: np.ndarray, links: int = LINKS) -> np.ndarray:
    """Each vector's links, -1 where there are fewer: of the nearest ones those that are nearer to it than to any link chosen before; some far ones; the links back, the nearest first."""
    n = len(v)
    many = min(2 * links, n - 1)
    out = np.full((n, links), -1, np.int64)
    if many < 1:
        return out
    half = max(1, links // 2)
    for at in range(0, n, 256):
        block = v[at : at + 256]
        score = block @ v.T
        score[np.arange(len(block)), np.arange(at, at + len(block))] = -2
        near = np.argpartition(-score, many - 1, 1)[:, :many]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(score, near, 1), 1, kind="stable"), 1)
        own = np.take_along_axis(score, near, 1)
        among = v[near] @ v[near].transpose(0, 2, 1)
        kept = np.zeros(near.shape, bool)
        for j in range(many):
            closer = (among[:, j] > own[:, j : j + 1]) & kept
            kept[:, j] = ~closer.any(1) & (kept.sum(1) < half)
        # the near ones that were passed over fill what is left of the half
        rank = np.argsort(~kept, 1, kind="stable")[:, :half]
        out[at : at + 256, : rank.shape[1]] = np.take_along_axis(near, rank, 1)
    far = min(FAR, half // 2)
    out[:, half - far : half] = (np.arange(n)[:, None] + 1 + np.random.default_rng(n).integers(0, n - 1, (n, far))) % n
    # each link once: of equal ones in a row the first, and none back where there is one forth
    order = np.argsort(out[:, :half], 1, kind="stable")
    line = np.take_along_axis(out[:, :half], order, 1)
    again = np.zeros(line.shape, bool)
    np.put_along_axis(again, order, np.hstack([np.zeros((n, 1), bool), line[:, 1:] == line[:, :-1]]), 1)
    out[:, :half][again] = -1
    src, dst = np.repeat(np.arange(n), half), out[:, :half].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    one_way = ~np.isin(dst * n + src, src * n + dst)
    src, dst = src[one_way], dst[one_way]
    order = np.lexsort((-(v[src] * v[dst]).sum(1), dst))  # links back
    src, dst = src[order], dst[order]
    place = np.arange(len(dst)) - np.searchsorted(dst, dst)
    fits = place < links - half
    out[dst[fits], half + place[fits]] = src[fits]
    return out


def beam(v: np.ndarray, links: np.ndarray, asked: np.ndarray, k: int, ef: int = EF, entries: int = ENTRIES) -> tuple[np.ndarray, np.ndarray]:
    """(rows, cosines) of the k best that a beam of ``ef`` finds for each query; -1 where there are fewer."""
    n, q = len(v), len(asked)
    ef = max(ef, k)
    start = np.unique(np.linspace(0, n - 1, min(entries, n)).astype(np.int64))
    found = np.full((q, ef), -1, np.int64)
    score = np.full((q, ef), -np.inf)
    done = np.zeros((q, ef), bool)
    seen = np.zeros((q, n), bool)
    many = min(len(start), ef)
    found[:, :many] = start[:many]
    score[:, :many] = asked @ v[start[:many]].T
    seen[:, start] = True
    rows = np.arange(q)
    while True:
        open_score = np.where(done | (found < 0), -np.inf, score)
        best = open_score.argmax(1)
        live = np.flatnonzero(open_score[rows, best] > -np.inf)
        if not len(live):
            break
        done[live, best[live]] = True
        near = links[found[live, best[live]]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        seen[live[:, None], np.where(near >= 0, near, start[0])] = True
        new = np.where(fresh, np.einsum("qd,qld->ql", asked[live], v[near]), -np.inf)
        every, scores, closed = np.hstack([found[live], np.where(fresh, near, -1)]), np.hstack([score[live], new]), np.hstack([done[live], np.zeros(near.shape, bool)])
        top = np.argpartition(-scores, ef - 1, 1)[:, :ef]
        found[live], score[live], done[live] = (np.take_along_axis(x, top, 1) for x in (every, scores, closed))
    order = np.argsort(-score, 1, kind="stable")[:, :k]
    return np.take_along_axis(found, order, 1), np.take_along_axis(score, order, 1)


def _build(group: pa.Table) -> pa.Table:
    group = group.sort_by("key")
    v = _matrix(group.column("vector"))
    return pa.table({"shard": group.column("shard"), "place": pa.array(np.arange(len(v))), "key": group.column("key"), "vector": group.column("vector"), "links": pa.array(list(links_of(v)), pa.list_(pa.int64()))})


def build(vectors: DataFrame, key: str, vector: str, shard_rows: int = SHARD) -> DataFrame:
    """The stored index (shard, place, key, vector, links) of all vectors of one length; null and zero ones and null keys are in no shard."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<float>").alias("vector"))
    rows = rows.filter("key IS NOT NULL AND vector IS NOT NULL AND exists(vector, x -> x <> 0) AND NOT exists(vector, x -> x IS NULL OR isnan(x))")
    shards = max(1, math.ceil(rows.count() / shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(shards)).cast("int"))
    return stored(dealt.groupBy("shard").applyInArrow(_build, "shard int, place long, key long, vector array<float>, links array<bigint>"), "graph")


def _search(k: int, ef: int):
    def run(shard: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if shard.num_rows and asked.num_rows:
            shard = shard.sort_by("place")
            v, keys = _matrix(shard.column("vector")), shard.column("key").to_numpy()
            links = pc.list_flatten(shard.column("links").combine_chunks()).to_numpy().reshape(len(v), -1)
            queries, q = asked.column("query").to_numpy(), _matrix(asked.column("vector"))
            for at in range(0, len(q), BATCH):
                rows, scores = beam(v, links, q[at : at + BATCH], k, ef)
                own = np.repeat(queries[at : at + BATCH], rows.shape[1])
                fits = rows.ravel() >= 0
                out.append((own[fits], keys[rows.ravel()[fits]], scores.ravel()[fits]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query": cols[0], "key": cols[1], "score": cols[2]})

    return run


def search(index: DataFrame, queries: DataFrame, k: int, ef: int = EF) -> DataFrame:
    """(query, rank, key, score): the k best of all shards for each query (query, vector); equal scores rank by key."""
    asked = queries.select(F.col("query").cast("long").alias("query"), F.col("vector").cast("array<float>").alias("vector"))
    asked = stored(asked.filter("vector IS NOT NULL AND exists(vector, x -> x <> 0) AND NOT exists(vector, x -> x IS NULL OR isnan(x))"), "queries")
    parts = max(1, math.ceil(asked.count() / ASKED))
    last = index.agg(F.max("shard")).first()[0] or 0
    held = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = asked.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last))))
    found = held.groupBy("shard", "part").cogroup(met.groupBy("shard", "part")).applyInArrow(_search(k, ef), "query long, key long, score double")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "key"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "rank", "key", "score")


def _padded(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of any lengths as rows, shorter ones filled up with zeros, and their lengths: -1 where there is none or a component is null."""
    lists = lists.combine_chunks()
    size = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    held = np.maximum(size, 0)
    row, flat = np.repeat(np.arange(len(size)), held), pc.list_flatten(lists)
    v = np.zeros((len(size), int(held.max(initial=0))))
    v[row, np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held)] = flat.to_numpy(zero_copy_only=False)
    if flat.null_count:
        size[row[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    return v, size


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, component by component in one order, so equal vectors have equal ones wherever they lie."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def _together(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same width for both."""
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


#: Scores of a matrix product may be off by the rounding of another order; what is decided within this is added again term by term.
SURE = 1e-9
#: Rows whose scores with a block are held at once.
STRIP = 256


def _scan(k: int):
    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        """A block of vectors and one of queries -> each query's k best of the block."""
        out = []
        if block.num_rows and asked.num_rows:
            (v, m), (q, n) = _padded(block.column("vector")), _padded(asked.column("_q"))
            v, q = _together(v, q)
            place = pc.rank(block.column("key").combine_chunks(), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
            long, wide = np.sqrt(_added(v, v)), np.sqrt(_added(q, q))
            for at in range(0, len(q), STRIP):
                s = slice(at, at + STRIP)
                size = wide[s, None] * long
                score = (q[s] @ v.T) / size
                score[np.isnan(score)] = np.inf  # as in an order of numbers, above all others
                score[(n[s, None] != m) | (m < 0) | (size == 0)] = -np.inf
                bar = np.partition(score, len(v) - k, 1)[:, len(v) - k] if len(v) > k else np.full(len(score), -np.inf)
                i, j = np.nonzero((score > -np.inf) & (score >= (bar - SURE)[:, None]))
                exact = _added(q[s][i], v[j]) / (wide[s][i] * long[j])
                order = np.lexsort((place[j], -np.where(np.isnan(exact), np.inf, exact), i))
                i, j, exact = i[order], j[order], exact[order]
                top = np.arange(len(i)) - np.searchsorted(i, i) < k
                out.append((at + i[top], j[top], exact[top]))
        i, j, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table([asked.column("query").take(pa.array(i)), block.column("key").take(pa.array(j)), pa.array(score)], names=["query", "key", "score"])

    return run


def exact(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = SHARD) -> DataFrame:
    """The same by a scan: every query against every vector, the yardstick of recall. Blocks of vectors meet blocks of queries; each meeting keeps k rows a query."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    asked = queries.select("query", F.col("vector").alias("_q"))
    many, parts = (max(1, math.ceil(df.count() / block)) for df in (rows, asked))
    deal = lambda n, *cols: F.pmod(F.xxhash64(F.lit(17), *cols), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumns({"i": deal(many, "key", "vector"), "j": each(parts)}).repartition(many * parts, "i", "j")
    right = asked.withColumns({"_j": deal(parts, "query", "_q"), "_i": each(many)}).repartition(many * parts, "_i", "_j")
    kinds = f"query {asked.schema['query'].dataType.simpleString()}, key {rows.schema['key'].dataType.simpleString()}, score double"
    found = left.groupBy("i", "j").cogroup(right.groupBy("_i", "_j")).applyInArrow(_scan(k), kinds)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "key"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "rank", "key", "score")


def _scores(digits: int):
    """Two blocks of a group -> the cosines of all their pairs, rounded; the smaller key first."""
    unit = 10.0**digits

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        same = left.column("i")[0] == left.column("j")[0]
        ka, kb = left.column("key").to_numpy(), right.column("_key").to_numpy()
        (a, m), (b, n) = _padded(left.column("vector")), _padded(right.column("_vector"))
        a, b = _together(a, b)
        long, wide = np.sqrt(_added(a, a)), np.sqrt(_added(b, b))
        i, j = np.nonzero(ka[:, None] < kb if same else ka[:, None] != kb)
        size = long[i] * wide[j]
        none = (m[i] != n[j]) | (m[i] < 0) | (size == 0)
        score = np.divide((a @ b.T)[i, j], size, out=np.zeros(len(i)), where=~none) * unit
        # where rounding turns, the order of adding could decide
        near = np.flatnonzero(np.abs(np.abs(score) % 1 - 0.5) < SURE * unit)
        score[near] = _added(a[i[near]], b[j[near]]) / np.where(none[near], 1, size[near]) * unit
        score = np.copysign(np.floor(np.abs(score) + 0.5), score) / unit
        first = ka[i] < kb[j]
        return pa.table({"a": np.where(first, ka[i], kb[j]), "b": np.where(first, kb[j], ka[i]), "score": pa.array(score, mask=none)})

    return run


def pair_scores(vectors: DataFrame, key: str, group: str, vector: str, digits: int = 6, block: int = 1024) -> DataFrame:
    """(a, b, score): the cosines of all pairs of a group's rows with different keys, a < b, rounded half away from zero.

    Blocks of a group meet in pairs, so its pairs come from many tasks and none
    holds more than those of two blocks. A score is null where a vector is null,
    has a null component, no length or another number of components. Rows
    without key or group pair with nothing.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(group).alias("group"), F.col(vector).alias("vector")).filter("key IS NOT NULL AND `group` IS NOT NULL")
    many = rows.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    meetings = many.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 1
    dealt = rows.join(many, "group").withColumn("own", F.pmod(F.xxhash64(F.lit(13), "key"), "blocks").cast("int"))
    left = dealt.select("group", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), "key", "vector")
    right = dealt.select(F.col("group").alias("_g"), F.explode(F.sequence(F.lit(0), "own")).alias("_i"), F.col("own").alias("_j"), F.col("key").alias("_key"), F.col("vector").alias("_vector"))
    # what comes out is far more than what goes in, so the number of tasks follows the meetings and not the bytes read
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(math.ceil(meetings / 2), 10_000))
    left, right = left.repartition(tasks, "group", "i", "j"), right.repartition(tasks, "_g", "_i", "_j")
    return left.groupBy("group", "i", "j").cogroup(right.groupBy("_g", "_i", "_j")).applyInArrow(_scores(digits), "a long, b long, score double")


def _pairs(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Two blocks of a group -> each row's k most similar of the other block."""
        out = []
        if left.num_rows and right.num_rows:
            a, b = _matrix(left.column("vector")), _matrix(right.column("_vector"))
            ka, kb = left.column("key").to_numpy(), right.column("_key").to_numpy()
            score = np.where(ka[:, None] == kb, -np.inf, a @ b.T)
            for i in range(len(ka)):
                best = np.lexsort((kb, -score[i]))[:k]
                best = best[score[i][best] > -np.inf]
                out.append((np.full(len(best), ka[i]), kb[best], score[i][best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"key": cols[0], "other": cols[1], "score": cols[2]})

    return run


def most_similar(vectors: DataFrame, key: str, group: str, vector: str, k: int, block: int = 1024) -> DataFrame:
    """(key, rank, other, score): each row's k most similar rows of its group, equal scores by key.

    A group's rows are dealt to blocks; two blocks meet in a task, which keeps k
    rows for each of its own, so no pair leaves a task that is not among these.
    Rows without key, group or direction are similar to nothing.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(group).alias("group"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.filter("key IS NOT NULL AND `group` IS NOT NULL AND vector IS NOT NULL AND exists(vector, x -> x <> 0) AND NOT exists(vector, x -> x IS NULL OR isnan(x))")
    many = rows.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = rows.join(many, "group").withColumn("own", F.pmod(F.xxhash64(F.lit(13), "key"), "blocks").cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = dealt.select("group", F.col("own").alias("i"), each.alias("j"), "key", "vector")
    right = dealt.select(F.col("group").alias("_g"), each.alias("_i"), F.col("own").alias("_j"), F.col("key").alias("_key"), F.col("vector").alias("_vector"))
    found = left.groupBy("group", "i", "j").cogroup(right.groupBy("_g", "_i", "_j")).applyInArrow(_pairs(k), "key long, other long, score double")
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.col("score").desc(), "other"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("key", "rank", "other", "score")
