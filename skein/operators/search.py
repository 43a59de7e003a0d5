"""Keyword, vector and hybrid search as joins and aggregates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Share of the vector score in a hybrid search unless the caller says otherwise.
ALPHA = 0.75


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similarities(vectors: DataFrame, query: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, score) of all vectors to the one of ``query``, a frame of one row (or none: then there is nothing to compare)."""
    one = query.select(F.col(vector).alias("_q")).limit(1)
    return vectors.join(F.broadcast(one)).select(key, cosine(F.col(vector), F.col("_q")).alias("score"))


def nearest_to(vectors: DataFrame, query: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """The k most similar vectors to that of ``query``: a scan and a top-k."""
    return similarities(vectors, query, key, vector).orderBy(F.col("score").desc(), key).limit(k)


def _signatures(vector: Column, planes: int, bits: int, dim: int, seed: int) -> Column:
    """For each of several tables of random planes, the table's number and on which sides the vector lies."""

    normals = np.random.default_rng(seed).standard_normal((planes, bits, dim))

    def side(table: int, bit: int) -> Column:
        return F.when(dot(vector, F.array(*[F.lit(float(x)) for x in normals[table, bit]])) >= 0, 1 << bit).otherwise(0)

    return F.array(*[F.struct(F.lit(p).alias("table"), sum((side(p, b) for b in range(1, bits)), side(p, 0)).alias("code")) for p in range(planes)])


def approximate_nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, dim: int, planes: int = 32, bits: int = 5, seed: int = 17) -> DataFrame:
    """(query, key, score): the k best of the vectors that share a bucket of random planes with a query, scored exactly.

    queries: (query, ``vector``). More planes find more, more bits look at less.
    A bucket is a join key; a query meets a vector once, however many buckets
    they share.
    """
    own = vectors.select(key, F.col(vector).alias("_v"), F.explode(_signatures(F.col(vector), planes, bits, dim, seed)).alias("_s"))
    asked = queries.select("query", F.col(vector).alias("_q"), F.explode(_signatures(F.col(vector), planes, bits, dim, seed)).alias("_s"))
    met = own.select(key, "_s").join(asked.select("query", "_s"), "_s").select("query", key).distinct()
    scored = met.join(vectors.select(key, F.col(vector).alias("_v")), key).join(queries.select("query", F.col(vector).alias("_q")), "query")
    scored = scored.select("query", key, cosine(F.col("_v"), F.col("_q")).alias("score"))
    return scored.withColumn("_r", F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), key))).filter(F.col("_r") <= k).drop("_r")


def postings(docs: DataFrame, key: str, words: Column, stop: tuple[str, ...] = ()) -> DataFrame:
    """(term, key, tf, length) of every document."""
    flat = docs.select(key, F.explode(words).alias("term")).filter(~F.col("term").isin(*stop) if stop else F.lit(True))
    tf = flat.groupBy(key, "term").agg(F.count("*").alias("tf"))
    size = docs.select(F.col(key), F.size(words).alias("length"))
    return tf.join(size, key)


def bm25(docs: DataFrame, key: str, words: Column, query: list[str]) -> DataFrame:
    """(key, score) of documents that have a query term. Only postings of query terms are counted."""
    sized = docs.select(key, words.alias("_w")).select(key, F.size("_w").alias("length"), F.filter("_w", lambda w: w.isin(*query)).alias("hits"))
    facts = sized.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    tf = sized.filter(F.size("hits") > 0).select(key, "length", F.explode("hits").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(float(facts["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(facts["mean"] or 1))))
    return tf.join(F.broadcast(df), "term").groupBy(key).agg(F.sum(idf * part).alias("score"))


def _scaled(hits: DataFrame, key: str, name: str) -> DataFrame:
    """Scores divided by the largest; that is one row, which is broadcast."""
    top = hits.agg(F.max("score").alias("_top"))
    return hits.select(key, "score").join(F.broadcast(top)).select(key, F.try_divide("score", "_top").alias(name))


def hybrid(vector: DataFrame, keyword: DataFrame, key: str, alpha: float | None = None) -> DataFrame:
    """alpha * vector + (1 - alpha) * keyword, each divided by its largest score; without alpha the default, 0 is a valid one."""
    alpha = ALPHA if alpha is None else alpha
    both = _scaled(vector, key, "v").join(_scaled(keyword, key, "k"), key, "full")
    return both.select(key, (alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.coalesce("k", F.lit(0.0))).alias("score"))


#: Weights of relevance factors, the caller's to change: text and meaning most, popularity least.
FACTORS = {"text": 0.25, "semantic": 0.25, "relationship": 0.15, "evidence": 0.15, "review": 0.1, "popularity": 0.03, "freshness": 0.07}


def relevance(factors: DataFrame, key: str, weights: dict[str, float] | None = None) -> DataFrame:
    """(key, relevance): factors between 0 and 1, weighed; a row's unknown factors leave their weight to the others."""
    got, held = F.lit(0.0), F.lit(0.0)
    for name, weight in (weights or FACTORS).items():
        clamped = F.when(F.col(name) > 1, 1.0).when(F.col(name) > 0, F.col(name)).otherwise(0.0)
        got = got + clamped * weight
        held = held + F.when(F.col(name).isNotNull(), weight).otherwise(0.0)
    return factors.select(key, F.coalesce(F.try_divide(got, held), F.lit(0.0)).alias("relevance"))


def freshness(at: Column, now: Column, half_life_days: int = 180) -> Column:
    """1 for what is new, halved with every half-life."""
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), F.date_diff(now, at)) / float(half_life_days))


def trigrams(text: Column) -> Column:
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def similar_names(df: DataFrame, name: str, query: str, least: float) -> DataFrame:
    a, b = trigrams(F.col(name)), trigrams(F.lit(query))
    score = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return df.withColumn("score", score).filter(F.col("score") >= least)


def gram_index(names: DataFrame, key: str, name: str) -> DataFrame:
    """(key, gram, place, size): the trigrams of each name, the rarest of all first. Null names have none; a key is one name."""
    grams = names.filter(F.col(name).isNotNull()).select(key, F.explode(trigrams(F.col(name))).alias("gram"))
    known = grams.groupBy("gram").agg(F.count("*").alias("_df"))
    order = W.partitionBy(key).orderBy("_df", "gram")
    sized = grams.join(known, "gram").withColumn("place", F.row_number().over(order))
    return sized.withColumn("size", F.count("*").over(W.partitionBy(key))).drop("_df")


def similar_pairs(names: DataFrame, key: str, name: str, least: float, parts: int = 64) -> DataFrame:
    """(a, b, score), a < b: all pairs of names whose trigram sets have a Jaccard similarity of ``least`` or more.

    Two such names share a gram among the first ``size - ceil(least * size) + 1``
    of each, rarest first, and their sizes differ by no more than the factor
    ``least``; only postings under these bounds meet. How much two names can still
    share after the grams at which they met bounds a pair once more. Postings of
    a frequent gram are dealt to blocks, so they meet in many tasks. What is left
    is scored by the sets themselves. Keys are those of distinct names: give a
    class of equal names one key.
    """
    from skein.operators.graph import pairs_within

    grams = gram_index(names, key, name)
    first = grams.filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * least) + 1).select(F.col(key).alias("_id"), "gram", "place", "size")
    met = pairs_within(first, "gram", "_id", 4096 // max(1, math.isqrt(parts)))
    x, y = F.col("_x"), F.col("_y")
    able = F.least(x["size"], y["size"]) >= least * F.greatest(x["size"], y["size"])
    # grams before the common one are not shared, if this is the first common one; the bound holds for that meeting
    left = F.least(x["size"] - x["place"], y["size"] - y["place"]) + 1
    reach = left * (1 + least) >= least * (x["size"] + y["size"])
    pairs = met.groupBy(x["_id"].alias("a"), y["_id"].alias("b")).agg(F.max(able & reach).alias("_able")).filter("_able").select("a", "b")
    sets = names.filter(F.col(name).isNotNull()).select(F.col(key).alias("_k"), trigrams(F.col(name)).alias("_g"))
    scored = pairs.join(sets.withColumnsRenamed({"_k": "a", "_g": "_ga"}), "a").join(sets.withColumnsRenamed({"_k": "b", "_g": "_gb"}), "b")
    both = F.size(F.array_intersect("_ga", "_gb"))
    return scored.withColumn("score", both / (F.size("_ga") + F.size("_gb") - both)).filter(F.col("score") >= least).select("a", "b", "score")


#: Weights of a hit in title, summary and content.
BOOSTS = (2.0, 1.5, 1.0)


def boosted(fields: list[Column], words: list[str], boosts: tuple[float, ...] = BOOSTS) -> Column:
    """The weighed sum of the fields' own scores: how often the words occur in a field, by its number of words; empty and null fields score nothing."""
    score = F.lit(0.0)
    for field, boost in zip(fields, boosts, strict=True):
        held = F.filter(F.split(F.lower(F.coalesce(field, F.lit(""))), r"\s+"), lambda w: w != "")
        hits = F.size(F.filter(held, lambda w: w.isin(*[x.lower() for x in words])))
        score = score + boost * F.coalesce(F.try_divide(hits.cast("double"), F.size(held)), F.lit(0.0))
    return score


def reembedding(embeddings: DataFrame, kind: str, model: str, current: str, old: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings (kind, model, current) that an old model made and that are current -> the work list, and (kind, pending, complete) for every kind.

    The migration of a kind is complete once none is left.
    """
    open_ = F.coalesce((F.col(model) == old) & F.col(current), F.lit(False))
    done = embeddings.groupBy(kind).agg(F.count_if(open_).alias("pending")).withColumn("complete", F.col("pending") == 0)
    return embeddings.filter(open_), done
