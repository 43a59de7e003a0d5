"""Mixing sources to target weights, all in DataFrame operations.

Targets: sources by code point (null last) weigh 1, 2, 3, repeating; they share
the words of all documents by weight, no source above ``max_epochs`` times its
own words, the excess going to the others by weight until none is above.

A source's target is so many whole passes (epochs) over its documents and a
rest. Each pass permutes the documents by a seeded hash and cuts the permuted
stream into blocks of about ``block_words``; the rest is a prefix of the last
pass's stream, its last document cut to the word. The blocks of all sources are
dealt to output shards by a multivariate-hypergeometric splitting tree: a node
that holds so many blocks of each source draws without replacement which of
them go left, and the halves are split on until a node is one shard. Within its
source, a shard gets the next blocks of a seeded permutation, so shards are
disjoint; inside a shard, documents are ordered by a seeded hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.common import cut, packed, partitions, quoted, small_join, table, unit, word_count

MAX_EPOCHS = 3
WEIGHTS = 3
#: Words of a block, and how many blocks a mix has about at most: beyond, blocks grow.
BLOCK_WORDS = 20_000
BLOCKS = 200_000
#: Words of a shard about, and of a slice of one that a task shuffles; the least number of shards.
SHARD_WORDS, SLICE_WORDS, SHARDS = 64_000_000, 1_000_000, 16
SEED = 9
#: Rows that one sorted run of a permuted stream holds about.
RUN_ROWS = 1_000


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS, weights: int = WEIGHTS) -> DataFrame:
    """(source, source_size, docs) -> the same with weight and target.

    The level at which capped and free sources meet is found in one pass over
    the sources ordered by cap / weight: the first k sources are capped when the
    level that the others would get still exceeds the k-th one's own limit.
    One row for each source; the windows run over that table only.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    df = sizes.withColumn("weight", (F.row_number().over(order) - 1) % weights + 1)
    df = df.withColumn("cap", (F.lit(max_epochs) * F.col("source_size")).cast("double"))
    by_limit = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = W.partitionBy(F.lit(0))
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumns(
        {
            "_total": F.sum("source_size").over(every).cast("double"),
            "_weights": F.sum("weight").over(every),
            "_caps": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "_gone": F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    # the level if this source and all after it stay free; the first that isn't above its limit holds
    level = (F.col("_total") - F.col("_caps")) / (F.col("_weights") - F.col("_gone"))
    df = df.withColumn("_level", F.when(level * F.col("weight") <= F.col("cap"), level))
    df = df.withColumn("_level", F.max("_level").over(every))  # levels fall from the first that holds on
    free = F.coalesce(F.col("_level") * F.col("weight"), F.col("cap"))
    return df.withColumn("target", F.least(F.col("cap"), free)).select("source", "source_size", "docs", "weight", "target")


def _split(counts: Column, room: Column, seed: Column) -> Column:
    """Draw ``room`` blocks without replacement from ``counts``: how many of each source.

    One draw after another: block i of source s goes left with probability
    (room left) / (blocks left), which makes the counts multivariate
    hypergeometric exactly.
    """
    start = F.struct(
        F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x).alias("left"),
        room.cast("long").alias("room"),
        F.array().cast("array<bigint>").alias("got"),
    )

    def source(state: Column, count: Column) -> Column:
        begin = F.struct(state["left"].alias("left"), state["room"].alias("room"), F.lit(0).cast("long").alias("x"))
        draws = F.when(count > 0, F.sequence(F.lit(1).cast("long"), count)).otherwise(F.array().cast("array<bigint>"))

        def draw(s: Column, i: Column) -> Column:
            hit = (unit(seed, F.size(state["got"]), i, seed=SEED) * s["left"] < s["room"]).cast("long")
            return F.struct((s["left"] - 1).alias("left"), (s["room"] - hit).alias("room"), (s["x"] + hit).alias("x"))

        done = F.aggregate(draws, begin, draw)
        return F.struct(done["left"].alias("left"), done["room"].alias("room"), F.concat(state["got"], F.array(done["x"])).alias("got"))

    return F.aggregate(counts, start, source, lambda s: s["got"])


def splitting_tree(blocks: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(source, blocks) -> (source, shard, first, last): ranks [first, last) of the source's blocks."""
    root = blocks.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("none"), "source", "blocks"))).alias("all"))
    nodes = root.select(
        F.col("all.source").alias("sources"), F.col("all.blocks").alias("counts"),
        F.lit(0).alias("shard"), F.lit(shards).alias("width"),
    )
    for _ in range(max(0, math.ceil(math.log2(shards)))):
        half = F.floor(F.col("width") / 2).cast("int")
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
        room = F.floor(total * half / F.col("width"))
        key = F.xxhash64(F.lit(seed), "shard", "width")
        nodes = nodes.withColumn("_half", half).withColumn("_go", F.when(half > 0, _split(F.col("counts"), room, key)))
        halves = F.array(
            F.struct(F.col("_go").alias("counts"), F.col("shard").alias("shard"), F.col("_half").alias("width")),
            F.struct(
                F.when(F.col("_half") > 0, F.zip_with("counts", "_go", lambda a, b: a - b)).otherwise(F.col("counts")).alias("counts"),
                (F.col("shard") + F.col("_half")).alias("shard"), (F.col("width") - F.col("_half")).alias("width"),
            ),
        )
        nodes = nodes.select("sources", F.explode(halves).alias("n")).filter("n.width > 0").select("sources", "n.counts", "n.shard", "n.width")
        nodes = cut(nodes, "tree")  # the draws of a level are made once
    dealt = nodes.select("shard", F.explode(F.arrays_zip("sources", "counts")).alias("c"))
    dealt = dealt.select("shard", F.col("c.sources").alias("source"), F.col("c.counts").alias("n"))
    upto = W.partitionBy("source").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    dealt = dealt.withColumn("first", F.coalesce(F.sum("n").over(upto), F.lit(0).cast("long")))
    return dealt.filter("n > 0").select("source", "shard", "first", (F.col("first") + F.col("n")).alias("last"))


def shards_of(words: int) -> int:
    return max(SHARDS, math.ceil(words / SHARD_WORDS))


def mix(docs: DataFrame, size: str = "size", source: str = "source", key: str = "doc_id", shards: int | None = None,
        block_words: int | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """-> (rows of the mix, sources with their targets).

    Mix rows: ``_row`` (all columns of ``docs``), epoch, take (words of this
    copy that the mix takes, at most its size), shard, place (order within the
    shard). Null sources are one source, ordered last. Documents without words
    are taken in every epoch of a source that has a target, with 0 words.
    Repeated rows are documents of their own. An empty table gives an empty mix.
    The same rows and seed give the same mix.
    """
    spark = docs.sparkSession
    # rows without a key are told apart by the number that the caller stored, if any: they lie in different runs
    number = F.when(F.col(key).isNull(), F.col(row)) if row else F.lit(0)
    keyed = docs.select(packed(docs).alias("_row"), F.col(source).alias("source"), F.xxhash64(F.col(key), number).alias("_key"), F.col(size).cast("long").alias("_size"))
    sizes = keyed.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("docs"))
    plan = cut(targets(sizes, max_epochs), "targets")
    facts = plan.agg(F.count("*").alias("sources"), F.max("docs").alias("docs"), F.sum("source_size").alias("words")).first()
    block_words = block_words or max(BLOCK_WORDS, math.ceil((facts["words"] or 0) / BLOCKS))
    runs = max(1, math.ceil((facts["docs"] or 0) / RUN_ROWS))
    shards = shards or shards_of(facts["words"] or 0)
    plan = plan.withColumns(
        {
            "_full": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"),
            "_rest": F.when(F.col("source_size") > 0, F.round(F.pmod("target", "source_size"))).otherwise(0).cast("long"),
        }
    )
    some = F.col("_full") + F.when(F.col("_rest") > 0, 1).otherwise(0)
    kept = plan.filter(some > 0).select(F.col("source").alias("_s"), "source_size", "_full", "_rest", some.alias("_epochs"))
    joined = small_join(keyed, kept, F.col("source").eqNullSafe(F.col("_s")), rows=facts["sources"])
    copies = joined.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_epochs") - 1)))
    order = F.xxhash64(F.lit(seed), "epoch", "source", "_key")
    copies = copies.withColumn("_order", order)
    # the permuted stream in runs by the hash's range: no window holds a whole source
    copies = copies.withColumn("_run", F.floor((F.col("_order").cast("double") / 2.0**64 + 0.5) * runs))
    per_run = copies.groupBy("source", "epoch", "_run").agg(F.sum("_size").alias("words"))
    ahead = W.partitionBy("source", "epoch").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_run.select(
        F.col("source").alias("_os"), F.col("epoch").alias("_oe"), F.col("_run").alias("_or"),
        F.coalesce(F.sum("words").over(ahead), F.lit(0).cast("long")).alias("_base"),
    )
    upto = W.partitionBy("source", "epoch", "_run").orderBy("_order", "_size").rowsBetween(W.unboundedPreceding, 0)
    placed = copies.withColumn("_end", F.sum("_size").over(upto))
    same = F.col("source").eqNullSafe(F.col("_os")) & (F.col("epoch") == F.col("_oe")) & (F.col("_run") == F.col("_or"))
    placed = small_join(placed, offsets, same, rows=facts["sources"] * (max_epochs + 1) * runs)
    placed = placed.withColumn("_start", F.col("_base") + F.col("_end") - F.col("_size"))
    quota = F.when(F.col("epoch") < F.col("_full"), F.col("source_size")).otherwise(F.col("_rest"))
    placed = placed.withColumn("take", F.least(F.col("_size"), F.greatest(F.lit(0).cast("long"), quota - F.col("_start"))))
    placed = placed.filter((F.col("take") > 0) | ((F.col("_size") == 0) & (F.col("_start") < quota)))
    placed = placed.withColumn("_block", F.floor(F.col("_start") / block_words))

    # blocks of a source: those of its whole passes, then those of the rest
    whole = F.ceil(F.col("source_size") / block_words)
    blocks = plan.select("source", (F.col("_full") * whole + F.ceil(F.col("_rest") / block_words)).cast("long").alias("blocks"))
    ranges = splitting_tree(blocks.filter("blocks > 0"), shards, seed)
    # the source's blocks in a seeded order, and so the shard of each
    units = plan.select(
        "source", "source_size", "_rest",
        F.explode(F.when(some > 0, F.sequence(F.lit(0), some - 1)).otherwise(F.array().cast("array<int>"))).alias("epoch"), "_full",
    )
    words = F.when(F.col("epoch") < F.col("_full"), F.col("source_size")).otherwise(F.col("_rest"))
    units = units.select("source", "epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(words / block_words) - 1)).alias("_block"))
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "source", "epoch", "_block"), "epoch", "_block")) - 1
    units = units.withColumn("_rank", rank).withColumnRenamed("source", "_us")
    ranged = units.join(
        ranges.withColumnRenamed("source", "_rs"),
        F.col("_us").eqNullSafe(F.col("_rs")) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("last")),
    ).select("_us", F.col("epoch").alias("_ue"), F.col("_block").alias("_ub"), "shard")
    dealt = cut(ranged, "blocks")
    hit = F.col("source").eqNullSafe(F.col("_us")) & (F.col("epoch") == F.col("_ue")) & (F.col("_block") == F.col("_ub"))
    out = small_join(placed, dealt, hit)
    place = F.xxhash64(F.lit(seed + 2), "shard", "epoch", "source", "_key")
    return out.select("_row", "epoch", "take", "shard", place.alias("place")), plan.select("source", "source_size", "weight", "target")


def mixed_documents(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The mix as documents: columns of ``docs``, a row for each copy, shards in local shuffled order.

    A copy of which the mix takes a part keeps that many words from its start.
    """
    sized = docs.select(packed(docs).alias("_doc"), F.col(quoted(how.pop("source", "source"))).alias("source"), F.col(quoted(how.pop("key", "doc_id"))).alias("doc_id"), word_count(F.col(quoted(text))).alias("size"))
    rows, plan = mix(sized, **how)
    words = plan.agg(F.sum("source_size")).first()[0] or 0
    shards = how.get("shards") or shards_of(words)
    slices = max(1, math.ceil(words / shards / SLICE_WORDS))  # tasks grow with the words, as do shards
    rows = rows.repartition(max(partitions(docs.sparkSession), shards * slices), "shard", F.pmod("place", F.lit(max(64, slices)))).sortWithinPartitions("shard", "place")
    body = F.col("_row._doc").getField(text)
    pieces = F.split(body, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")  # a word and the space after it
    lead = F.when(F.regexp_like(body, F.lit(r"^[\x20\x09-\x0D]")), 1).otherwise(0)
    part = F.array_join(F.slice(pieces, F.lit(1), (F.col("take") + lead).cast("int")), "")
    cut_text = F.when(F.col("take") < F.col("_row.size"), part).otherwise(body)
    return rows.select(*[(cut_text.alias(c) if c == text else F.col("_row._doc").getField(c).alias(c)) for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # a number for each row, stored: repeated doc_ids stay documents of their own
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("uid")), "sizes")
    rows, plan = mix(sized, row="uid")
    taken = rows.groupBy(F.col("_row.uid").alias("uid")).agg(F.sum("take").alias("_taken"))
    facts = plan.select(F.col("source").alias("_s"), "source_size", "target")
    out = small_join(sized.join(taken, "uid", "left"), facts, F.col("source").eqNullSafe(F.col("_s")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))
