"""Walks of any depth: roots by pointer doubling, reach under rules about labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.storage import stored


def roots(parents: DataFrame) -> DataFrame:
    """(node, root, level, cycle): where following parents ends and after how many steps, in as many joins as the logarithm of the depth.

    parents: (node, parent), a node once; a null parent, or one that is no node,
    ends the walk. Every round a pointer is replaced by that of the node it
    points to, so it spans twice the steps. A pointer that still moves when it
    spans more steps than there are nodes goes round in a circle: such nodes
    have no root and no level, and ``cycle`` is the smallest node of the circle.
    A node that is its own parent is a circle.
    """
    ends = parents.filter("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct().join(parents.select("node"), "node", "left_anti").withColumn("parent", F.lit(None).cast(parents.schema["parent"].dataType))
    base = parents.select("node", "parent").unionByName(ends)
    up = F.coalesce("parent", "node")
    # up: where the pointer is; steps: how many it spans; least: the smallest node from here on up to it, without it
    now = stored(base.select("node", up.alias("up"), F.col("parent").isNotNull().cast("long").alias("steps"), F.col("parent").isNotNull().alias("moves"), F.col("node").alias("least")), "pointers")
    count, span = now.count(), 1
    while span <= count:
        far = now.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"), F.col("moves").alias("_moves"), F.col("least").alias("_least"))
        # those that have come to an end stay as they are and are not shuffled again
        going = now.filter("moves").join(far, "up").select("node", F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_moves").alias("moves"), F.least("least", "_least").alias("least"))
        now = stored(going.unionByName(now.filter("NOT moves")), "pointers")
        span *= 2
        if now.filter("moves").isEmpty():
            break
    circle = now.filter("moves").select(F.col("node").alias("up"), F.col("least").alias("cycle"))
    named = now.join(circle, "up", "left")  # what the pointer has come to lies on the circle, and its own pointer went all the way round
    return named.select("node", F.when(~F.col("moves"), F.col("up")).alias("root"), F.when(~F.col("moves"), F.col("steps")).alias("level"), F.when(F.col("moves"), F.col("cycle")).alias("cycle"))


def trace(lineage: DataFrame) -> DataFrame:
    """(target, source, steps, cycle): from each target to its root by the earliest edge of each hop (created, then source)."""
    first = lineage.groupBy(F.col("target").alias("node")).agg(F.min_by("source", F.struct("created", "source")).alias("parent"))
    return roots(first).select(F.col("node").alias("target"), F.col("root").alias("source"), F.col("level").alias("steps"), "cycle")


def constrained_reach(edges: DataFrame, starts: DataFrame, rules: list[tuple[int, str, int]], most: int | None = None) -> DataFrame:
    """(start, node, hops): nodes that a walk under the rules comes to, with the least number of edges; starts have 0.

    edges: (src, dst, label); starts: (node). rules: (state, label, next state),
    from state 0 on: an edge may be taken in a state that has a rule for its label.
    Every state counts as an arrival. What a level has newly found, as node and
    state, is all that goes on, so circles end. ``most`` bounds the edges of a walk.
    """
    spark = edges.sparkSession
    allowed = spark.createDataFrame(rules, "state int, label string, next int")
    one = {state for state, _, _ in rules} | {after for _, _, after in rules} == {0}
    # the rules are on the edges, so what a walk has come to meets only edges that it may take
    able = edges.join(F.broadcast(allowed), "label").select("src", "dst", *([] if one else ["state", "next"])).distinct()
    keys = ["start", "node"] if one else ["start", "node", "state"]
    able = stored(able, "edges")
    found = stored(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("state")).distinct().select(*keys), "reach").withColumn("hops", F.lit(0))
    front, parts, hop = found, [found], 0
    while most is None or hop < most:
        hop += 1
        step = front.drop("hops").withColumnRenamed("node", "src").join(able, ["src", *keys[2:]])
        step = step.select("start", F.col("dst").alias("node"), *([] if one else [F.col("next").alias("state")])).distinct()
        # found again can only be what edges lead to: where none leads back, nothing found is shuffled
        ends = stored(able.join(front.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("node")).distinct(), "ends")
        for p in parts:
            old = p.select(*[F.col(k).alias(f"_{k}") for k in keys])
            if not old.select("_node").distinct().join(ends, F.col("_node").eqNullSafe(F.col("node")), "left_semi").isEmpty():
                step = step.join(old, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")
        front = stored(step, "reach").withColumn("hops", F.lit(hop))
        if front.isEmpty():
            break
        parts.append(front)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # of one state, a node is found once
    return every.select("start", "node", "hops") if one else every.groupBy("start", "node").agg(F.min("hops").alias("hops"))


def within_labels(edges: DataFrame, starts: DataFrame, labels: tuple[str, ...], most: int = 3) -> DataFrame:
    """Nodes within ``most`` edges of the labels that are allowed."""
    return constrained_reach(edges, starts, [(0, label, 0) for label in labels], most)


def subtree_sizes(parents: DataFrame) -> DataFrame:
    """(root, nodes, depth): how many nodes hang under each root and how deep."""
    out = roots(parents).filter("cycle IS NULL")
    return out.groupBy("root").agg(F.count("*").alias("nodes"), F.max("level").alias("depth"))
