"""Property graphs as node and edge tables: neighbourhoods, walks, hierarchies, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def neighbours(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Every node with its sorted neighbours; nodes without edges have none."""
    near = undirected(edges).groupBy(F.col("src").alias(key)).agg(F.sort_array(F.collect_set("dst")).alias("near"))
    return nodes.select(key).join(near, key, "left").select(key, F.coalesce("near", F.array().cast(near.schema["near"].dataType)).alias("near"))


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, hops): nodes within ``depth`` directed hops, each with its least number; starts have 0.

    A level joins only what the level before has newly found.
    """
    found = starts.select(F.col("node").alias("start"), "node").withColumn("hops", F.lit(0))
    front = found
    for h in range(1, depth + 1):
        step = front.join(edges, front["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct()
        front = step.join(found, ["start", "node"], "left_anti").withColumn("hops", F.lit(h))
        found = found.unionByName(front)
    return found


def pairs_within(rows: DataFrame, key: str, id: str, size: int = 256) -> DataFrame:
    """All pairs of rows with one key and different ids, each pair once: _x and _y, structs of the columns, the id of _x the smaller.

    The rows of a key are dealt to blocks of about ``size`` by a hash of the id;
    two blocks are one join key, so a hot key's pairs come from many tasks. Null
    keys and ids pair with nothing.
    """
    many = rows.groupBy(key).agg(F.ceil(F.count("*") / size).cast("int").alias("_n"))
    dealt = rows.join(many, key).select(F.struct(*rows.columns).alias("_x"), F.col(key).alias("_key"), "_n", F.pmod(F.xxhash64(F.lit(3), id), "_n").cast("int").alias("_own"))
    left = dealt.select("_x", "_key", F.col("_own").alias("_i"), F.explode(F.sequence("_own", F.col("_n") - 1)).alias("_j"))
    right = dealt.select(F.col("_x").alias("_y"), "_key", F.explode(F.sequence(F.lit(0), "_own")).alias("_i"), F.col("_own").alias("_j"))
    x, y = F.col("_x")[id], F.col("_y")[id]
    met = left.join(right, ["_key", "_i", "_j"]).filter((x < y) | ((F.col("_i") < F.col("_j")) & (x > y)))
    return met.select(F.when(x < y, F.col("_x")).otherwise(F.col("_y")).alias("_x"), F.when(x < y, F.col("_y")).otherwise(F.col("_x")).alias("_y"))


def shared_neighbours(edges: DataFrame, least: int = 1, size: int = 256) -> DataFrame:
    """(a, b, shared) of sources that point at the same nodes, a < b."""
    met = pairs_within(edges.select("src", "dst").distinct(), "dst", "src", size)
    return met.groupBy(F.col("_x.src").alias("a"), F.col("_y.src").alias("b")).agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)


def roots(parents: DataFrame, depth: int) -> DataFrame:
    """(node, root, level): follow parents, at most ``depth`` steps (a cycle ends there)."""
    up = parents.select(F.col("node").alias("root"), F.col("parent").alias("_up"))
    out = parents.select("node", F.col("node").alias("root")).withColumn("level", F.lit(0))
    for _ in range(depth):
        out = out.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root"), F.when(F.col("_up").isNotNull(), F.col("level") + 1).otherwise(F.col("level")).alias("level"))
    return out


def trace(lineage: DataFrame, depth: int) -> DataFrame:
    """(target, source, steps): from each target to its root by the earliest edge of each hop."""
    first = lineage.groupBy(F.col("target").alias("node")).agg(F.min_by("source", F.struct("created", "source")).alias("parent"))
    both = first.unionByName(lineage.select(F.col("source").alias("node")).distinct().join(first, "node", "left_anti").withColumn("parent", F.lit(None).cast(lineage.schema["source"].dataType)))
    return roots(both, depth).select(F.col("node").alias("target"), F.col("root").alias("source"), F.col("level").alias("steps"))


def merge_aliases(edges: DataFrame, aliases: DataFrame, *ends: str) -> DataFrame:
    """Edges whose ``ends`` (src, unless named) moved from an alias to its canonical node (alias, canonical), one of each; other columns go."""
    to = aliases.groupBy("alias").agg(F.min("canonical").alias("_to"))
    edges = edges.select("src", "dst")
    for end in ends or ("src",):
        edges = edges.join(to.withColumnRenamed("alias", end), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return edges.select("src", "dst").distinct()


def without(edges: DataFrame, archived: DataFrame, *ends: str) -> DataFrame:
    """Edges none of whose ``ends`` (both, unless named) is an archived node."""
    for end in ends or ("src", "dst"):
        edges = edges.join(archived.select(F.col("node").alias(end)), end, "left_anti")
    return edges


def similar_sets(rows: DataFrame, items: str, least: float) -> DataFrame:
    """(a, b, similarity, stories_a, stories_b): pairs of classes of equal sets whose Jaccard similarity is over ``least``; a class of several is alike with itself.

    Only classes that share an item meet, counted by item; a <= b.
    """
    classes = rows.groupBy(F.sort_array(F.array_distinct(items)).alias("set")).agg(F.count("*").alias("stories"))
    each = classes.select("set", F.explode("set").alias("_item"))
    met = pairs_within(each.withColumn("_id", F.array_join("set", "\x01")), "_item", "_id").groupBy(F.col("_x.set").alias("a"), F.col("_y.set").alias("b")).agg(F.count("*").alias("_n"))
    alike = met.withColumn("similarity", F.col("_n") / (F.size("a") + F.size("b") - F.col("_n"))).filter(F.col("similarity") > least).select("a", "b", "similarity")
    own = classes.filter("stories > 1").select(F.col("set").alias("a"), F.col("set").alias("b"), F.lit(1.0).alias("similarity"))
    first, second = classes.select(F.col("set").alias("a"), F.col("stories").alias("stories_a")), classes.select(F.col("set").alias("b"), F.col("stories").alias("stories_b"))
    return alike.unionByName(own).join(first, "a").join(second, "b")


def lineage_of(lineage: DataFrame, **keys) -> DataFrame:
    """Lineage rows by equality of the given columns: an object and its type, a parent, a tenant."""
    for name, value in keys.items():
        lineage = lineage.filter(F.col(name) == F.lit(value))
    return lineage


def citations(author: Column, year: Column, title: Column, archive: Column, url: Column) -> dict[str, Column]:
    """A source in four styles."""
    at = F.concat
    return {
        "apa": at(author, F.lit(" ("), year, F.lit("). "), title, F.lit(". "), archive, F.lit(". "), url),
        "mla": at(author, F.lit('. "'), title, F.lit('." '), archive, F.lit(", "), year, F.lit(", "), url, F.lit(".")),
        "chicago": at(author, F.lit('. "'), title, F.lit('." '), archive, F.lit(". "), year, F.lit(". "), url, F.lit(".")),
        "ieee": at(author, F.lit(', "'), title, F.lit(',\" '), archive, F.lit(", "), year, F.lit(". [Online]. Available: "), url),
    }
