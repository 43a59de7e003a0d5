"""The knowledge graph of canonical stories: nodes of six labels, edges of six types.

What comes again overwrites what was there: of rows of one node or edge that of
the last version stays. Relations between entities name them, so they join every
entity of that name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The label of each list of a story, its edge's type, whether the edge starts at the story, and the edge's properties.
LISTS = {
    "entities": ("Entity", "APPEARS_IN", False, ("role", "confidence")),
    "locations": ("Location", "SET_IN", True, ("confidence",)),
    "beliefs": ("Belief", "EXPRESSES", True, ("confidence",)),
    "rituals": ("Ritual", "DESCRIBES", True, ("confidence",)),
    "claims": ("Claim", "CONTAINS_CLAIM", True, ("claim_type", "veracity")),
}
RELATES = "RELATES_TO"
EDGES = "array<struct<type:string,src:string,dst:string,properties:string>>"


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row of the last version; equal versions by story, then by what the row says. Each task sends one row a key."""
    rest = [c for c in rows.columns if c not in (*keys, "version", "story_id")]
    best = F.max(F.struct(*[c for c in ("version", "story_id") if c not in keys], *rest)).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def _items(stories: DataFrame, name: str) -> DataFrame:
    return stories.select("story_id", "version", F.explode(name).alias("x"))


def nodes(stories: DataFrame) -> DataFrame:
    """(label, id, name): the stories and all that they hold. Items without an id are no nodes."""
    parts = [stories.select(F.lit("Story").alias("label"), F.col("story_id").alias("id"), F.col("title").alias("name"), "version", "story_id")]
    parts += [_items(stories, name).select(F.lit(label).alias("label"), F.col("x.id").alias("id"), F.col("x.name").alias("name"), "version", "story_id") for name, (label, *_) in LISTS.items()]
    return _last(reduce(DataFrame.unionByName, parts).filter("id IS NOT NULL"), ["label", "id"])


def edges(stories: DataFrame, graph_nodes: DataFrame) -> DataFrame:
    """(type, src, dst, properties as JSON): edges between nodes that are in the graph; an edge of one type and direction is one."""
    def edge(kind: str, out: bool, properties: tuple[str, ...]):
        def of(x: Column) -> Column:
            src, dst = (F.col("story_id"), x["id"]) if out else (x["id"], F.col("story_id"))
            said = F.to_json(F.struct(*[x[p].alias(p) for p in properties]))
            return F.struct(F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"), said.alias("properties"))

        return of

    held = [F.coalesce(F.transform(F.filter(name, lambda x: x["id"].isNotNull()), edge(*how)), F.array().cast(EDGES)) for name, (_, *how) in LISTS.items()]
    # an edge is of one story, so stories are dealt out whole and not edge by edge
    dealt = stories.filter("story_id IS NOT NULL").select("story_id", "version", *LISTS).repartition("story_id")
    rows = _last(dealt.select("story_id", "version", F.inline(F.concat(*held))), ["story_id", "type", "src", "dst"]).drop("story_id")
    # relations are few by pair of names once the last of each is chosen: then they meet the entities of these names
    named = graph_nodes.filter("label = 'Entity' AND name IS NOT NULL").select("id", "name")
    said = F.to_json(F.struct(F.col("x.type").alias("relationship_type"), F.col("x.confidence").alias("confidence")))
    ties = _last(_items(stories, "relationships").select(F.col("x.source").alias("source"), F.col("x.target").alias("target"), said.alias("properties"), "version", "story_id"), ["source", "target"])
    ties = ties.join(named.select(F.col("id").alias("src"), F.col("name").alias("source")), "source").join(named.select(F.col("id").alias("dst"), F.col("name").alias("target")), "target")
    return rows.unionByName(ties.select(F.lit(RELATES).alias("type"), "src", "dst", "properties"))
