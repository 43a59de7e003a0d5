"""Connected components of a table of edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cut


def _roots(edges: DataFrame) -> DataFrame:
    """Each vertex with the root of the tree that smallest-neighbour pointers make."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("p")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("p")))
    tree = cut(both.groupBy("v").agg(F.least(F.col("v"), F.min("p")).alias("p")), "tree")
    while True:  # pointers double: as many rounds as the logarithm of the depth
        up = tree.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        nxt = cut(tree.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p"), (F.coalesce("pp", "p") != F.col("p")).alias("moved")), "tree")
        tree = nxt.select("v", "p")
        if nxt.filter("moved").isEmpty():
            return tree


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(k, comp): every vertex of an edge with the smallest vertex that it reaches.

    Each level points vertices at their smallest neighbour, follows the pointers
    to roots and contracts the edges to edges between roots; levels are few, as
    every root merges with another. Loops, repeated and reversed edges and rows
    with a null end do no harm; no edges give an empty table. Only sums and
    minima by vertex are shuffled: a vertex with many edges needs no large task.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    found = None
    while True:
        edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            break
        tree = _roots(edges)
        if found is None:
            found = tree.select(F.col("v").alias("k"), F.col("p").alias("comp"))
        else:
            up = tree.select(F.col("v").alias("comp"), F.col("p").alias("top"))
            found = cut(found.join(up, "comp", "left").select("k", F.coalesce("top", "comp").alias("comp")), "components")
        ra = tree.select(F.col("v").alias("a"), F.col("p").alias("ra"))
        rb = tree.select(F.col("v").alias("b"), F.col("p").alias("rb"))
        edges = edges.join(ra, "a").join(rb, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    if found is None:
        return edges.select(F.col("a").alias("k"), F.col("b").alias("comp"))
    return found
