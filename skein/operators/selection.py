"""Exact order statistics of groups of any size, by distributed selection.

Each round a sketch of every bracket proposes where a wanted rank lies, rows
below and inside the new bracket are counted, and a proposal that the counts
don't bear out is dropped. Once brackets are small their distinct values are
counted one by one. No task holds a group, however large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators.joins import small_join
from skein.storage import stored

#: Values of a bracket that are counted one by one.
FEW = 100_000
#: Steps of a sketch: a bracket shrinks to a few of them in a round.
STEPS = 500


def _on(keys: list[str], other: str = "_k_") -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(other + k))
    return out


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: tuple[float, ...], few: int = FEW) -> DataFrame:
    """(keys, p50, ...): interpolated percentiles of each group, exact at any size.

    Null values don't count; a group without values has no row. Null keys are a
    group. Brackets are narrowed, round after round, until each holds at most
    ``few`` rows or a single value.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    at = F.array(*[F.lit(float(p)) * (F.col("_n") - 1) for p in shares])
    ranks = F.array_distinct(F.flatten(F.transform(at, lambda x: F.array(F.floor(x).cast("long"), F.ceil(x).cast("long")))))
    sizes = stored(sizes.withColumn("_at", at), "groups")
    wanted = stored(sizes.select(*keys, F.explode(ranks).alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_in")), "ranks")
    renamed = {k: "_k_" + k for k in keys}
    while True:
        wide = wanted.filter((F.col("_in") > few) & (F.col("_lo") < F.col("_hi")))
        if wide.isEmpty():
            break
        brackets = stored(wide.select(*keys, "_lo", "_hi").distinct().withColumnsRenamed(renamed), "brackets")
        inside = small_join(rows, brackets, _on(keys) & F.col("_v").between(F.col("_lo"), F.col("_hi")))
        grid = [i / STEPS for i in range(STEPS + 1)]
        sketch = stored(inside.groupBy(*renamed.values(), "_lo", "_hi").agg(F.percentile_approx("_v", grid, 20 * STEPS).alias("_grid")), "sketches")
        sketch = sketch.withColumnsRenamed({"_lo": "_slo", "_hi": "_shi"})
        place = (F.col("_rank") - F.col("_below")) / F.col("_in") * STEPS
        low = F.element_at("_grid", (F.greatest(F.floor(place) - 1, F.lit(0)) + 1).cast("int"))
        high = F.element_at("_grid", (F.least(F.ceil(place) + 1, F.lit(STEPS)) + 1).cast("int"))
        met = wide.join(sketch, _on(keys) & (F.col("_lo") == F.col("_slo")) & (F.col("_hi") == F.col("_shi")))
        tried = stored(met.select(*keys, "_rank", "_lo", "_hi", "_below", "_in", F.greatest(low, "_lo").alias("_a"), F.least(high, "_hi").alias("_b")), "tried")
        # rows under and in the proposed bracket, of those in the old one
        asked = tried.withColumnsRenamed(renamed)
        counted = small_join(rows, asked, _on(keys) & F.col("_v").between(F.col("_lo"), F.col("_hi")))
        v, lo, hi = F.col("_v"), F.col("_a"), F.col("_b")
        counted = counted.groupBy(*renamed.values(), "_rank", "_lo", "_hi", "_below", "_in", "_a", "_b").agg(
            F.count_if(v < lo).alias("_less"), F.count_if(v.between(lo, hi)).alias("_held"), F.count_if(v == lo).alias("_at_a"), F.count_if(v == hi).alias("_at_b"),
            F.min(F.when((v > lo) & (v < hi), v)).alias("_next"), F.max(F.when((v > lo) & (v < hi), v)).alias("_last"),
        )
        less = F.col("_below") + F.col("_less")
        upto = less + F.col("_held")
        rank = F.col("_rank")

        def case(under, first, inner, last, over):
            """By where the rank is: under the proposal, at its first value, inside, at its last value, over it."""
            return F.when(rank < less, under).when(rank < less + F.col("_at_a"), first).when(rank < upto - F.col("_at_b"), inner).when(rank < upto, last).otherwise(over)

        none = F.lit(None).cast("long")
        narrowed = counted.select(
            *[F.col("_k_" + k).alias(k) for k in keys], "_rank",
            case(F.col("_lo"), lo, F.col("_next"), hi, hi).alias("_lo"),
            case(lo, lo, F.col("_last"), hi, F.col("_hi")).alias("_hi"),
            case(F.col("_below"), less, less + F.col("_at_a"), upto - F.col("_at_b"), none).alias("_below"),
            case(F.col("_less"), F.col("_at_a"), F.col("_held") - F.col("_at_a") - F.col("_at_b"), F.col("_at_b"), none).alias("_in"),
        )
        wanted = stored(_recount(narrowed, rows, keys).unionByName(wanted.filter((F.col("_in") <= few) | (F.col("_lo") >= F.col("_hi")))), "ranks")
    single = F.col("_lo") == F.col("_hi")
    narrow = wanted.filter(~single).withColumnsRenamed(renamed)
    each = small_join(rows, narrow, _on(keys) & F.col("_v").between(F.col("_lo"), F.col("_hi"))).groupBy(*renamed.values(), "_rank", "_below", "_v").agg(F.count("*").alias("_many"))
    upto = F.sum("_many").over(W.partitionBy(*renamed.values(), "_rank").orderBy("_v"))
    each = each.withColumn("_upto", upto + F.col("_below")).filter((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_many")))
    values = each.select(*[F.col("_k_" + k).alias(k) for k in keys], "_rank", "_v").unionByName(wanted.filter(single).select(*keys, "_rank", F.col("_lo").alias("_v")))
    maps = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_values")).withColumnsRenamed(renamed)
    out = sizes.join(maps, _on(keys))

    def between(i: int) -> Column:
        x = F.col("_at")[i]
        a, b = F.try_element_at("_values", F.floor(x).cast("long")), F.try_element_at("_values", F.ceil(x).cast("long"))
        return a + (b - a) * (x - F.floor(x))

    return out.select(*keys, *[between(i).alias(f"p{round(100 * p, 4):g}") for i, p in enumerate(shares)])


def _recount(narrowed: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Brackets whose counts the last pass didn't give, which a sketch within its error never makes, counted once more."""
    known = narrowed.filter(F.col("_below").isNotNull() & F.col("_in").isNotNull())
    rest = narrowed.filter(F.col("_below").isNull() | F.col("_in").isNull())
    if rest.isEmpty():
        return known
    renamed = {k: "_k_" + k for k in keys}
    asked = rest.select(*keys, "_rank", "_lo", "_hi").withColumnsRenamed(renamed)
    met = small_join(rows, asked, _on(keys)).groupBy(*renamed.values(), "_rank", "_lo", "_hi").agg(F.count_if(F.col("_v") < F.col("_lo")).alias("_below"), F.count_if(F.col("_v").between(F.col("_lo"), F.col("_hi"))).alias("_in"))
    return known.unionByName(met.withColumnsRenamed({v: k for k, v in renamed.items()}).select(known.columns))
