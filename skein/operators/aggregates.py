"""Aggregates over facts: costs, budgets, histograms, rates. Money is summed as decimals, so sums don't depend on order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.scalars import round_even


def money(column: str) -> Column:
    return F.col(column).cast("decimal(18,4)")


def total(column: str) -> Column:
    return F.sum(money(column)).cast("double")


def mean(column: str) -> Column:
    """The average as a decimal sum divided once, so that it doesn't depend on order; nulls count as rows without a value."""
    return total(column) / F.count(column)


def total_if(column: str, condition: Column) -> Column:
    """Null where no row meets the condition, as a filtered sum is."""
    return F.sum(F.when(condition, money(column))).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def histogram(df: DataFrame, value: str, bounds: list[float], *keys: str) -> DataFrame:
    """Cumulative buckets: one row for each bound and key with the number of values up to it; one scan."""
    counts = df.groupBy(*keys).agg(*[F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)])
    each = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)])
    return counts.select(*keys, F.inline(each))


def percentiles(value: str, *shares: float, rows: int | None = None) -> list[Column]:
    """Percentiles of a group. The exact ones hold a group's distinct values in a task; where a caller states more ``rows`` than fit, sketches of bounded size give them."""
    exact = rows is None or rows <= EXACT_ROWS
    return [(F.percentile(value, F.lit(p)) if exact else F.percentile_approx(value, p, 10_000)).alias(f"p{round(100 * p)}") for p in shares]


#: Rows of a group up to which percentiles are exact.
EXACT_ROWS = 10_000_000


def extraction_metrics(keys: DataFrame, items: DataFrame, key: str, confidence: str, low: float = 0.6) -> DataFrame:
    """Mean, least, number and share of low confidences (missing ones are 0.5) for each row of ``keys``, to three digits.

    A key without items has zeros, and 1 as the least.
    """
    rows = items.select(key, F.coalesce(F.col(confidence), F.lit(0.5)).alias("_c"))
    out = rows.groupBy(key).agg(mean("_c").alias("_mean"), F.min("_c").alias("_least"), F.count_if(F.col("_c") < low).alias("_low"), F.count("*").alias("_n"))
    zero = F.lit(0.0)
    return keys.select(key).join(out, key, "left").select(
        key, round_even(F.coalesce("_mean", zero), 3).alias("mean"), round_even(F.coalesce("_least", F.lit(1.0)), 3).alias("least"), F.coalesce("_low", F.lit(0)).cast("long").alias("low"),
        round_even(F.coalesce(F.col("_low") / F.col("_n"), zero), 3).alias("risk"),
    )


def budget_action(spent: Column, limit: Column) -> Column:
    """block, throttle, warn or allow at 100, 90 and 70 per cent of a budget."""
    share = spent * 100 / limit
    return F.when(share >= 100, "block").when(share >= 90, "throttle").when(share >= 70, "warn").otherwise("allow")


#: Actions from the mildest on.
ACTIONS = ("allow", "warn", "throttle", "block")


def strictest(*actions: Column) -> Column:
    """Of several scopes' actions, the most restrictive."""
    order = F.array(*[F.lit(a) for a in ACTIONS])
    return F.element_at(order, F.greatest(*[F.array_position(order, a) for a in actions]).cast("int"))
