"""Filters and predicates. Nulls never pass a filter unless it says so."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live(df: DataFrame, deleted: str = "is_deleted") -> DataFrame:
    """Rows that are not soft-deleted; a null flag counts as not deleted."""
    return df.filter(~F.coalesce(F.col(deleted), F.lit(False)))


def optional(df: DataFrame, **equal) -> DataFrame:
    """AND of equalities over the parameters that are given; those that are None do not filter."""
    given = [F.col(c) == v for c, v in equal.items() if v is not None]
    return df.filter(reduce(Column.__and__, given)) if given else df


def since(df: DataFrame, column: str, instant) -> DataFrame:
    return df.filter(F.col(column) > F.lit(instant))


def exists(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """Rows that have a partner: a semi join."""
    return df.join(other, on, "left_semi")


def absent(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """Rows that have no partner: an anti join."""
    return df.join(other, on, "left_anti")


def any_of(column: str, values) -> Column:
    return F.col(column).isin(list(values))


def contains_text(columns: list[str], query: str | None) -> Column:
    """Case-insensitive substring in any of the columns; an empty query passes all rows."""
    if not query:
        return F.lit(True)
    return reduce(Column.__or__, [F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False)) for c in columns])


def short_form(url: Column, width: Column, height: Column, seconds: Column) -> Column:
    """Short vertical videos: a shorts address, upright, or under 30 seconds; unknown values don't count."""
    parts = (F.contains(url, F.lit("/shorts/")), width < height, seconds < 30)
    return reduce(Column.__or__, [F.coalesce(p, F.lit(False)) for p in parts])


def stale(df: DataFrame, state: str, states, started: str, as_of: str, minutes: int) -> DataFrame:
    """Work in one of the states that started more than so many minutes before ``as_of``."""
    limit = F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL '{minutes}' MINUTE")
    return df.filter(any_of(state, states) & (F.col(started) < limit))


def stuck(df: DataFrame, state: str, terminal, created: str, as_of: str, hours: int = 4) -> DataFrame:
    """Runs in no terminal state that are older than so many hours."""
    limit = F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL '{hours}' HOUR")
    return df.filter(~any_of(state, terminal) & (F.col(created) < limit))


def violations(df: DataFrame, **checks: str) -> DataFrame:
    """Rows that break declared checks, one row a broken check; an unknown check doesn't reject."""
    failed = [F.when(~F.expr(rule), F.lit(name)) for name, rule in checks.items()]
    return df.withColumn("check", F.explode(F.array_compact(F.array(*failed))))
