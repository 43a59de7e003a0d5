"""Access filters: permissions, attribute rules, tenants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def permitted(permissions: Column, kind: Column, action: Column) -> Column:
    """Everything, everything of the type, or exactly this."""
    return F.array_contains(permissions, "*:*") | F.array_contains(permissions, F.concat(kind, F.lit(":*"))) | F.array_contains(permissions, F.concat(kind, F.lit(":"), action))


def deny_overrides(requests: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """matches: (key, policy, effect, matched) for each rule. A policy matches when all its rules do; a deny wins; without any, allowed."""
    policy = matches.groupBy(key, "policy", "effect").agg(F.every(F.coalesce("matched", F.lit(False))).alias("m"))
    denied = policy.filter("m").groupBy(key).agg(F.some(F.col("effect") == "DENY").alias("_denied"))
    return requests.join(denied, key, "left").withColumn("allowed", ~F.coalesce("_denied", F.lit(False))).drop("_denied")


def first_match(requests: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """The effect of the first policy (by ``place``) all of whose rules match; without any, denied."""
    policy = matches.groupBy(key, "policy", "effect", "place").agg(F.every(F.coalesce("matched", F.lit(False))).alias("m"))
    effect = policy.filter("m").groupBy(key).agg(F.min_by("effect", "place").alias("_effect"))
    return requests.join(effect, key, "left").withColumn("allowed", F.coalesce(F.col("_effect") == "ALLOW", F.lit(False))).drop("_effect")


def value_matches(actual: Column, many: Column, expected: Column) -> Column:
    """Whether one condition holds. A collection (``many``) holds the first expected value as written; a single value is in a list of several as written, or equals the one expected in any case; nulls match nothing.

    actual and expected: arrays of text.
    """
    one, first = F.try_element_at(actual, F.lit(1)), F.try_element_at(expected, F.lit(1))
    held = F.when(many, F.array_contains(actual, first)).when(F.size(expected) > 1, F.array_contains(expected, one)).otherwise(F.lower(one) == F.lower(first))
    return F.coalesce(held, F.lit(False))


def visible(df: DataFrame, tenant: str, own: str | None, admin: bool = False, draft: str | None = None, workspace: str | None = None, workspaces=()) -> DataFrame:
    """Rows of the own tenant and global ones (no tenant); drafts in own workspaces only. The filter reaches the scan."""
    if admin:
        return df
    out = df.filter(F.col(tenant).isNull() | (F.col(tenant) == F.lit(own)))
    if draft and workspace:
        out = out.filter(~F.col(draft) | F.col(workspace).isin(list(workspaces)))
    return out
