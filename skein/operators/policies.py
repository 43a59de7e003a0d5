"""Policies as data: a Boolean-expression index over the conditions of their rules.

Every condition is a posting (attribute, kind, value); a request's attributes meet
the postings by equality, and a policy matches where as many of its conditions
hold as it has. Ranges meet by equality too: an attribute's bounds cut the number
line into steps, and a range is a few nodes of the binary tree over these steps,
of which a value lies in one on each level. No request meets a policy with which
it shares no value.

A rule is a JSON object, attribute -> expected: a value, a list of values, or
{"min": a, "max": b} with either bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.joins import small_join
from skein.storage import stored

def conditions(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules (policy, effect, place, rule_order, expression, and maybe enabled) -> the policies that can match, and their postings.

    policies: (policy, effect, place, needs): needs is the number of conditions.
    postings: (policy, condition, attribute, kind, value, low, high). Kinds: ``is``
    (a value without regard to case), ``has`` (the same as written, for
    collections), ``in`` (each value of a list, as written), ``range``. A policy
    with a rule that can't be read, or that expects a null or an object without
    bounds, matches nothing, nor does one without rules or one that isn't enabled.
    An empty rule holds for every request.
    """
    if "enabled" in rules.columns:
        rules = rules.filter(F.coalesce("enabled", F.lit(False)))
    each = rules.select("policy", "effect", "place", "rule_order", F.try_variant_get(F.try_parse_json("expression"), "$", "map<string,variant>").alias("_map"))
    none = F.create_map().cast("map<string,variant>")
    entries = F.transform(F.map_entries(F.coalesce("_map", none)), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.schema_of_variant(e["value"]).alias("type")))
    each = each.withColumn("_entries", entries)

    def bounds(v: Column) -> list[Column]:
        return [F.try_variant_get(v, f"$.{name}", "double") for name in ("min", "max")]

    odd = lambda e: e["type"].isin("VOID") | (F.startswith(e["type"], F.lit("OBJECT")) & F.coalesce(*bounds(e["value"])).isNull())
    each = each.withColumn("_broken", F.col("_map").isNull() | F.exists("_entries", odd))
    flat = each.filter("NOT _broken").select("policy", "rule_order", F.explode("_entries").alias("_e"))
    value, kind = F.col("_e.value"), F.col("_e.type")
    text = F.try_variant_get(value, "$", "string")
    low, high = bounds(value)

    def posting(kind: str, value: Column, low: Column | None = None, high: Column | None = None) -> Column:
        number = lambda x: (F.lit(None) if x is None else x).cast("double")
        return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), number(low).alias("low"), number(high).alias("high"))

    listed = F.transform(F.array_distinct(F.coalesce(F.try_variant_get(value, "$", "array<string>"), F.array().cast("array<string>"))), lambda x: posting("in", x))
    ranged = F.array(posting("range", F.lit(None), F.coalesce(low, F.lit(float("-inf"))), F.coalesce(high, F.lit(float("inf")))))
    single = F.array(posting("is", F.lower(text)), posting("has", text))
    all_of = F.when(F.startswith(kind, F.lit("ARRAY")), listed).when(F.startswith(kind, F.lit("OBJECT")), ranged).otherwise(single)
    postings = flat.select("policy", F.concat_ws("\x01", "rule_order", "_e.key").alias("condition"), F.col("_e.key").alias("attribute"), F.inline(all_of)).filter("kind = 'range' OR value IS NOT NULL")
    needs = flat.groupBy("policy").agg(F.count("*").alias("needs"))
    able = each.groupBy("policy").agg(F.min("effect").alias("effect"), F.min("place").alias("place"), F.some("_broken").alias("_b")).filter("NOT _b").drop("_b")
    return able.join(needs, "policy", "left").withColumn("needs", F.coalesce("needs", F.lit(0))), postings


def _halved(place: Column, times: Column) -> Column:
    return F.call_function("shiftright", place, times)


def _nodes(low: Column, high: Column, levels: int) -> Column:
    """The fewest nodes (level, place) of the tree over steps 0.. whose steps are those from low to high: at most two on a level."""

    def on(level: Column) -> Column:
        first = lambda k: _halved(low + F.call_function("shiftleft", F.lit(1), k) - 1, k)
        last = lambda k: _halved(high + 1, k) - 1
        up = level + 1
        inner = lambda place: (_halved(place, F.lit(1)) >= first(up)) & (_halved(place, F.lit(1)) <= last(up))
        ends = F.array_distinct(F.array(first(level), last(level)))
        kept = F.filter(ends, lambda p: (p >= first(level)) & (p <= last(level)) & ~inner(p))
        return F.transform(kept, lambda p: F.struct(level.alias("level"), p.alias("node")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), on))


def _step(bounds: Column, value: Column, levels: int) -> Column:
    """How many bounds (ascending) are not above the value: a binary search."""
    jumps = F.array(*[F.lit(1 << k) for k in range(levels, -1, -1)])
    fits = lambda at, jump: (at + jump <= F.size(bounds)) & (F.try_element_at(bounds, at + jump) <= value)
    return F.aggregate(jumps, F.lit(0), lambda at, jump: at + F.when(F.coalesce(fits(at, jump), F.lit(False)), jump).otherwise(0))


def matches(attributes: DataFrame, key: str, policies: DataFrame, postings: DataFrame) -> DataFrame:
    """(key, policy, effect, place): the policies all of whose conditions hold, of those with any.

    attributes: (key, attribute, value) as text, a row for each value of a
    collection, and ``many``, true for values of a collection. A single value
    equals what is expected in any case of letters, or is in the list; a
    collection holds it as written; ranges hold for single numbers. Null values
    match nothing. Repeated rows count once.
    """
    held = attributes.filter(F.col("value").isNotNull()).select(key, "attribute", "value", F.coalesce("many", F.lit(False)).alias("many")).distinct()
    shape = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    asked = held.select(key, "attribute", F.inline(F.when(F.col("many"), F.array(shape("has", F.col("value")))).otherwise(F.array(shape("is", F.lower("value")), shape("in", F.col("value"))))))
    met = small_join(asked, postings.filter("kind <> 'range'").select("policy", "condition", "attribute", "kind", "value"), ["attribute", "kind", "value"]).select(key, "policy", "condition")
    ranges = stored(postings.filter("kind = 'range'").select("policy", "condition", "attribute", "low", "high"), "ranges")
    if not ranges.isEmpty():
        met = met.unionByName(_in_ranges(held, key, ranges))
    counted = met.distinct().groupBy(key, "policy").agg(F.count("*").alias("_held"))
    return small_join(counted, policies, "policy").filter(F.col("_held") == F.col("needs")).select(key, "policy", "effect", "place")


def _in_ranges(held: DataFrame, key: str, ranges: DataFrame) -> DataFrame:
    # a range begins at its low bound and ends before what follows its high one: 2 * bounds not above a value, and one less where it is no bound itself
    bounds = ranges.select("attribute", F.explode(F.array("low", "high")).alias("_b")).groupBy("attribute").agg(F.sort_array(F.collect_set("_b")).alias("bounds"))
    levels = max(1, (2 * (bounds.agg(F.max(F.size("bounds"))).first()[0] or 1) + 1).bit_length())

    def place(value: Column) -> Column:
        upto = _step(F.col("bounds"), value, levels)
        own = F.coalesce(F.get("bounds", upto - 1) == value, F.lit(False))
        return (2 * upto - F.when(own, 1).otherwise(0)).cast("int")

    tree = small_join(ranges, bounds, "attribute").withColumns({"_from": place(F.col("low")), "_to": place(F.col("high"))}).filter("low <= high")
    nodes = tree.select("policy", "condition", "attribute", F.inline(_nodes(F.col("_from"), F.col("_to"), levels)))
    numbers = held.filter("NOT many").select(key, "attribute", F.col("value").try_cast("double").alias("_n"))
    at = small_join(numbers.filter("_n IS NOT NULL AND NOT isnan(_n)"), bounds, "attribute").select(key, "attribute", place(F.col("_n")).alias("_at"))
    paths = at.select(key, "attribute", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: _halved(F.col("_at"), k))).alias("level", "node"))
    return small_join(paths, nodes, ["attribute", "level", "node"]).select(key, "policy", "condition")


def decide(requests: DataFrame, attributes: DataFrame, rules: DataFrame, key: str, deny_overrides: bool) -> DataFrame:
    """requests (key, ...) with ``allowed`` and ``policy``, the one that decided.

    Deny overrides: denied by the first matching DENY policy, else allowed.
    Otherwise the first matching policy decides, and without any the request is
    denied. Policies are taken by place, then name. Effects in any case.
    """
    policies, postings = conditions(rules)
    policies = stored(policies.withColumn("effect", F.upper("effect")), "policies")
    found = matches(attributes, key, policies, stored(postings, "postings"))
    always = policies.filter("needs = 0")
    if deny_overrides:
        found, always = found.filter("effect = 'DENY'"), always.filter("effect = 'DENY'")
    first = found.groupBy(key).agg(F.min(F.struct("place", "policy", "effect")).alias("_own"))
    every = always.agg(F.min(F.struct("place", "policy", "effect")).alias("_all"))  # one row
    out = requests.join(first, key, "left").join(F.broadcast(every)).withColumn("_best", F.least("_own", "_all"))
    allowed = F.col("_best").isNull() if deny_overrides else F.coalesce(F.col("_best.effect") == "ALLOW", F.lit(False))
    return out.withColumns({"allowed": allowed, "policy": F.col("_best.policy")}).drop("_own", "_all", "_best")
