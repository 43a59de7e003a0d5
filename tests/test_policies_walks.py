"""The policy index and long walks against plain versions."""

import json
import random

import pytest

import __spark_entry__  # noqa: F401  registers the queries
from skein.operators import policies, walks
from skein.registry import QUERIES


def holds(actual, many, expected):
    if actual is None or expected is None:
        return False
    if many:
        return not isinstance(expected, (list, dict)) and text(expected) in actual
    if isinstance(expected, list):
        return actual in [text(x) for x in expected]
    if isinstance(expected, dict):
        try:
            return expected.get("min", float("-inf")) <= float(actual) <= expected.get("max", float("inf"))
        except ValueError:
            return False
    return actual.lower() == text(expected).lower()


def text(x):
    return {True: "true", False: "false"}.get(x, str(x)) if isinstance(x, bool) else str(x)


def plain(request, rules, deny):
    by = {}
    for policy, effect, place, order, expression, enabled in rules:
        if enabled:
            by.setdefault((place, policy), (effect, []))[1].append(expression)
    for (_, policy), (effect, expressions) in sorted(by.items()):
        try:
            parsed = [json.loads(e) for e in expressions]
            broken = any(not isinstance(p, dict) or any(v is None or (isinstance(v, dict) and not {"min", "max"} & v.keys()) for v in p.values()) for p in parsed)
        except (TypeError, ValueError):
            broken = True
        if broken or not all(holds(*request.get(a, (None, False)), v) for p in parsed for a, v in p.items()):
            continue
        if effect.upper() == "DENY" or not deny:
            return effect.upper() == "ALLOW", policy
    return deny, None


@pytest.mark.parametrize("deny", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_policies(spark, deny, seed):
    rng = random.Random(seed)
    values = ["story", "Story", "write", "a", "B", "true", "7", "7.5", "-3", "100", None]
    expected = ["story", "WRITE", True, 7, ["story", "a", "a"], ["B", "7"], [], {"min": 1}, {"max": 7}, {"min": -3, "max": 7.5}, {"min": 8, "max": 5}, "[x", "a"]
    attributes = ["action", "type", "size", "roles"]
    rules = []
    for p in range(60):
        for r in range(rng.randint(0, 2) + (p < 50)):
            body = json.dumps({rng.choice(attributes): rng.choice(expected) for _ in range(rng.randint(1, 2))})
            odd = {51: "not json", 52: "[1]", 53: '{"action": null}', 54: '{"size": {"x": 1}}', 55: None}.get(p)
            rules.append((f"p{p:02}", rng.choice(["ALLOW", "deny", "DENY", "allow"]), rng.randint(0, 5), r, odd if r == 0 and p > 50 else body, p % 13 > 0))
    effect = {}
    rules = [(p, effect.setdefault(p, (e, place))[0], effect[p][1], r, x, on) for p, e, place, r, x, on in rules]
    if seed == 2:
        rules.append(("zz", "ALLOW", 9, 0, "{}", True))
    requests, rows = {}, []
    for k in range(200):
        own = {a: (rng.choice(values), False) for a in attributes[:3] if rng.random() < 0.8}
        if rng.random() < 0.7:
            own["roles"] = (rng.sample(["a", "B", "WRITE", "story", "true"], rng.randint(0, 3)), True)
        requests[k] = own
        for a, (v, many) in own.items():
            rows += [(k, a, x, many) for x in (v if many else [v])]
    df = spark.createDataFrame(rows + rows[:5], "k long, attribute string, value string, many boolean")
    table = spark.createDataFrame(rules, "policy string, effect string, place int, rule_order int, expression string, enabled boolean")
    asked = spark.createDataFrame([(k,) for k in requests], "k long")
    got = {r["k"]: (r["allowed"], r["policy"]) for r in policies.decide(asked, df, table, "k", deny).collect()}
    wanted = {k: plain(own, rules, deny) for k, own in requests.items()}
    assert got == wanted
    assert len({p for _, p in wanted.values()}) > 3


def test_ranges_meet_by_nodes(spark):
    """Every value and range of a small line, bounds themselves included."""
    spans = [(a, b) for a in range(-1, 9) for b in range(a, 9)]
    rules = [(f"{a},{b}", "ALLOW", 0, 0, json.dumps({"x": {"min": a, "max": b}}), True) for a, b in spans]
    table = spark.createDataFrame(rules, "policy string, effect string, place int, rule_order int, expression string, enabled boolean")
    points = [x / 2 for x in range(-5, 20)]
    asked = spark.createDataFrame([(i, "x", str(p), False) for i, p in enumerate(points)], "k long, attribute string, value string, many boolean")
    able, postings = policies.conditions(table)
    got = {(r["k"], r["policy"]) for r in policies.matches(asked, "k", able, postings).collect()}
    assert got == {(i, f"{a},{b}") for i, p in enumerate(points) for a, b in spans if a <= p <= b}


def test_no_policies_and_no_requests(spark):
    table = spark.createDataFrame([], "policy string, effect string, place int, rule_order int, expression string, enabled boolean")
    asked = spark.createDataFrame([(1,)], "k long")
    none = spark.createDataFrame([], "k long, attribute string, value string, many boolean")
    assert [r["allowed"] for r in policies.decide(asked, none, table, "k", True).collect()] == [True]
    assert [r["allowed"] for r in policies.decide(asked, none, table, "k", False).collect()] == [False]
    assert policies.decide(asked.limit(0), none, table, "k", False).count() == 0


def test_roots_of_long_chains_and_circles(spark, monkeypatch):
    rows = [(i, i - 1 if i else None) for i in range(1000)]
    rows += [(2000, 2001), (2001, 2002), (2002, 2000), (2003, 2001), (2004, 2003)] + [(3000, 3000), (3001, 3000)]
    rows += [(4000, 5000), (4001, 4000)]  # a parent that is no row
    joins = []
    real = walks.stored
    monkeypatch.setattr(walks, "stored", lambda df, label: joins.append(label) or real(df, label))
    got = {r["node"]: (r["root"], r["level"], r["cycle"]) for r in walks.roots(spark.createDataFrame(rows, "node long, parent long").repartition(4)).collect()}
    assert len(joins) <= 12
    assert all(got[i] == (0, i, None) for i in range(1000))
    assert all(got[i] == (None, None, 2000) for i in range(2000, 2005))
    assert got[3000] == (None, None, 3000) == got[3001] and got[4001] == (5000, 2, None) and got[5000] == (5000, 0, None)
    assert len(got) == len(rows) + 1
    assert walks.roots(spark.createDataFrame([], "node long, parent long")).count() == 0


def test_trace_takes_the_earliest_edge(spark):
    rows = [("c", "b", 2), ("c", "x", 3), ("b", "a", 5), ("b", "y", 9), ("b", "z", 5)]
    got = {r["target"]: (r["source"], r["steps"]) for r in walks.trace(spark.createDataFrame(rows, "target string, source string, created long")).collect()}
    assert got["c"] == ("a", 2) and got["b"] == ("a", 1) and got["a"] == ("a", 0)


@pytest.mark.parametrize("most", [2, None])
def test_reach_under_rules(spark, most):
    rng = random.Random(6)
    edges = [(rng.randrange(30), rng.randrange(30), rng.choice("abc")) for _ in range(70)]
    rules = [(0, "a", 0), (0, "b", 1), (1, "a", 2), (2, "c", 0)]
    starts = [0, 1, 2]
    wanted = {}
    for s in starts:
        seen, front, hop = {(s, 0)}, {(s, 0)}, 0
        wanted[s, s] = 0
        while front and (most is None or hop < most):
            hop += 1
            front = {(d, n) for v, q in front for a, d, label in edges if a == v for p, rule, n in rules if p == q and rule == label} - seen
            seen |= front
            for v, _ in front:
                wanted.setdefault((s, v), hop)
    df = spark.createDataFrame(edges, "src long, dst long, label string")
    got = walks.constrained_reach(df, spark.createDataFrame([(x,) for x in starts], "node long"), rules, most)
    assert {(r["start"], r["node"]): r["hops"] for r in got.collect()} == wanted


def test_reach_of_one_state_finds_a_node_once(spark):
    """Circles, ways of several lengths, and edges without an end, with one state and with two that are alike."""
    rng = random.Random(6)
    edges = [(rng.randrange(30), rng.randrange(30), rng.choice("abc")) for _ in range(90)] + [(1, None, "a"), (2, None, "a"), (None, 5, "a"), (0, 1, "a"), (1, 2, "a"), (2, 0, "a")]
    frame = spark.createDataFrame(edges, "src long, dst long, label string").repartition(3)
    starts = spark.createDataFrame([(0,), (0,), (7,), (99,)], "node long")
    want = {}
    for start in (0, 7, 99):
        front, want[start, start] = {start}, 0
        for hop in range(1, 5):
            front = {b for a, b, label in edges if a is not None and a in front and label in "ab"} - {n for s, n in want if s == start}
            want |= {(start, n): hop for n in front}
    for rules in ([(0, "a", 0), (0, "b", 0)], [(0, "a", 1), (0, "b", 1), (1, "a", 0), (1, "b", 0)]):
        got = walks.constrained_reach(frame, starts, rules, 4).collect()
        assert {(r["start"], r["node"]): r["hops"] for r in got} == want and len(got) == len(want)


def test_labelled_reach_stores_numbers(spark, data, monkeypatch):
    """What is found is written and shuffled as two numbers a row, without labels; the levels of these tables are not met again."""
    kept, plain = [], walks.stored
    monkeypatch.setattr(walks, "stored", lambda df, label: kept.append((label, df)) or plain(df, label))
    QUERIES["gr09_labels"](spark, data)
    assert {f.dataType.simpleString() for _, df in kept for f in df.schema.fields} == {"bigint"}
    assert not any("left_anti" in df._jdf.queryExecution().logical().toString().lower().replace("leftanti", "left_anti") for label, df in kept if label == "reach")
