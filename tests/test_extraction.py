"""Phrase matching and lenient reading against plain versions."""

import json
import random
import re

from pyspark.sql import functions as F

from skein.sources import extraction as x


def plain_phrases(text, terms):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    by = {tuple(w for w in re.split(r"[\W_]+", p.lower()) if w): p for p in terms}
    out, i = [], 0
    while i < len(words):
        n = max((len(g) for g in by if g and tuple(words[i : i + len(g)]) == g), default=0)
        if n:
            out.append((i, n, by[tuple(words[i : i + n])]))
        i += n or 1
    return out


def test_longest_phrase_wins(spark):
    rng = random.Random(3)
    terms = ["pocong", "hantu pocong", "leak", "leak bali", "bali", "hantu pocong bali timur", "Mayat-Terbungkus", "a b c", "b c d e"]
    words = "hantu pocong leak bali timur mayat terbungkus a b c d e ".split() + ["x,", "Bali!", "(b", "pocongan"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(25))) for _ in range(150)] + [None, "", "HANTU  pocong"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(3)
    dictionary = spark.createDataFrame([(p, f"n{i}") for i, p in enumerate(terms)] + [(None, "none"), ("--", "empty")], "phrase string, name string")
    got = {}
    for r in x.phrases(df, ["k"], "text", dictionary).collect():
        got.setdefault(r["k"], []).append((r["place"], r["start"], r["words"], r["phrase"]))
    wanted = {k: [(i, *h) for i, h in enumerate(plain_phrases(t, terms), 1)] for k, t in enumerate(texts)}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in wanted.items() if v}
    assert x.phrases(df, ["k"], "text", dictionary.limit(0)).count() == 0
    assert x.phrases(df.limit(0), ["k"], "text", dictionary).count() == 0


def test_every_kind_is_read_leniently(spark):
    full = {"string": "s", "double": 0.5, "array<string>": ["a"]}
    for kind, (fields, required) in x.SCHEMAS.items():
        names = [f.split(" ", 1) for f in fields.split(", ")]
        item = {n: full[k] for n, k in names}
        less = {n: v for n, v in item.items() if n != required[0]}
        texts = [
            json.dumps({kind: [item, less]}), f"Sure!\n```json\n{json.dumps({kind: [item]})}\n```", json.dumps({kind: []}), json.dumps({"other": 1}), json.dumps({kind: "x"}),
            json.dumps({kind: None}), "no", None, '{"' + kind + '": [', json.dumps({kind: [item, 5, None, {**item, required[-1]: [1]}]}),
        ]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, r string").coalesce(1)
        got = df.select("i", *[c.alias(n) for n, c in x.parse(F.col("r"), kind).items()]).orderBy("i").collect()
        assert [r["error"] for r in got] == [None, None, None, None, "not_a_list", None, "no_json", "no_response", "no_json", None], kind
        assert [len(r["items"]) for r in got] == [1, 1, 0, 0, 0, 0, 0, 0, 0, 1], kind
        assert [r["incomplete"] for r in got] == [1, 0, 0, 0, 0, 0, 0, 0, 0, 3], kind
        assert got[0]["items"][0].asDict() == item


def test_one_bad_response_costs_its_own_items(spark):
    df = spark.createDataFrame([(1, json.dumps({"themes": [{"name": "fear", "confidence": 1, "evidence": "e"}]}), "oops")], "k int, t string, c string")
    got = {r["kind"]: (r["count"], r["error"]) for r in x.run(df, ["k"], {"themes": "t", "claims": "c"}).collect()}
    assert got == {"themes": (1, None), "claims": (0, "no_json")}
