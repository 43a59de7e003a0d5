"""The pipeline: each stage against a plain version on rows with all oddities, then the whole."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _row string, size long, _h int"


def prose(chance, n):
    return " ".join("".join(chance.choice("abcdefghij") for _ in range(chance.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    chance = random.Random(11)
    passage = prose(chance, 55)
    out = []
    for i in range(40):
        text = prose(chance, chance.randint(80, 300))
        if i % 4 == 0:
            text = f"{text[: len(text) // 2]} {passage} {text[len(text) // 2 :]}"
        out.append((i, text, "en", f"s{i % 3}" if i % 7 else None, len(text), "r", i, i))
    out += [(100, out[5][1], *out[5][2:]), out[6], out[6], (101, None, None, None, None, None, None, None), (102, "", "en", "s0", 0, "r", 1, 1)]
    out += [(103, "buy now " * 2000, "en", "s1", 1, "r", 1, 1), (None, prose(chance, 90), "en", "s1", 1, "r", 1, 1), (104, "#$ ! " * 80, "en", "s1", 1, "r", 1, 1)]
    near = out[7][1].split(" ")
    near[40] = "other"
    return passage, [*out, (105, " ".join(near), "en", "s2", 1, "r", 1, 1)]


def stored(spark, df, tmp_path, name):
    df.write.parquet(f"{tmp_path}/{name}")
    return spark.read.parquet(f"{tmp_path}/{name}")


def spans(texts, length):
    bodies = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    for b in bodies:
        gone = {j for i in range(len(b) - length + 1) if count[b[i : i + length]] > 1 for j in range(i, i + length)}
        yield bytes(x for j, x in enumerate(b) if j not in gone).decode("utf-8", "ignore")


def test_stages_against_plain_versions(spark, rows, tmp_path):
    passage, rows = rows
    docs = spark.createDataFrame(rows, COLUMNS)
    kept = stored(spark, pipeline.quality_rules(spark, docs, ""), tmp_path, "1")
    assert kept.columns == docs.columns
    left = Counter(map(tuple, kept.collect()))
    assert not left - Counter(rows)
    # clean rows stay, rows that fail a base rule go
    assert all(left[r] == rows.count(r) for r in rows[:40])
    assert not any(r[0] in (101, 102, 103) for r in left)

    one = stored(spark, pipeline.ngram_jaccard(spark, kept, ""), tmp_path, "2")
    sets = {}
    for r in left:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(r[1] or "")]
        sets[r] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    groups = {r: r for r in sets}

    def root(r):
        while groups[r] is not r:
            r = groups[r]
        return r

    for a in sets:
        for b in sets:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                groups[root(a)] = root(b)
    best = {}
    for r in sets:
        best[id(root(r))] = min(best.get(id(root(r)), r), r, key=lambda x: (x[0] is None, x[0] or 0))
    assert Counter(map(tuple, one.collect())) == Counter(best.values())

    stripped = stored(spark, pipeline.suffix_dedup(spark, one, ""), tmp_path, "3")
    before = [tuple(r) for r in one.collect()]
    expected = Counter((*r[:1], t, *r[2:4], len(t), *r[5:]) for r, t in zip(before, spans([r[1] for r in before], pipeline.PASSAGE_BYTES), strict=True))
    assert Counter(map(tuple, stripped.collect())) == expected
    assert sum(passage in (r[1] or "") for r in before) >= 8 and not any(passage in t[1] for t in expected)

    mixed = stored(spark, pipeline.mixing(spark, stripped, ""), tmp_path, "4")
    assert mixed.columns == docs.columns
    words = Counter()
    for r in expected.elements():
        words[r[3]] += len(WORD.findall(r[1]))
    names = sorted(s for s in words if s is not None) + [None] * (None in words)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped = set()
    while True:
        level = (sum(words.values()) - sum(3 * words[s] for s in capped)) / max(1, sum(weight[s] for s in names if s not in capped))
        over = {s for s in names if s not in capped and level * weight[s] > 3 * words[s]}
        if not over:
            break
        capped |= over
    taken = Counter()
    for r in mixed.collect():
        taken[r["source"]] += len(WORD.findall(r["text"] or ""))
    assert all(abs(taken[s] - (3 * words[s] if s in capped else level * weight[s])) <= 1 for s in names)

    pieces = pipeline.packing(spark, mixed, "")
    sizes = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert sizes and all(r["n"] == r["end"] <= 2048 and (r["n"] == 2048 or r["n"] & (r["n"] - 1) == 0) for r in sizes)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in mixed.collect()}


def test_stages_on_an_empty_table(spark, rows):
    docs = spark.createDataFrame(rows[1], COLUMNS).filter("false")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0, name
        if name != "packing":
            assert out.columns == docs.columns


def test_run(spark, data):
    pieces = pipeline.run(spark, data)
    sizes = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert sizes and all(r["n"] == r["end"] <= 2048 for r in sizes)
