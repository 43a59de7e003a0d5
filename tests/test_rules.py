"""Rules of single rows, version histories and the graph projection against plain versions."""

import pytest
from pyspark.sql import functions as F

from skein.functions import scalars, text
from skein.operators import access, ordering, projection, quality, routing, search, vector_index


@pytest.mark.parametrize(
    ("handle", "url"),
    [
        (" @siti\n", "https://www.youtube.com/@siti/videos"), ("siti", "https://www.youtube.com/@siti/videos"), ("UC" + "x" * 22, "https://www.youtube.com/channel/UC" + "x" * 22 + "/videos"),
        ("UC" + "x" * 21, "https://www.youtube.com/@UC" + "x" * 21 + "/videos"), ("https://youtube.com/@a/", "https://youtube.com/@a/videos"), ("https://youtube.com/@a/shorts", "https://youtube.com/@a/shorts"),
        ("http://youtube.com/channel/UC1/", "http://youtube.com/channel/UC1/"), ("https://youtube.com/@a/videos", "https://youtube.com/@a/videos"), (None, None),
    ],
)
def test_channel_url(spark, handle, url):
    assert spark.createDataFrame([(handle,)], "h string").select(text.channel_url(F.col("h"))).first()[0] == url


def test_event_topics(spark):
    kinds = ["StoryX", "SourceX", "TranscriptX", "KnowledgeX", "ArticleX", "ReviewX", "PublicationX", "CollectionX", "AnnotationX", "ExportX", "UserX", "RoleX", "TenantX", "x", None]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in kinds], "k string").coalesce(1).select(routing.event_topic(F.col("k"))).collect()]
    assert got == ["content.evt"] * 3 + ["knowledge.evt", "content.evt"] + ["workflow.evt"] * 2 + ["research.evt"] * 3 + ["identity.evt"] * 3 + ["content.evt"] * 2


def test_quality_rules(spark):
    df = spark.createDataFrame([(0,), (20,), (21,), (40,), (60,), (61,), (81,), (100,), (None,)], "c int").coalesce(1)
    got = df.select(*[quality.confidence_label(F.col("c"), k) for k in quality.CONFIDENCE_LABELS]).collect()
    assert [r[0] for r in got] == ["Speculative", "Speculative", "Low", "Low", "Moderate", "High", "Very High", "Very High", None]
    assert got[3][1] == "Poor" and got[5][2] == "Approved with Notes"
    rows = [("", ["a"]), (None, []), ("x" * 600, ["b"]), ("short a", ["A"]), ("short", [])]
    df = spark.createDataFrame(rows, "t string, n array<string>").coalesce(1)
    issues = [r[0] for r in df.select(quality.article_issues(F.col("t"), F.col("n"))).collect()]
    short, none, empty = "Content too short", "No canonical entities mentioned in article", "Empty article content"
    assert issues == [[short, none, empty], [short, empty], [none], [short], [short]]
    one = spark.range(1)
    assert one.select(quality.composite_confidence(F.lit(0.5), F.lit(1.0), F.lit(None)), quality.composite_confidence(F.lit(1.0), F.lit(1.0), F.lit(1.0))).first()[:] == (0.8, 1.0)
    able = [(1, 1, "a", "b"), (0, 1, "a", "b"), (1, 0, "a", "b"), (1, 1, "a", "a"), (1, 1, None, "b"), (None, 1, "a", "b")]
    df = spark.createDataFrame(able, "e int, n int, r string, c string").coalesce(1)
    assert [r[0] for r in df.select(quality.submissible(*map(F.col, "enrc"))).collect()] == [True] + [False] * 5
    assert one.select(quality.caption_review(F.lit(0.4999)), quality.caption_review(F.lit(0.5))).first()[:] == (True, False)
    cases = spark.createDataFrame([(0.9, 0.8, 0.7, 0.1, 0.2), (0.9, 0.9, 0.7, 0.3, 0.2)], "old double, new double, floor double, hallucination double, ceiling double").coalesce(1)
    assert [(r["passed"], r["regressed"]) for r in quality.regressions(cases).collect()] == [(True, True), (False, False)]


def test_tiers_values_and_texts(spark):
    one = spark.range(1)
    no = F.lit(False)
    for manual, automatic, cloud, wanted in ((no, F.lit(None), no, ("error", None)), (no, F.lit(0.6), no, ("automatic", 0.6)), (F.lit(True), F.lit(0.6), no, ("manual", 0.95)), (no, F.lit(None), F.lit(None), ("error", None)), (no, F.lit(None), F.lit(True), ("cloud", 0.9))):
        assert tuple(one.select(*routing.tier(no, manual, automatic.cast("double"), cloud)).first()) == wanted
    value = lambda a, many, e: one.select(access.value_matches(F.array(*map(F.lit, a)).cast("array<string>"), F.lit(many), F.array(*map(F.lit, e)))).first()[0]
    assert value(["a"], False, ["A"]) and value(["a"], False, ["b", "a"]) and not value(["a"], False, ["b", "A"]) and value(["x", "a"], True, ["a"]) and not value(["x", "a"], True, ["A"]) and not value([], False, ["a"])
    got = one.select(text.embedding_text(F.lit("t"), F.lit(None).cast("string"), F.lit("n"), F.lit('{"a":1}'))).first()[0]
    assert got == 'Title: t\n\nSummary: \n\nNarrative: n\n\nCultural Context: {"a":1}'
    assert one.select(text.embedding_text(F.lit("t"), F.lit("s"), F.lit("n"), F.lit(None).cast("string"))).first()[0].endswith("Narrative: n")
    waits = [r[0] for r in spark.range(200).select(scalars.backoff(F.lit(2), jitter=scalars.seeded_unit(1, F.col("id")))).collect()]
    assert 540 * 0.8 <= min(waits) < 450 and 630 < max(waits) <= 540 * 1.2 and len(set(waits)) > 190
    score = one.select(search.boosted([F.lit("A b"), F.lit(None).cast("string"), F.lit("b b x a")], ["a"])).first()[0]
    assert score == pytest.approx(2 * 0.5 + 0.25)


def test_roll_back_makes_versions(spark):
    h = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, v int, p string")
    t = spark.createDataFrame([("a", 1), ("b", 7), ("c", 1), ("a", 1)], "k string, to int")
    got = sorted((r["k"], r["v"], r["p"], r["restored_from"] or 0) for r in ordering.roll_back(h, t, "k", "v").collect())
    assert got == [("a", 1, "x", 0), ("a", 2, "y", 0), ("a", 3, "x", 1), ("b", 1, "z", 0)]


def test_most_similar_of_a_group(spark):
    rows = [(i, i % 2, [float(x) for x in ((i * 7) % 11 - 5, (i * 3) % 7 - 3, i % 5 + 1)]) for i in range(70)] + [(70, 0, None), (71, None, [1.0, 1.0, 1.0]), (72, 1, [0.0, 0.0, 0.0]), (None, 1, [1.0, 1.0, 1.0])]
    got = {(r["key"], r["rank"]): (r["other"], round(r["score"], 9)) for r in vector_index.most_similar(spark.createDataFrame(rows, "k int, g int, v array<double>"), "k", "g", "v", 4, block=9).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    assert len(got) == 280
    for i, g, v in rows[:70]:
        scored = sorted((-round(dot(v, w) / (dot(v, v) * dot(w, w)) ** 0.5, 9), j) for j, h, w in rows[:70] if h == g and j != i)[:4]
        assert [-s for s, _ in scored] == [got[i, r][1] for r in range(1, 5)]


def test_projection_keeps_the_last_version(spark):
    item = "struct<id:string,name:string,confidence:int>"
    schema = f"story_id string, version long, title string, entities array<struct<id:string,name:string,role:string,confidence:int>>, locations array<{item}>, beliefs array<{item}>, rituals array<{item}>, claims array<struct<id:string,name:string,claim_type:string,veracity:string>>, relationships array<struct<source:string,target:string,type:string,confidence:int>>"
    rows = [
        ("s", 1, "old", [("e1", "A", "hero", 1), ("e2", "B", "foe", 2)], [("l", "here", 1)], [], [], [("c", "was", "t", "v")], [("A", "B", "KNOWS", 1), ("A", "nobody", "KNOWS", 1)]),
        ("s", 2, "new", [("e1", "B", "ghost", 3), (None, "x", "y", 1)], [("l", "there", 2)], None, [("r", "rite", 1)], [], [("B", "B", "IS", 5)]),
    ]
    stories = spark.createDataFrame(rows, schema)
    n = projection.nodes(stories)
    assert sorted(tuple(r) for r in n.collect()) == [("Claim", "c", "was"), ("Entity", "e1", "B"), ("Entity", "e2", "B"), ("Location", "l", "there"), ("Ritual", "r", "rite"), ("Story", "s", "new")]
    got = {(r["type"], r["src"], r["dst"]): r["properties"] for r in projection.edges(stories, n).collect()}
    assert got["APPEARS_IN", "e1", "s"] == '{"role":"ghost","confidence":3}' and got["APPEARS_IN", "e2", "s"] == '{"role":"foe","confidence":2}'
    assert got["SET_IN", "s", "l"] == '{"confidence":2}' and got["CONTAINS_CLAIM", "s", "c"] == '{"claim_type":"t","veracity":"v"}'
    assert {k[1:] for k in got if k[0] == "RELATES_TO"} == {(a, b) for a in ("e1", "e2") for b in ("e1", "e2")}  # by name: both are B now, nobody is A
