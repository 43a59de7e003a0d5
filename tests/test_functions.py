"""Hand-made cases for text, validation, routing, access and streaming."""

import datetime
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from skein.functions import scalars, text
from skein.operators import access, filters, graph, quality, resolve, routing, search
from skein.registry import ORACLES, QUERIES
from skein.sources import payloads
from skein.streaming import jobs


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(0).alias("x")])
    return row.select(column.alias("y")).first()["y"]


def phrases(t):
    """The rule of the phrase filter, word by word."""
    w = t.split()
    if len(w) < 5:
        return t
    out = []
    for i, word in enumerate(w):
        now = {v.lower() for v in w[i - 4 : i]} if i >= 4 else None
        if now is None or not any({v.lower() for v in w[j : j + 4]} == now for j in range(max(0, i - 11), i - 4)):
            out.append(word)
    return " ".join(out)


@pytest.mark.parametrize("t", ["a b c d a b c d e", "one two three", "x x x x x x x x", "the cat sat on the cat sat on a mat the cat", "a b c d e f g h i j k l a b c d z"])
def test_phrases(spark, t):
    assert one(spark, text.drop_repeated_phrases(F.col("t")), t=t) == phrases(t)


def test_cleaning(spark):
    raw = "WEBVTT\nKind: captions\n\n00:00:01.000 --> 00:00:02.000 align:start\n<c>>> Ann: Hello</c> [Musik] ♪ 12:30 SPEAKER 1: there"
    assert one(spark, text.clean_transcript(F.col("t"), dedup=False), t=raw) == "Hello 30 there"
    assert one(spark, text.slug(F.col("t")), t="Über die/Stadt!") == "über-die-stadt"
    assert one(spark, text.heading(F.col("t")), t="x\n# Top\n# Two") == "Top"
    assert one(spark, text.seconds(F.col("t")), t="01:02:03,500") == 3723.5
    assert one(spark, text.seconds(F.col("t")), t="bad") == 0.0
    assert one(spark, text.subtitle_format(F.col("t")), t="1\n00:00:01,000 --> x") == "srt"
    assert one(spark, text.rescue_json(F.col("t")), t='ok {"a":1} end') == '{"a":1}'


def test_cues(spark):
    vtt = "WEBVTT\n\n00:00:01.000 --> 00:00:02.500\nHi <b>you</b>\n\n00:00:03.000 --> 00:00:04.000\nlast"
    kept = one(spark, text.vtt_segments(F.col("t"), keep_last=True), t=vtt)
    assert [(c["start"], c["end"], c["content"]) for c in kept] == [(1.0, 2.5, "Hi you"), (3.0, 4.0, "last")]
    assert len(one(spark, text.vtt_segments(F.col("t")), t=vtt)) == 1
    srt = one(spark, text.srt_segments(F.col("t")), t="1\n00:00:01,000 --> 00:00:02,000\na\nb\n\n2\n00:00:03.000 --> 00:00:04.000\nc")
    assert [c["content"] for c in srt] == ["a b", "c"]


def test_chunks(spark):
    sentence = " ".join(["w"] * 9) + "."
    got = one(spark, text.chunk(text.sentences(F.col("t")), 30, 10), t=" ".join([sentence] * 6))
    assert [len(c.split()) for c in got] == [27, 27, 18]
    assert one(spark, text.chunk(text.sentences(F.col("t")), 5, 2), t=sentence) == [sentence]
    assert one(spark, text.chunk(text.sentences(F.col("t"))), t="") == []


def test_scalars(spark):
    assert one(spark, scalars.compact_date(F.col("t")), t="20240131") == "2024-01-31"
    assert one(spark, scalars.compact_date(F.col("t")), t="2024") is None
    assert [one(spark, scalars.backoff(F.lit(n))) for n in range(5)] == [60, 180, 540, 1620, 3600]
    assert one(spark, scalars.step_wait(F.lit(6))) is None


def plain_validation(doc):
    """The validator's rules, object by object."""
    get = lambda o, k, other: other if o.get(k) is None else o[k]
    entities, claims, themes = (doc.get(k) or [] for k in ("entities", "claims", "themes"))
    issues, warnings = [], []
    for target, objects, severity in (("entity", entities, "high"), ("claim", claims, "high"), ("theme", themes, "medium")):
        for o in objects:
            if any(o.get(f) is None for f in quality.REQUIRED[target]):
                issues.append(("missing_field", target, severity))
            if target == "entity" and o.get("entityType") and o["entityType"] not in quality.ENTITY_TYPES:
                issues.append(("invalid_entity_type", "entity", "medium"))
            if target == "claim" and o.get("category") and o["category"] not in quality.CATEGORIES:
                issues.append(("invalid_category", "claim", "low"))
    need = lambda c: [n for bound, n in quality.EVIDENCE_STEPS if c >= bound][-1]
    for c in claims:
        n = need(get(c, "confidence", 0))
        if len(get(c, "evidence", [])) < n:
            warnings.append(("insufficient_evidence", "claim", "medium" if n > 1 else "low"))
    warnings += [("missing_evidence", "entity", "medium") for e in entities if not e.get("evidence")]
    evidence = len(warnings)
    for c in claims:
        conf, n = get(c, "confidence", 0), len(get(c, "evidence", []))
        if conf >= 80 and n < 2:
            warnings.append(("confidence_mismatch", "claim", "medium"))
        if conf < 20 and n == 0:
            warnings.append(("low_confidence_no_evidence", "claim", "low"))
    warnings += [("confidence_mismatch", "entity", "high") for e in entities if get(e, "confidence", 0) >= 90 and not e.get("evidence")]
    known = {e["entityId"] for e in entities if e.get("entityId")}
    warnings += [("orphaned_entity_reference", "claim", "medium") for c in claims for i in get(c, "entityIds", []) if i not in known]
    names = [(e.get("normalizedName") or e.get("name") or "").lower() for e in entities]
    warnings += [("possible_duplicate", "entity", "low") for n in dict.fromkeys(names) if names.count(n) > 1]
    for x in doc.get("contradictions") or []:
        sides = x.get("sides") or []
        if len(sides) < 2:
            warnings.append(("incomplete_contradiction", "contradiction", "high"))
        warnings += [("missing_evidence", "contradiction", "medium") for y in sides if not y.get("evidence")]
    warnings += [("research_gap", "entity", "medium") for e in entities if not e.get("region") and e.get("entityType") in quality.REGIONAL]
    if not themes and entities:
        warnings.append(("research_gap", "story", "low"))
    if doc.get("beliefs") and not doc.get("rituals"):
        warnings.append(("research_gap", "story", "low"))
    speakers = {v["speaker"] for c in claims for v in get(c, "evidence", []) if v["speaker"]}
    if claims and len(speakers) <= 1:
        warnings.append(("research_gap", "story", "medium"))
    complete = 0.3 * bool(entities) + 0.3 * bool(claims) + 0.2 * bool(themes) + 0.2 * bool(doc.get("motifs"))
    confs = [get(o, "confidence", 0) / 100.0 for o in (*claims, *entities)]
    mean = sum(confs) / len(confs) if confs else 0.0
    clamp = lambda v: max(0.0, min(1.0, v))
    overall = clamp(complete * 0.25 + mean * 0.25 + clamp(1.0 - len(warnings) * 0.05) * 0.2 + clamp(1.0 - len(issues) * 0.1) * 0.2 + (1.0 - evidence * 0.05) * 0.1)
    return issues, warnings, (round(complete, 4), round(mean, 4), round(clamp(1.0 - len(warnings) * 0.05), 4), round(overall, 4))


def test_validation(spark):
    """Random documents with every gap, and empty ones, against the plain rules."""
    chance = random.Random(7)
    pick = chance.choice
    proof = lambda: pick([None, [], [{"text": "t", "speaker": "s"}], [{"text": "t", "speaker": pick(["s", "u", "", None])}] * 3])
    docs = [{"knowledgeId": "empty"}]
    for k in range(60):
        entity = lambda: {"entityId": pick(["a", "b", "", None]), "name": pick(["Ann", "ann", "Bo", None]), "normalizedName": pick([None, None, "bo"]), "entityType": pick(["spirit", "person", "odd", "", None]), "confidence": pick([None, 5, 19, 20, 80, 95]), "region": pick(["Bali", "", None]), "evidence": proof()}
        claim = lambda: {"claimId": pick(["c", None]), "statement": pick(["s", None]), "category": pick(["origin", "odd", "", None]), "confidence": pick([None, 5, 20, 45, 60, 80, 99]), "entityIds": pick([None, [], ["a", "lost"], ["lost", "lost"]]), "evidence": proof()}
        docs.append({
            "knowledgeId": str(k), "entities": pick([None, [entity() for _ in range(chance.randrange(5))]]), "claims": [claim() for _ in range(chance.randrange(5))], "themes": pick([None, [], [{"themeId": pick(["t", None]), "name": "n", "confidence": 1}]]),
            "motifs": pick([None, [{"name": "m"}]]), "beliefs": pick([None, [{"name": "b"}]]), "rituals": pick([None, [{"name": "r"}]]),
            "contradictions": pick([None, [{"contradictionId": "x", "sides": pick([None, [{"label": "l", "evidence": None}], [{"label": "l", "evidence": [{"text": "t", "speaker": "s"}]}] * 2])}]]),
        })
    names = [f.name for f in spark.createDataFrame([], quality.KNOWLEDGE).schema.fields]
    frame = spark.createDataFrame([[x.get(n) for n in names] for x in docs], quality.KNOWLEDGE)
    got = {r["knowledgeId"]: r for r in quality.validate(frame).collect()}
    for x in docs:
        issues, warnings, scores = plain_validation(x)
        r = got[x["knowledgeId"]]
        assert [(f["type"], f["target"], f["severity"]) for f in r["kinds"]] == issues + warnings
        assert [f["type"] for f in r["issues"]] == [i[0] for i in issues[:10]] and [f["type"] for f in r["warnings"]] == [w[0] for w in warnings[:20]]
        assert (r["completeness"], r["confidence"], r["consistency"], r["overall"]) == scores
        assert r["passed"] == (scores[3] >= 0.6)


def test_rounding_is_that_of_binary_values(spark):
    draw = np.random.default_rng(3)
    values = [0.125, 0.375, 2.675, 1.005, -0.125, -2.675, 0.0, 12345.678955, 1e-9, *draw.uniform(-100, 100, 400), *(draw.integers(0, 10**6, 400) / 2000), *(draw.integers(0, 10**6, 200) / 8192)]
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    for n in (2, 3, 4, 6, 8):
        for v, r in frame.select("v", scalars.round_even(F.col("v"), n)).collect():
            assert r == round(v, n), (v, n)


def test_states(spark):
    assert len(routing.STATES) == 23 and {b for to in routing.MOVES.values() for b in to} <= set(routing.STATES)
    rows = [("QUEUED", "METADATA_EXTRACTING", 0), ("QUEUED", "COMPLETED", 0), ("FAILED_LLM", "QUEUED", 9), ("CANONICALIZING", "FAILED_LLM", 2), ("CANONICALIZING", "FAILED_LLM", 3), (None, "QUEUED", None), ("COMPLETED", "QUEUED", 0), ("PUBLISHED", "MANUAL_REVIEW_REQUIRED", 0), ("GRAPH_READY", "COMPLETED", 0)]
    frame = spark.createDataFrame(rows, "current string, new string, retries int")
    got = {(r["current"], r["new"], r["retries"]): r["reason"] for r in routing.check_moves(frame).collect()}
    assert got == dict(zip(rows, [None, "invalid", None, None, "retries", None, "invalid", "invalid", None]))
    easy = {(r["current"], r["new"], r["retries"]): r["ok"] for r in routing.check_moves(frame, lenient=True).collect()}
    assert easy == dict(zip(rows, [True, False, True, True, True, True, False, True, True]))


def test_state_machine_on_a_stream(spark, tmp_path):
    """The stream's state gives what the fold over all requests gives."""
    draw = random.Random(2)
    rows = [(i % 7, i, draw.choice(routing.MOVES[draw.choice(routing.STATES)] or ("QUEUED",))) for i in range(400)]
    rows += [(9, 1000 + i, x) for i, x in enumerate(["QUEUED", *["FAILED_METADATA", "QUEUED"] * 5, "METADATA_EXTRACTING", "FAILED_METADATA"])]
    frame = spark.createDataFrame(rows, "video int, event_id long, new string")
    want = {r["event_id"]: (r["state"], r["retries"], r["ok"]) for r in routing.run_moves(frame, "video", "event_id").collect()}
    for part in range(2):
        frame.filter((F.col("event_id") % 1000 >= 200) == bool(part)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.state_machine(jobs.file_source(spark, f"{tmp_path}/in", "video int, event_id long, new string"), "video", routing.MOVES)
    done = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").option("path", f"{tmp_path}/out").outputMode("append").trigger(availableNow=True).start()
    done.awaitTermination(180)
    got = {r["event_id"]: (r["state"], r["retries"], r["ok"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == want
    assert want[1000 + 12] == ("METADATA_EXTRACTING", 3, False) or want[1011][1] == 3


def test_consume_once_in_effect(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.unionByName(events).write.parquet(f"{tmp_path}/in")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)
    jobs.consume(jobs.file_source(spark, f"{tmp_path}/in", schema), lambda df: df.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/ck").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == events.count()


def test_approximate_neighbours(spark, data):
    """Recall of the buckets against the exact scan."""
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    dim = len(vectors.first()["embedding"])
    queries = vectors.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query"), "embedding")
    got = {(r["query"], r["vec_id"]) for r in search.approximate_nearest(vectors, queries, "vec_id", "embedding", 10, dim).collect()}
    rows = vectors.collect()
    v = np.array([r["embedding"] for r in rows], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    want = set()
    for i, r in enumerate(rows):
        if r["vec_id"] % 25 == 0:
            order = sorted(range(len(rows)), key=lambda j: (-(v[i] @ v[j]), rows[j]["vec_id"]))[:10]
            want |= {(r["vec_id"], rows[j]["vec_id"]) for j in order}
    assert len(got & want) / len(want) >= 0.9


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, at int")
    assert {(r["k"], r["v"]) for r in payloads.upsert(rows.filter("at = 1"), rows.filter("at = 2"), "k", "at").collect()} == {(1, "b"), (2, "c")}
    back = payloads.crawl_sink(rows, f"file://{tmp_path}/crawl", "k")
    assert sorted(map(tuple, back.select("k", "v", "at").collect())) == [(1, "a", 1), (1, "b", 2), (2, "c", 1)]
    assert payloads.export(rows, f"file://{tmp_path}/x")["records"] == 3
    assert payloads.export(rows.select(F.raise_error(F.lit("no")).alias("x")), f"file://{tmp_path}/y")["status"] == "failed"
    keyed = jobs.records(spark.createDataFrame([("v", "p"), (None, "p"), (None, None)], "video_id string, pipeline_id string"))
    assert [r["key"] for r in keyed.collect()] == ["v", "p", None]


def test_access(spark):
    requests = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    matches = spark.createDataFrame([(1, "p", "DENY", 1, True), (1, "q", "ALLOW", 2, True), (2, "p", "DENY", 1, None), (2, "q", "ALLOW", 2, True)], "id int, policy string, effect string, place int, matched boolean")
    assert {r["id"]: r["allowed"] for r in access.deny_overrides(requests, matches, "id").collect()} == {1: False, 2: True, 3: True}
    assert {r["id"]: r["allowed"] for r in access.first_match(requests, matches, "id").collect()} == {1: False, 2: True, 3: False}
    assert filters.optional(requests, id=None).count() == 3


def test_graph_and_merge(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    got = {(r["node"], r["hops"]) for r in graph.reach(edges, spark.createDataFrame([(1,)], "node long"), 5).collect()}
    assert got == {(1, 0), (2, 1), (3, 2), (4, 3)}
    e = spark.createDataFrame([(1, 0, "ann", "Ann", 5, ["a"]), (1, 1, "ann", "ANN", 9, ["b", "a"])], "doc int, place int, canonical string, name string, confidence int, evidence array<string>")
    r = resolve.merge(e, "doc", "place").first()
    assert (r["name"], r["confidence"], r["evidence"], r["aliases"]) == ("Ann", 9, ["a", "b"], ["ANN"])


def test_subtitle_choice(spark):
    tracks = spark.createDataFrame([(1, "en", "vtt", False), (1, "id", "srt", False), (2, "xx", "vtt", False), (2, "xx", "ttml", False)], "v int, language string, format string, automatic boolean")
    got = {r["v"]: (r["language"], r["format"], r["automatic"]) for r in payloads.pick_subtitle(tracks, "v", ["id", "en"]).collect()}
    assert got == {1: ("id", "srt", False), 2: ("xx", "vtt", True)}


def test_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = events.unionByName(events)
    twice.write.parquet(f"{tmp_path}/in")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)
    stream = jobs.dedup(jobs.file_source(spark, f"{tmp_path}/in", schema))
    done = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    done.awaitTermination(120)
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(r["event_id"] for r in events.collect())


def test_dead_letters(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "id int, v int")
    jobs.split_bad("v >= 0", lambda g: g.write.parquet(f"{tmp_path}/good"), lambda b: b.write.parquet(f"{tmp_path}/dead"))(rows, 7)
    assert [r["id"] for r in spark.read.parquet(f"{tmp_path}/good").collect()] == [1]
    assert sorted((r["id"], r["batch"]) for r in spark.read.parquet(f"{tmp_path}/dead").collect()) == [(2, 7), (3, 7)]


def test_stale_filter(spark):
    rows = spark.createDataFrame([("A", datetime.datetime(2024, 1, 1)), ("A", datetime.datetime(2024, 1, 3)), ("B", datetime.datetime(2024, 1, 1))], "state string, ts timestamp")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert filters.stale(rows, "state", ["A"], "ts", "2024-01-02 00:00:00", 60).count() == 1


def test_upsert_of_equal_rows(spark, tmp_path):
    """Of lines that are equally late the table's first stays, as in SQL; the larger file, which Spark reads first, is the table's second."""
    columns = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double"
    first = [(k, 5, 2 + k % 2, 1.0) for k in range(40)]
    second = [(k, 5, 2 + k % 2, float(v)) for v in range(60, 1, -1) for k in range(40)] + [(7, 5, 1, 0.0)]
    for name, rows in (("a", first), ("b", second)):
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(str(tmp_path / name))
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        next((tmp_path / name).glob("*.parquet")).rename(tmp_path / "lineitem.parquet" / f"{name}.parquet")
    got = {tuple(r) for r in QUERIES["src02_upsert"](spark, str(tmp_path)).collect()}
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == set(con.execute(ORACLES["src02_upsert"]).fetchall()) == {(k, n, q) for k, _, n, q in first}
    rows = spark.createDataFrame([(1, "c", 5, 3), (1, "b", 5, 2), (2, "old", 5, 9)], "k int, v string, at int, place int")
    assert {(r["k"], r["v"]) for r in payloads.upsert(rows, rows.filter("k = 2").select("k", F.lit("new").alias("v"), "at", F.lit(1).alias("place")), "k", "at", "place").collect()} == {(1, "b"), (2, "old")}
