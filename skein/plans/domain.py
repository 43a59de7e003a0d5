"""QA, NM, RT, AC, VS, GR, LN families over the test tables."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.text import music_label, words
from skein.operators import access, graph, ordering, quality, resolve, routing, search, shared
from skein.registry import query
from skein.session import table as t

@query("qa17_captions", """WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(text || CASE WHEN conv_id % 3 = 0 AND turn = 0 THEN ' [Music]' WHEN conv_id % 3 = 1 AND turn = 0 THEN ' (MUSIC)' ELSE ' music' END, '\\s+'), lambda v: v <> '') AS w FROM conversations),
m AS (SELECT conv_id, count(*) AS n, count(DISTINCT v) AS u FROM w, unnest(w) x(v) GROUP BY conv_id), s AS (SELECT conv_id, count(*) AS seg, bool_or(len(list_filter(w, lambda v: lower(v) IN ('[music]', '(music)'))) > 0) AS music FROM w GROUP BY 1),
q AS (SELECT conv_id, round(least(1, greatest(0, 0.75 - CASE WHEN music THEN 0.15 ELSE 0 END - CASE WHEN m.n / s.seg < 3 THEN 0.1 ELSE 0 END - CASE WHEN m.u / m.n < 0.5 THEN 0.2 ELSE 0 END)), 4)::DOUBLE AS quality FROM s JOIN m USING (conv_id))
SELECT conv_id, quality, quality < 0.5 AS review FROM q""")
def captions(s, d):
    """Conversations as captions: some with a music label in one of its forms, all with the bare word."""
    mark = F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") == 0), " [Music]").when((F.col("conv_id") % 3 == 1) & (F.col("turn") == 0), " (MUSIC)").otherwise(" music")
    body = F.concat("text", mark)
    rows = t(s, d, "conversations").select("conv_id", words(body).alias("w"), music_label(body).alias("m"))
    df = rows.groupBy("conv_id").agg(F.count("*").alias("seg"), F.flatten(F.collect_list("w")).alias("w"), F.some("m").alias("music"))
    df = df.select("conv_id", quality.caption_quality(F.col("music"), F.col("seg"), F.size("w"), F.size(F.array_distinct("w"))).alias("quality")).filter("quality is not null")
    return df.withColumn("review", quality.caption_review(F.col("quality")))


@query("qa19_composite", "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_returnflag = 'R' THEN 0.4 * l_discount + 0.6 * l_tax ELSE 0.3 * l_discount + 0.4 * l_tax + 0.3 * 0.5 END, 6) AS score FROM lineitem")
def composite(s, d):
    review = F.when(F.col("l_returnflag") != "R", 0.5)
    score = quality.composite_confidence(F.col("l_discount"), F.col("l_tax"), review)
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(score, 6).alias("score"))


@query("qa20_bands", "SELECT event_id, b, (['Speculative', 'Low', 'Moderate', 'High', 'Very High'])[b] AS extraction, (['Rejected', 'Poor', 'Fair', 'Good', 'Excellent'])[b] AS validation, (['Rejected', 'Needs Major Revision', 'Needs Minor Revision', 'Approved with Notes', 'Approved'])[b] AS editorial FROM (SELECT event_id, greatest(1, least(5, ceil(floor(value) / 20)))::INT AS b FROM events WHERE value IS NOT NULL)")
def bands(s, d):
    v = F.floor("value")
    rows = t(s, d, "events").filter("value IS NOT NULL")
    number = F.greatest(F.lit(1), F.least(F.lit(5), F.ceil(v / 20))).cast("int")
    return rows.select("event_id", number.alias("b"), *[quality.confidence_label(v, kind).alias(kind) for kind in quality.CONFIDENCE_LABELS])


@query("qa21_golden", "SELECT p_partkey, p_size / 50.0 >= 0.4 AND p_partkey % 10 / 10.0 <= 0.6 AS passed, round(p_retailprice / 2000 - p_size / 50.0, 9) > 0.05 AS regressed FROM part")
def golden(s, d):
    new, bad = (F.col("p_size") / 50.0).cast("double"), (F.col("p_partkey") % 10 / 10.0).cast("double")
    cases = t(s, d, "part").select("p_partkey", (F.col("p_retailprice") / 2000).alias("old"), new.alias("new"), F.lit(0.4).alias("floor"), bad.alias("hallucination"), F.lit(0.6).alias("ceiling"))
    return quality.regressions(cases).select("p_partkey", "passed", "regressed")


@query("qa26_submission", "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND c_acctbal > 0 AND c_nationkey IS DISTINCT FROM o_orderkey % 25 AND o_orderkey % 11 > 0")
def submission(s, d):
    """Orders as stories: lines are evidence, a customer with means an entity; some have no reviewer, some their creator."""
    lines = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("evidence"))
    people = t(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("creator"), (F.col("c_acctbal") > 0).cast("int").alias("entities"))
    rows = t(s, d, "orders").join(lines, "o_orderkey", "left").join(people, "o_custkey", "left").withColumn("reviewer", F.when(F.col("o_orderkey") % 11 > 0, F.col("o_orderkey") % 25))
    return rows.filter(quality.submissible(F.col("evidence"), F.col("entities"), F.col("reviewer"), F.col("creator"))).select("o_orderkey")


@query("nm09_find_or_create", "SELECT user_id, min(event_id) AS event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) GROUP BY 1")
def find_or_create(s, d):
    held = t(s, d, "customer").filter("c_nationkey < 12").select(F.col("c_custkey").alias("user_id"))
    return resolve.find_or_create(held, t(s, d, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("rt02_chain", "SELECT doc_id, CASE WHEN length(text) * 100 < 100000 THEN 'small,large' WHEN length(text) * 100 < 800000 THEN 'large,long' ELSE 'long' END AS chain FROM documents")
def chain(s, d):
    return t(s, d, "documents").select("doc_id", F.array_join(routing.model_chain(F.length("text") * 100), ",").alias("chain"))


@query("rt03_first_success", "SELECT l_orderkey, min_by(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS l_partkey FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def success(s, d):
    df = t(s, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("place"), F.when(F.col("l_returnflag") != "R", F.col("l_partkey")).alias("l_partkey"))
    return routing.first_success(df, "l_orderkey", "place", "l_partkey").select("l_orderkey", "l_partkey")


@query("rt10_expand", "SELECT o_orderkey, step FROM orders, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS step) WHERE step <= CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_orderpriority = '5-LOW' THEN 2 WHEN o_orderpriority = '1-URGENT' THEN 5 ELSE 4 END")
def expand(s, d):
    p = F.when(F.col("o_orderpriority") == "5-LOW", "LOW").when(F.col("o_orderpriority") == "1-URGENT", "HIGH")
    runs = t(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "ingestion_only").otherwise("full").alias("kind"), p.alias("priority"))
    return routing.expand_runs(runs, "kind", "priority").select("o_orderkey", "step")


@query("rt13_outbox", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'PUBLISHED' WHEN event_id % 6 + 1 >= 5 THEN 'DEAD_LETTER' ELSE 'PENDING' END AS status, event_id % 6 + CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS attempts FROM events")
def outbox(s, d):
    status_, tries = routing.next_step(F.col("event_type") == "view", F.col("event_id") % 6)
    return t(s, d, "events").select("event_id", status_.alias("status"), tries.alias("attempts"))


KINDS = ("StoryCreated", "SourceAdded", "TranscriptReady", "KnowledgeExtracted", "ArticleGenerated", "ReviewOpened", "PublicationDone", "CollectionShared", "AnnotationAdded", "ExportReady", "UserInvited", "RoleGranted", "TenantClosed", "storyLow", "Odd", "")


@query("rt14_topic", "SELECT event_id, CASE WHEN regexp_matches(k, '^Knowledge') THEN 'knowledge.evt' WHEN regexp_matches(k, '^(Review|Publication)') THEN 'workflow.evt' WHEN regexp_matches(k, '^(Collection|Annotation|Export)') THEN 'research.evt' WHEN regexp_matches(k, '^(User|Role|Tenant)') THEN 'identity.evt' ELSE 'content.evt' END AS topic FROM (SELECT event_id, (" + str(list(KINDS)) + ")[event_id % 16 + 1] AS k FROM events)")
def topic(s, d):
    """Every event as a domain event of one of the types, known or not."""
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), (F.col("event_id") % len(KINDS)).cast("int"))
    return t(s, d, "events").select("event_id", routing.event_topic(kind).alias("topic"))


@query("ac01_permission", "SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS ok FROM customer")
def permission(s, d):
    perms = F.array(F.lit("building:*"), F.lit("machinery:read"))
    return t(s, d, "customer").select("c_custkey", access.permitted(perms, F.lower("c_mktsegment"), F.lit("read")).alias("ok"))


def rule_matches(s, d):
    rules = F.array(
        F.struct(F.lit("a").alias("policy"), F.lit("DENY").alias("effect"), F.lit(1).alias("place"), (F.col("c_acctbal") < 0).alias("matched")),
        F.struct(F.lit("b").alias("policy"), F.lit("ALLOW").alias("effect"), F.lit(2).alias("place"), (F.col("c_nationkey") < 10).alias("matched")),
        F.struct(F.lit("b").alias("policy"), F.lit("ALLOW").alias("effect"), F.lit(2).alias("place"), (F.col("c_mktsegment") == "BUILDING").alias("matched")),
    )
    return t(s, d, "customer").select("c_custkey", F.inline(rules))


@query("ac02_deny_overrides", "SELECT c_custkey, NOT (c_acctbal < 0) AS allowed FROM customer")
def deny(s, d):
    return access.deny_overrides(t(s, d, "customer").select("c_custkey"), rule_matches(s, d), "c_custkey")


@query("ac03_first_match", "SELECT c_custkey, c_acctbal >= 0 AND c_nationkey < 10 AND c_mktsegment = 'BUILDING' AS allowed FROM customer")
def first_match(s, d):
    return access.first_match(t(s, d, "customer").select("c_custkey"), rule_matches(s, d), "c_custkey")


@query("ac05_tenant_rows", "SELECT c_custkey FROM customer WHERE (c_nationkey = 7 OR c_nationkey % 5 = 0) AND (NOT c_acctbal < 0 OR c_custkey % 4 IN (1, 2))")
def tenant(s, d):
    df = t(s, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 5 > 0, F.col("c_nationkey")).alias("tenant"), (F.col("c_acctbal") < 0).alias("draft"), (F.col("c_custkey") % 4).alias("ws"))
    return access.visible(df, "tenant", 7, draft="draft", workspace="ws", workspaces=(1, 2)).select("c_custkey")


@query("ac07_audit", "SELECT event_id FROM events WHERE user_id % 7 = 1 AND event_type = 'click' AND ts > TIMESTAMP '2024-01-10 00:00:00'")
def audit(s, d):
    return t(s, d, "events").filter("user_id % 7 = 1 AND event_type = 'click' AND ts > TIMESTAMP_NTZ '2024-01-10 00:00:00'").select("event_id")


@query("vs01_nearest", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) DESC, vec_id LIMIT 10")
def nearest(s, d):
    v = t(s, d, "embeddings")
    return search.nearest_to(v, v.filter("vec_id = 0"), "vec_id", "embedding", 10).select("vec_id", F.round("score", 6).alias("score"))


BM = """WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda v: v <> '') AS w FROM documents),
f AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
tf AS (SELECT doc_id, len(w) AS l, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM w) WHERE term IN ('the', 'thand', 'erin') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
b AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) AS score FROM tf JOIN df USING (term), f GROUP BY 1)
"""
QUERY = ["the", "thand", "erin"]


def low_words():
    return words(F.lower("text"))


@query("vs03_bm25", BM + "SELECT doc_id, round(score, 6) AS score FROM b")
def bm25(s, d):
    return search.bm25(t(s, d, "documents"), "doc_id", low_words(), QUERY).select("doc_id", F.round("score", 6).alias("score"))


HYBRID = BM + ", v AS (SELECT vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings) SELECT coalesce(v.doc_id, b.doc_id) AS doc_id, round({a} * coalesce(v.score / (SELECT max(score) FROM v), 0) + {b} * coalesce(b.score / (SELECT max(score) FROM b), 0), 6) AS score FROM v FULL JOIN b ON v.doc_id = b.doc_id"


def hybrid_search(s, d, alpha):
    v = t(s, d, "embeddings")
    near = search.similarities(v, v.filter("vec_id = 0"), "vec_id", "embedding").withColumnRenamed("vec_id", "doc_id")
    words_ = search.bm25(t(s, d, "documents"), "doc_id", low_words(), QUERY)
    return search.hybrid(near, words_, "doc_id", alpha).select("doc_id", F.round("score", 6).alias("score"))


@query("vs04_hybrid", HYBRID.format(a="0.75", b="0.25"))
def hybrid(s, d):
    return hybrid_search(s, d, None)


@query("vs06_alpha", HYBRID.format(a="0.0", b="1.0"))
def alpha(s, d):
    """0 is an alpha like any other: keywords alone."""
    return hybrid_search(s, d, 0.0)


@query("vs09_relevance", """WITH f AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS text, CASE WHEN p_partkey % 3 > 0 THEN p_retailprice / 1500 END AS semantic, (p_partkey % 10) / 10.0::DOUBLE AS relationship, (p_partkey % 4) / 4.0::DOUBLE AS evidence, CASE WHEN p_partkey % 5 = 0 THEN 1.0::DOUBLE END AS review, (p_partkey % 7) / 7.0::DOUBLE AS popularity,
power(0.5, ((p_partkey % 400) / 180.0::DOUBLE)) AS freshness FROM part)
SELECT p_partkey, round((0.25 * text + 0.25 * CASE WHEN semantic > 1 THEN 1 ELSE coalesce(semantic, 0) END + 0.15 * relationship + 0.15 * evidence + 0.1 * coalesce(review, 0) + 0.03 * popularity + 0.07 * freshness) / (0.65 + CASE WHEN semantic IS NULL THEN 0 ELSE 0.25 END + CASE WHEN review IS NULL THEN 0 ELSE 0.1 END), 6) AS relevance FROM f""")
def relevance(s, d):
    k = F.col("p_partkey")
    now = F.lit("2024-06-01").cast("date")
    rows = t(s, d, "part").select(
        k, (F.col("p_size") / 50.0).alias("text"), F.when(k % 3 > 0, F.col("p_retailprice") / 1500).alias("semantic"), ((k % 10) / 10.0).alias("relationship"), ((k % 4) / 4.0).alias("evidence"),
        F.when(k % 5 == 0, 1.0).alias("review"), ((k % 7) / 7.0).alias("popularity"), search.freshness(F.date_sub(now, (k % 400).cast("int")), now).alias("freshness"),
    )
    return search.relevance(rows, "p_partkey").select("p_partkey", F.round("relevance", 6).alias("relevance"))


@query("vs08_trigrams", """WITH g AS (SELECT p_partkey, p_name, list_distinct(list_transform(range(1, length(p_name) + 2), lambda i: substring('  ' || lower(p_name) || ' ', i, 3))) AS g FROM part),
q AS (SELECT list_distinct(list_transform(range(1, length('small gizmo') + 2), lambda i: substring('  small gizmo ', i, 3))) AS q)
SELECT p_partkey, round(len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q)))::DOUBLE, 6) AS score FROM g, q WHERE len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q)))::DOUBLE >= 0.3""")
def trigram_search(s, d):
    return search.similar_names(t(s, d, "part"), "p_name", "small gizmo", 0.3).select("p_partkey", F.round("score", 6).alias("score"))


ALL_EDGES = "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem"


def all_edges(s, d):
    return t(s, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


@query("gr03_neighbours", f"WITH e AS ({ALL_EDGES}), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e) SELECT s_suppkey, coalesce(string_agg(dst::VARCHAR, ',' ORDER BY dst), '') AS near FROM supplier LEFT JOIN u ON src = s_suppkey GROUP BY 1")
def neighbours(s, d):
    return graph.neighbours(t(s, d, "supplier"), all_edges(s, d), "s_suppkey").select("s_suppkey", F.array_join(F.transform("near", lambda v: v.cast("string")), ",").alias("near"))


@query("gr04_two_hops", f"WITH e AS ({ALL_EDGES}), p AS (SELECT x.src AS a, y.src AS b, count(*) AS shared FROM e x JOIN e y USING (dst) WHERE x.src <> y.src GROUP BY ALL) SELECT a, b, shared FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS r FROM p) WHERE r <= 50")
def two_hops(s, d):
    """For each supplier the 50 others with the most parts in common."""
    return shared.most_shared(all_edges(s, d), 50)


@query("gr08_similarity", f"WITH e AS ({ALL_EDGES}), p AS (SELECT x.src AS a, y.src AS b, count(*) AS shared FROM e x JOIN e y USING (dst) WHERE x.src < y.src GROUP BY ALL) SELECT * FROM p ORDER BY shared DESC, a, b LIMIT 10")
def similar(s, d):
    return graph.shared_neighbours(all_edges(s, d)).orderBy(F.col("shared").desc(), "a", "b").limit(10)


@query("gr09_reach", """WITH RECURSIVE e AS (SELECT DISTINCT n_regionkey::BIGINT AS src, (n_nationkey + 100)::BIGINT AS dst FROM nation UNION SELECT n_nationkey + 100, (n_regionkey + 1) % 5 FROM nation),
w AS (SELECT 0::BIGINT AS node, 0 AS hops UNION SELECT dst, hops + 1 FROM w JOIN e ON src = node WHERE hops < 3) SELECT 0::BIGINT AS start, node, min(hops) AS hops FROM w GROUP BY node""")
def reach(s, d):
    n = t(s, d, "nation")
    e = n.select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey") + 100).cast("long").alias("dst")).union(n.select((F.col("n_nationkey") + 100).cast("long"), ((F.col("n_regionkey") + 1) % 5).cast("long"))).distinct()
    return graph.reach(e, s.range(1).select(F.col("id").alias("node")), 3)


@query("gr12_degrees", f"WITH e AS ({ALL_EDGES}) SELECT src, count(*) AS degree FROM e GROUP BY 1")
def degrees(s, d):
    return all_edges(s, d).groupBy("src").agg(F.count("*").alias("degree"))


@query("gr14_hierarchy", """WITH RECURSIVE h AS (SELECT n_nationkey AS node, n_nationkey AS root, 0 AS level FROM nation UNION ALL SELECT node, (root // 2)::INT, level + 1 FROM h WHERE root > 0 AND level < 8) SELECT node, min(root) AS root, max(level) AS level FROM h GROUP BY 1""")
def hierarchy(s, d):
    n = t(s, d, "nation").select(F.col("n_nationkey").alias("node"), F.when(F.col("n_nationkey") > 0, F.floor(F.col("n_nationkey") / 2).cast("int")).alias("parent"))
    return graph.roots(n, 8)


@query("ln01_forward", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_suppkey = 3")
def forward(s, d):
    return t(s, d, "lineitem").filter("l_suppkey = 3").select("l_orderkey", "l_partkey")


@query("ln02_backward", "SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_partkey = 7")
def backward(s, d):
    return t(s, d, "lineitem").filter("l_partkey = 7").orderBy("l_shipdate", "l_orderkey").select("l_orderkey", "l_suppkey")


@query("ln04_trace", """WITH RECURSIVE p AS (SELECT n_nationkey AS node, CASE WHEN n_nationkey > 2 THEN (n_nationkey - 3)::INT END AS parent FROM nation),
h AS (SELECT node, node AS root, 0 AS level FROM p UNION ALL SELECT h.node, p.parent, level + 1 FROM h JOIN p ON p.node = h.root WHERE p.parent IS NOT NULL)
SELECT node AS target, arg_max(root, level) AS source, max(level) AS steps FROM h GROUP BY node""")
def trace(s, d):
    n = t(s, d, "nation").filter("n_nationkey > 2")
    late = n.select(F.col("n_nationkey").alias("target"), F.lit(0).alias("source"), F.lit(2).alias("created"))
    first = n.select(F.col("n_nationkey").alias("target"), (F.col("n_nationkey") - 3).alias("source"), F.lit(1).alias("created"))
    return graph.trace(late.union(first), 10)


@query("ln06_producer", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING' LEFT JOIN nation ON n_nationkey = c_nationkey")
def producer(s, d):
    c = t(s, d, "customer").filter("c_mktsegment = 'BUILDING'")
    return t(s, d, "orders").join(c, F.col("c_custkey") == F.col("o_custkey"), "left").join(t(s, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("ln08_versions", """WITH h AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS version, l_partkey FROM lineitem), n AS (SELECT l_orderkey, max(version) AS last FROM h GROUP BY 1)
SELECT l_orderkey, version, l_partkey, NULL::BIGINT AS restored_from FROM h UNION ALL SELECT l_orderkey, last + 1, l_partkey, version FROM h JOIN n USING (l_orderkey) WHERE l_orderkey % 2 = 1 AND version = 1 + l_orderkey % 3""")
def versions(s, d):
    """Lines as an order's versions; odd orders are rolled back to one of the first three, if they have it: a new version."""
    line = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    history = t(s, d, "lineitem").select("l_orderkey", F.row_number().over(line).cast("long").alias("version"), "l_partkey")
    targets = t(s, d, "orders").filter("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("l_orderkey"), (1 + F.col("o_orderkey") % 3).alias("to"))
    return ordering.roll_back(history, targets, "l_orderkey", "version")


@query("ln09_citation", """SELECT p_partkey, p_brand || ' (' || p_size || '). ' || p_name || '. Archive. https://x.test/' || p_partkey AS apa, p_brand || '. "' || p_name || '." Archive, ' || p_size || ', https://x.test/' || p_partkey || '.' AS mla,
p_brand || '. "' || p_name || '." Archive. ' || p_size || '. https://x.test/' || p_partkey || '.' AS chicago, p_brand || ', "' || p_name || '," Archive, ' || p_size || '. [Online]. Available: https://x.test/' || p_partkey AS ieee FROM part""")
def citation(s, d):
    url = F.concat(F.lit("https://x.test/"), F.col("p_partkey").cast("string"))
    made = graph.citations(F.col("p_brand"), F.col("p_size").cast("string"), F.col("p_name"), F.lit("Archive"), url)
    return t(s, d, "part").select("p_partkey", *[v.alias(k) for k, v in made.items()])
