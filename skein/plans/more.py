"""The rest of the inventory: subtitles, state tables, graph projections, lineage, work lists."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import scalars as sc
from skein.functions import text as x
from skein.operators import access, graph, ordering, projection, routing, search, vector_index
from skein.plans.knowledge import sql_even
from skein.plans.scalars import phrase_dedup
from skein.registry import query
from skein.session import table as t
from skein.storage import stored
from skein.streaming import jobs


def vtt(s, d):
    """Conversations as WebVTT texts: a cue a turn, some texts without an end of line."""
    stamp = lambda c: F.concat(F.lit("00:"), F.lpad(c.cast("string"), 2, "0"), F.lit(":00.500"))
    cue = F.concat(stamp(F.col("turn")), F.lit(" --> "), stamp(F.col("turn") + 1), F.lit(" align:start\n<c>"), F.regexp_replace("text", r"\s+", " "), F.lit("</c>\n"))
    rows = t(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", cue.alias("cue")))).alias("all"))
    end = F.when(F.col("conv_id") % 2 == 0, F.lit("\n")).otherwise(F.lit(""))
    return rows.select("conv_id", F.concat(F.lit("WEBVTT\nKind: captions\n\n"), F.array_join("all.cue", "\n"), end).alias("text"), F.size("all").cast("long").alias("turns"))


FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query("tx02_content_lines", f"SELECT conv_id, string_agg('<c>' || regexp_replace(text, '\\s+', ' ', 'g') || '</c>', ' ' ORDER BY turn) AS body FROM conversations GROUP BY 1")
def content(s, d):
    return vtt(s, d).select("conv_id", x.content_lines(F.col("text")).alias("body"))


CLEAN = "SELECT conv_id AS id, trim(regexp_replace(regexp_replace(string_agg(regexp_replace(text, '\\s+', ' ', 'g'), ' ' ORDER BY turn), '[\\p{L}\\p{N}_]+\\s*:', '', 'g'), '\\s+', ' ', 'g')) AS text FROM conversations GROUP BY 1"


@query("tx01_clean_transcript", f"WITH {phrase_dedup(CLEAN)} SELECT id AS conv_id, trim(body) AS body FROM body")
def clean(s, d):
    return vtt(s, d).select("conv_id", x.clean_transcript(F.col("text")).alias("body"))


CUES = "SELECT conv_id, turn, (turn * 60 + 0.5)::DOUBLE AS start, ((turn + 1) * 60 + 0.5)::DOUBLE AS stop, {FLAT} AS content FROM conversations"


def cue_rows(df):
    return df.select("conv_id", F.col("c.start").alias("start"), F.col("c.end").alias("stop"), F.col("c.content").alias("content"))


@query("tx11_vtt_segments", f"SELECT conv_id, start, stop, content FROM ({CUES.format(FLAT=FLAT)}) q WHERE conv_id % 2 = 0 OR turn < (SELECT max(turn) FROM conversations m WHERE m.conv_id = q.conv_id)")
def segments(s, d):
    # the last cue ends in one line end: without an empty line behind it, it is lost
    lost = vtt(s, d).withColumn("text", F.when(F.col("conv_id") % 2 == 0, F.col("text")).otherwise(F.regexp_replace("text", "\n$", "")))
    return cue_rows(lost.select("conv_id", F.explode(x.vtt_segments(F.col("text"))).alias("c")))


@query("tx12_vtt_blocks", f"SELECT conv_id, start, stop, content FROM ({CUES.format(FLAT=FLAT)})")
def blocks(s, d):
    return cue_rows(vtt(s, d).select("conv_id", F.explode(x.vtt_segments(F.col("text"), keep_last=True)).alias("c")))


@query("tx13_srt_segments", f"SELECT conv_id, start, stop, content FROM ({CUES.format(FLAT=FLAT)})")
def srt(s, d):
    body = F.regexp_replace(F.regexp_replace("text", r"^WEBVTT\nKind: captions\n\n", ""), r"(\d)\.(\d{3})", "$1,$2")
    return cue_rows(vtt(s, d).select("conv_id", F.explode(x.srt_segments(body)).alias("c")))


@query("tx15_light_clean", f"SELECT conv_id, turn, {FLAT} AS body FROM conversations")
def light(s, d):
    return t(s, d, "conversations").select("conv_id", "turn", x.light_clean(F.concat(F.lit("<b>>> X: </b>"), "text")).alias("body"))


@query("st03_jaccard", """WITH w AS (SELECT conv_id, turn, list_filter(list_distinct(string_split_regex(lower(string_agg(text, ' ' ORDER BY text)), '\\s+')), lambda v: v <> '') AS w FROM conversations GROUP BY conv_id, turn)
SELECT a.conv_id, a.turn, round(CASE WHEN len(a.w) + len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END, 6)::DOUBLE AS j FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def st03(s, d):
    """The word sets of every turn and the next."""
    w = t(s, d, "conversations").groupBy("conv_id", "turn").agg(F.array_distinct(x.lower_words(F.array_join(F.array_sort(F.collect_list("text")), " "))).alias("w"))
    after = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return w.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(x.jaccard(F.col("w"), F.col("v")), 6).alias("j"))


@query("st06_ordered_union", """WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(string_agg(text, ' ' ORDER BY text)), '\\s+'), lambda v: v <> '') AS w FROM conversations GROUP BY conv_id, turn),
p AS (SELECT a.conv_id, a.turn, list_concat(a.w, b.w) AS l FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), e AS (SELECT conv_id, turn, generate_subscripts(l, 1) AS i, unnest(l) AS v FROM p), f AS (SELECT conv_id, turn, v, min(i) AS i FROM e GROUP BY ALL)
SELECT conv_id, turn, string_agg(v, ' ' ORDER BY i) AS u FROM f GROUP BY ALL""")
def st06(s, d):
    """The words of every turn in their order, those of the next that are new after them."""
    w = t(s, d, "conversations").groupBy("conv_id", "turn").agg(x.lower_words(F.array_join(F.array_sort(F.collect_list("text")), " ")).alias("w"))
    after = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return w.join(after, ["conv_id", "turn"]).filter(F.size("w") + F.size("v") > 0).select("conv_id", "turn", F.array_join(F.array_union("w", "v"), " ").alias("u"))


@query("wn05_first_wins", "SELECT c_nationkey, c_mktsegment, min(c_custkey) AS c_custkey FROM customer GROUP BY ALL")
def first_wins(s, d):
    return ordering.latest(t(s, d, "customer"), ["c_nationkey", "c_mktsegment"], F.col("c_custkey")).select("c_nationkey", "c_mktsegment", "c_custkey")


@query("flt18_success_only", "SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1")
def success_only(s, d):
    return t(s, d, "events").filter("event_type <> 'error'").groupBy("event_type").agg(F.count("*").alias("n"))


@query("mth01_rounding", "SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(f"{sql_even('l_extendedprice / 7 / 10000', n)} AS r{n}" for n in (2, 3, 4, 6, 8)) + f", {sql_even('l_quantity / 8', 2)} AS tie FROM lineitem")
def rounding(s, d):
    x7 = F.col("l_extendedprice") / 7 / 10000
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[sc.round_even(x7, n).alias(f"r{n}") for n in (2, 3, 4, 6, 8)], sc.round_even(F.col("l_quantity") / 8, 2).alias("tie"))


@query("mth04_weighted", "SELECT l_orderkey, l_linenumber, l_partkey, round(0.4 * l_discount + 0.6 * l_tax, 6) AS v FROM lineitem")
def weighted(s, d):
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(0.4 * F.col("l_discount") + 0.6 * F.col("l_tax"), 6).alias("v"))


@query("mth08_budget_share", "SELECT c_custkey, round(c_acctbal * 100 / 5000, 6) AS pct FROM customer")
def share(s, d):
    return t(s, d, "customer").select("c_custkey", F.round(F.col("c_acctbal") * 100 / 5000, 6).alias("pct"))


@query("ar02_flatten", "SELECT l_orderkey, count(*) * 2 AS n FROM lineitem GROUP BY 1")
def flatten(s, d):
    nested = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.array("l_partkey", "l_suppkey")).alias("a"))
    return nested.select("l_orderkey", F.size(F.flatten("a")).cast("long").alias("n"))


@query("mp02_attributes", "SELECT c_custkey, c_mktsegment AS v FROM customer")
def attributes(s, d):
    bag = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"))
    return t(s, d, "customer").select("c_custkey", F.try_element_at(bag, F.substring(F.lit("user.segment"), 6, 50)).alias("v"))


@query("js03_build", """SELECT c_custkey, '{"id":"' || c_custkey || '"}' AS j FROM customer""")
def build(s, d):
    return t(s, d, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_custkey").cast("string").alias("id"))).alias("j"))


@query("qa24_defaults", "SELECT d.doc_id, coalesce(l.quality, 0.5)::DOUBLE AS score, coalesce(l.toxic = 0, false) AS ready FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def defaults(s, d):
    df = t(s, d, "documents").select("doc_id").join(t(s, d, "labels"), "doc_id", "left")
    return df.select("doc_id", F.coalesce(F.col("quality").cast("double"), F.lit(0.5)).alias("score"), F.coalesce(F.col("toxic") == 0, F.lit(False)).alias("ready"))


@query("rt01_tier", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'review' WHEN doc_id % 3 = 0 THEN 'manual' WHEN length(text) > 1000 THEN 'automatic' WHEN doc_id % 2 = 0 THEN 'cloud' ELSE 'error' END AS tier, CASE WHEN doc_id % 7 = 0 THEN 1.0 WHEN doc_id % 3 = 0 THEN 0.95 WHEN length(text) > 1000 THEN 0.75 WHEN doc_id % 2 = 0 THEN 0.9 END::DOUBLE AS score FROM documents")
def tier(s, d):
    i = F.col("doc_id")
    kind, score = routing.tier(i % 7 == 0, i % 3 == 0, F.when(F.length("text") > 1000, F.lit(0.75)), i % 2 == 0)
    return t(s, d, "documents").select("doc_id", kind.alias("tier"), score.alias("score"))


@query("ac06_graph_tenant", "SELECT n_nationkey FROM nation WHERE n_regionkey = 2 OR n_regionkey = 0")
def graph_tenant(s, d):
    nodes = t(s, d, "nation").withColumn("tenant", F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")))
    return access.visible(nodes, "tenant", 2).select("n_nationkey")


@query("vs05_boosts", """WITH f AS (SELECT doc_id, list_filter(string_split_regex(lower(source), '\\s+'), lambda v: v <> '') AS a, list_filter(string_split_regex(lower(string_split(text, chr(10))[1]), '\\s+'), lambda v: v <> '') AS b, list_filter(string_split_regex(lower(text), '\\s+'), lambda v: v <> '') AS c FROM documents),
s AS (SELECT doc_id, lambda_score.* FROM f, LATERAL (SELECT coalesce(len(list_filter(a, lambda v: v IN ('the', 'der', 'src1'))) / nullif(len(a), 0), 0) AS x, coalesce(len(list_filter(b, lambda v: v IN ('the', 'der', 'src1'))) / nullif(len(b), 0), 0) AS y, coalesce(len(list_filter(c, lambda v: v IN ('the', 'der', 'src1'))) / nullif(len(c), 0), 0) AS z) lambda_score)
SELECT doc_id, round(2.0 * x + 1.5 * y + z, 6)::DOUBLE AS score FROM s""")
def boosts(s, d):
    """Documents by hits in source (as title), first line (as summary) and text."""
    first = F.get(F.split("text", "\n"), F.lit(0))
    return t(s, d, "documents").select("doc_id", F.round(search.boosted([F.col("source"), first, F.col("text")], ["The", "der", "src1"]), 6).alias("score"))


@query("vs07_merge", "SELECT vec_id FROM embeddings ORDER BY CASE WHEN label < 5 THEN abs(embedding[1])::DOUBLE ELSE 1.0 END, vec_id LIMIT 20")
def vs07(s, d):
    v = t(s, d, "embeddings").withColumn("distance", F.when(F.col("label") < 5, F.abs(F.get("embedding", F.lit(0))).cast("double"))).select("vec_id", "label", "distance")
    return ordering.merge_hits([v.filter("label < 5"), v.filter("label >= 5")], "distance", 20, F.col("vec_id")).select("vec_id")


@query("vs11_work_list", "SELECT label, count(*) FILTER (WHERE vec_id % 3 > 0 AND label <> 4 AND vec_id % 5 > 0) AS pending, count(*) FILTER (WHERE vec_id % 3 > 0 AND label <> 4 AND vec_id % 5 > 0) = 0 AS complete FROM embeddings GROUP BY 1")
def work_list(s, d):
    """What an old model's replacement has left to do for each kind of content, and which kinds are done."""
    rows = t(s, d, "embeddings").select("vec_id", "label", F.when((F.col("vec_id") % 3 > 0) & (F.col("label") != 4), "old").otherwise("new").alias("model"), (F.col("vec_id") % 5 > 0).alias("current"))
    return search.reembedding(rows, "label", "model", "current", "old")[1]


@query("vs11_pending", "SELECT vec_id FROM embeddings WHERE vec_id % 3 > 0 AND label <> 4 AND vec_id % 5 > 0")
def pending(s, d):
    rows = t(s, d, "embeddings").select("vec_id", "label", F.when((F.col("vec_id") % 3 > 0) & (F.col("label") != 4), "old").otherwise("new").alias("model"), (F.col("vec_id") % 5 > 0).alias("current"))
    return search.reembedding(rows, "label", "model", "current", "old")[0].select("vec_id")


def order_stories(s, d):
    """Orders as canonical stories of the version of their number: lines' suppliers are entities, parts claims; the customer's nation a location, the priority a belief, the status a ritual; the suppliers of two returned lines are related by name."""
    kind = lambda c, prefix: F.concat(F.lit(prefix), c.cast("string"))
    lines = t(s, d, "lineitem")
    entity = F.struct(kind(F.col("l_suppkey"), "e").alias("id"), kind(F.floor(F.col("l_suppkey") / 3), "Name").alias("name"), F.col("l_returnflag").alias("role"), F.col("l_quantity").cast("int").alias("confidence"))
    claim = F.struct(kind(F.col("l_partkey"), "k").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("name"), F.col("l_linestatus").alias("claim_type"), F.col("l_returnflag").alias("veracity"))
    lines = lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus").repartition("l_orderkey")  # as they are: the texts are made where the story is
    held = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(entity).alias("entities"), F.collect_list(claim).alias("claims"), F.min(F.when(F.col("l_returnflag") == "R", F.floor(F.col("l_suppkey") / 3))).alias("a"), F.max(F.when(F.col("l_returnflag") == "R", F.floor(F.col("l_suppkey") / 3))).alias("b"))
    people = t(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rows = t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus").join(people, "o_custkey").join(held, "o_orderkey")
    sure = (F.col("o_orderkey") % 90).cast("int")
    one = lambda c, prefix: F.array(F.struct(kind(c, prefix).alias("id"), c.cast("string").alias("name"), sure.alias("confidence")))
    tie = F.struct(kind(F.col("a"), "Name").alias("source"), kind(F.col("b"), "Name").alias("target"), F.lit("NEAR").alias("type"), sure.alias("confidence"))
    ties = F.when(F.col("a") < F.col("b"), F.array(tie)).otherwise(F.array().cast("array<struct<source:string,target:string,type:string,confidence:int>>"))
    return rows.select(
        kind(F.col("o_orderkey"), "o").alias("story_id"), F.col("o_orderkey").cast("long").alias("version"), kind(F.col("o_orderkey"), "Order ").alias("title"), "entities", "claims",
        one(F.col("c_nationkey"), "l").alias("locations"), one(F.col("o_orderpriority"), "b").alias("beliefs"), one(F.col("o_orderstatus"), "r").alias("rituals"), ties.alias("relationships"),
    )


HELD = """WITH x AS (SELECT o_orderkey AS v, c_nationkey, o_orderpriority, o_orderstatus, o_orderkey % 90 AS sure FROM orders JOIN customer ON c_custkey = o_custkey WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)),
l AS (SELECT lineitem.* FROM lineitem JOIN x ON v = l_orderkey)
"""


@query("gr01_nodes", HELD + """SELECT 'Story' AS label, 'o' || v AS id, 'Order ' || v AS name FROM x UNION ALL SELECT DISTINCT 'Entity', 'e' || l_suppkey, 'Name' || l_suppkey // 3 FROM l UNION ALL SELECT DISTINCT 'Location', 'l' || c_nationkey, c_nationkey::VARCHAR FROM x
UNION ALL SELECT DISTINCT 'Belief', 'b' || o_orderpriority, o_orderpriority FROM x UNION ALL SELECT DISTINCT 'Ritual', 'r' || o_orderstatus, o_orderstatus FROM x UNION ALL SELECT 'Claim', 'k' || l_partkey, arg_max(l_returnflag || l_linestatus, lpad(l_orderkey::VARCHAR, 12, '0') || l_returnflag || l_linestatus) FROM l GROUP BY l_partkey""")
def nodes(s, d):
    """Nodes of all six labels; a claim that comes again says what the last story says of it."""
    return projection.nodes(order_stories(s, d))


@query("gr02_edges", HELD + """, n AS (SELECT DISTINCT 'e' || l_suppkey AS id, 'Name' || l_suppkey // 3 AS name FROM l),
r AS (SELECT l_orderkey, min(l_suppkey // 3) AS a, max(l_suppkey // 3) AS b FROM l WHERE l_returnflag = 'R' GROUP BY 1), t AS (SELECT 'Name' || a AS source, 'Name' || b AS target, arg_max(v % 90, v) AS sure FROM r JOIN x ON v = l_orderkey WHERE a < b GROUP BY ALL)
SELECT 'APPEARS_IN' AS type, 'e' || l_suppkey AS src, 'o' || l_orderkey AS dst, max('{"role":"' || l_returnflag || '","confidence":' || l_quantity::INT || '}') AS properties FROM l GROUP BY l_suppkey, l_orderkey
UNION ALL SELECT 'CONTAINS_CLAIM', 'o' || l_orderkey, 'k' || l_partkey, max('{"claim_type":"' || l_linestatus || '","veracity":"' || l_returnflag || '"}') FROM l GROUP BY l_orderkey, l_partkey
UNION ALL SELECT 'SET_IN', 'o' || v, 'l' || c_nationkey, '{"confidence":' || sure || '}' FROM x UNION ALL SELECT 'EXPRESSES', 'o' || v, 'b' || o_orderpriority, '{"confidence":' || sure || '}' FROM x UNION ALL SELECT 'DESCRIBES', 'o' || v, 'r' || o_orderstatus, '{"confidence":' || sure || '}' FROM x
UNION ALL SELECT 'RELATES_TO', p.id, q.id, '{"relationship_type":"NEAR","confidence":' || sure || '}' FROM t JOIN n p ON p.name = source JOIN n q ON q.name = target""")
def gr02(s, d):
    """Edges of all six types; related names join every entity that has them."""
    stories = stored(order_stories(s, d), "stories")
    return projection.edges(stories, projection.nodes(stories))


@query("gr05_map", """SELECT n_nationkey, (SELECT count(DISTINCT c_mktsegment) FROM customer WHERE c_nationkey = n_nationkey) AS segments, coalesce((SELECT string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) FROM customer WHERE c_nationkey = n_nationkey), '') AS beliefs,
coalesce((SELECT string_agg(DISTINCT s_name, ',' ORDER BY s_name) FROM supplier WHERE s_nationkey = n_nationkey), '') AS entities, (SELECT string_agg(DISTINCT m.n_name, ',' ORDER BY m.n_name) FROM nation m WHERE m.n_regionkey = n.n_regionkey) AS neighbours FROM nation n""")
def cultural(s, d):
    """Of each place the distinct names around it: three optional matches, collected before they are joined, so nothing multiplies."""
    names = lambda df, by, name, out: df.groupBy(F.col(by).alias("_by")).agg(F.sort_array(F.collect_set(name)).alias(out))
    n = t(s, d, "nation")
    df = n.join(names(t(s, d, "customer"), "c_nationkey", "c_mktsegment", "beliefs").withColumnRenamed("_by", "n_nationkey"), "n_nationkey", "left")
    df = df.join(names(t(s, d, "supplier"), "s_nationkey", "s_name", "entities").withColumnRenamed("_by", "n_nationkey"), "n_nationkey", "left")
    df = df.join(names(n, "n_regionkey", "n_name", "neighbours").withColumnRenamed("_by", "n_regionkey"), "n_regionkey", "left")
    listed = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",").alias(c)
    return df.select("n_nationkey", F.coalesce(F.size("beliefs"), F.lit(0)).cast("long").alias("segments"), listed("beliefs"), listed("entities"), listed("neighbours"))


@query("gr06_themes", "SELECT p_brand, count(DISTINCT l_orderkey) AS orders FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'A' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def themes(s, d):
    df = t(s, d, "lineitem").filter("l_returnflag = 'A'").join(t(s, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return df.groupBy("p_brand").agg(F.count_distinct("l_orderkey").alias("orders")).orderBy(F.col("orders").desc(), "p_brand").limit(20)


@query("gr07_contradictions", "SELECT DISTINCT least(n_nationkey, n_regionkey) AS a, greatest(n_nationkey, n_regionkey) AS b FROM nation WHERE n_nationkey <> n_regionkey")
def pairs(s, d):
    n = t(s, d, "nation").select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst"))
    return graph.undirected(n).filter("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


@query("gr13_vector_similarity", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id")
def vectors(s, d):
    return vector_index.pair_scores(t(s, d, "embeddings"), "vec_id", "label", "embedding", 6)


@query("ln03_both_ways", "SELECT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_partkey = 7 UNION SELECT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey = 7")
def both_ways(s, d):
    df = t(s, d, "lineitem")
    return df.filter("l_partkey = 7").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).union(df.filter("l_suppkey = 7").select("l_suppkey", "l_partkey")).distinct()


@query("ln07_audit_history", "SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def history(s, d):
    return t(s, d, "events").select("user_id", "event_id", F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"))


@query("ln07_prompt_trace", "SELECT e.event_id, c.c_custkey AS prompt, c.c_mktsegment AS version, n.n_name AS author, count(*) OVER (PARTITION BY c.c_custkey) AS outputs FROM events e JOIN customer c ON c.c_custkey = e.user_id LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE e.event_type = 'click'")
def prompt_trace(s, d):
    """Each output with the prompt, version and author behind it, and how many the prompt has."""
    outputs = t(s, d, "events").filter("event_type = 'click'").select("event_id", F.col("user_id").alias("prompt"))
    prompts = t(s, d, "customer").select(F.col("c_custkey").alias("prompt"), F.col("c_mktsegment").alias("version"), "c_nationkey")
    counts = outputs.groupBy("prompt").agg(F.count("*").alias("outputs"))
    authors = t(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("author"))
    return outputs.join(prompts, "prompt").join(counts, "prompt").join(authors, "c_nationkey", "left").select("event_id", "prompt", "version", "author", "outputs")


@query("ss04_decode", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def decode(s, d):
    return jobs.decode(t(s, d, "events"), "props", "props").select("event_id", F.variant_get("payload", "$.k", "long").alias("k"))


@query("ss09_lag", "SELECT event_type AS topic, lag, CASE WHEN lag > 5000 THEN 'critical' WHEN lag > 1000 THEN 'warning' ELSE 'ok' END AS alert FROM (SELECT event_type, max(event_id) - max(event_id) FILTER (WHERE event_id % 3 = 0) AS lag FROM events GROUP BY 1)")
def consumer_lag(s, d):
    e = t(s, d, "events").select(F.col("event_type").alias("topic"), F.lit(0).alias("partition"), "event_id")
    ends = e.groupBy("topic", "partition").agg(F.max("event_id").alias("end"))
    done = e.filter("event_id % 3 = 0").groupBy("topic", "partition").agg(F.max("event_id").alias("committed"))
    return jobs.lag(ends, done).select("topic", "lag", "alert")


@query("ss11_incremental", "WITH k AS (SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' AND event_id % 7 > 0) SELECT event_id, ts > (SELECT max(ts) FROM k) AS after_mark FROM events WHERE event_id NOT IN (SELECT event_id FROM k)")
def incremental(s, d):
    """What a crawl has to fetch: unknown ids; the high-water mark alone would miss late ones."""
    e = t(s, d, "events").select("event_id", "ts")
    known = e.filter("ts < TIMESTAMP_NTZ '2024-01-20 00:00:00' AND event_id % 7 > 0")
    marked = jobs.since_high_water(e, known, "event_id", "ts").join(F.broadcast(jobs.high_water(known, "ts")))
    return marked.select("event_id", F.coalesce(F.col("ts") > F.col("high_water"), F.lit(True)).alias("after_mark"))


@query("ss11_high_water", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00')")
def after_mark(s, d):
    e = t(s, d, "events").select("event_id", "ts")
    return jobs.since_high_water(e, e.filter("ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'"), "event_id", "ts", mark_only=True).select("event_id")


@query("gr10_motifs", """WITH m AS (SELECT o_custkey AS story, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS m FROM orders GROUP BY 1),
g AS (SELECT m, count(*) AS n FROM m GROUP BY 1) SELECT array_to_string(a.m, ',') AS a, array_to_string(b.m, ',') AS b, round(len(list_intersect(a.m, b.m)) / len(list_distinct(list_concat(a.m, b.m)))::DOUBLE, 6) AS similarity, a.n AS stories_a, b.n AS stories_b FROM g a, g b
WHERE array_to_string(a.m, ',') <= array_to_string(b.m, ',') AND len(list_intersect(a.m, b.m)) / len(list_distinct(list_concat(a.m, b.m)))::DOUBLE > 0.7 AND (array_to_string(a.m, ',') < array_to_string(b.m, ',') OR a.n > 1)""")
def motifs(s, d):
    """Customers as stories, priorities as motifs: classes of equal motif sets, and the pairs of classes that are alike."""
    sets = t(s, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("motifs"))
    return graph.similar_sets(sets, "motifs", 0.7).select(F.array_join("a", ",").alias("a"), F.array_join("b", ",").alias("b"), F.round("similarity", 6).alias("similarity"), "stories_a", "stories_b")


@query("gr11_same_as", """WITH e AS (SELECT DISTINCT CASE WHEN l_suppkey % 3 = 1 THEN l_suppkey - 1 ELSE l_suppkey END AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey % 5 <> 4 AND l_partkey % 9 <> 0) SELECT src, count(*) AS degree FROM e GROUP BY 1""")
def same_as(s, d):
    """Suppliers with aliases resolved, archived suppliers and parts gone, rebuilt as one graph."""
    e = t(s, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    ids = t(s, d, "lineitem").select("l_suppkey").distinct()
    aliases = ids.filter("l_suppkey % 3 = 1").select(F.col("l_suppkey").alias("alias"), (F.col("l_suppkey") - 1).alias("canonical"))
    kept = graph.without(e, ids.filter("l_suppkey % 5 = 4").select(F.col("l_suppkey").alias("node")), "src")
    kept = graph.without(kept, t(s, d, "part").filter("p_partkey % 9 = 0").select(F.col("p_partkey").alias("node")), "dst")
    return graph.merge_aliases(kept, aliases).groupBy("src").agg(F.count("*").alias("degree"))


@query("ln05_finders", "SELECT 'object' AS finder, count(*) AS n FROM lineitem WHERE l_partkey = 7 AND l_returnflag = 'A' UNION ALL SELECT 'parent', count(*) FROM lineitem WHERE l_orderkey = 3 UNION ALL SELECT 'tenant', count(*) FROM lineitem WHERE l_suppkey = 2")
def finders(s, d):
    """Lineage rows of an object and its type, of a parent, of a tenant."""
    rows = t(s, d, "lineitem").select(F.col("l_partkey").alias("object_id"), F.col("l_returnflag").alias("object_type"), F.col("l_orderkey").alias("parent_object_id"), F.col("l_suppkey").alias("tenant_id"))
    found = {"object": graph.lineage_of(rows, object_id=7, object_type="A"), "parent": graph.lineage_of(rows, parent_object_id=3), "tenant": graph.lineage_of(rows, tenant_id=2)}
    out = None
    for name, df in found.items():
        one = df.agg(F.lit(name).alias("finder"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("ext_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(s, d):
    return t(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("hs_band_ids", "SELECT c_custkey, sha256(c_name) AS id FROM customer")
def ids(s, d):
    return t(s, d, "customer").select("c_custkey", sc.stable_id(F.col("c_name")).alias("id"))
