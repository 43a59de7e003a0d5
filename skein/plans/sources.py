"""SRC family: projections and writers over the test tables."""

from pyspark.sql import functions as F

from skein.registry import query
from skein.session import table as t
from skein.sources import payloads as p
from skein.sources import store
from skein.streaming import jobs


@query("src01_read", "SELECT r_regionkey, r_name FROM region")
def read(s, d):
    return t(s, d, "region").select("r_regionkey", "r_name")


@query("src05_projection", """SELECT event_id, 'v' || event_id AS video_id, CASE WHEN event_id % 3 > 0 THEN 'T' || event_id ELSE '' END AS title, '' AS description, user_id AS duration_seconds, CASE WHEN event_id % 2 = 0 THEN '20240105' ELSE '' END AS upload_date, CASE WHEN event_id % 5 > 0 THEN event_id ELSE 0 END AS view_count, 0::BIGINT AS like_count, 0::BIGINT AS comment_count,
'' AS channel_id, '' AS channel_name, '' AS thumbnail_url, '' AS webpage_url, '' AS channel_url, '' AS uploader, 'youtube' AS extractor, CASE WHEN event_id % 3 = 0 THEN 'a,b' ELSE '' END AS tags, '' AS categories, event_id % 4 < 2 AS has_subtitles FROM events""")
def projection(s, d):
    """Events as video payloads with absent, null and present fields."""
    i = F.col("event_id")
    tag = F.create_map(F.lit("id"), F.lit("x"))
    body = F.to_json(F.struct(
        F.concat(F.lit("v"), i.cast("string")).alias("id"), F.when(i % 3 > 0, F.concat(F.lit("T"), i.cast("string"))).alias("title"), F.col("user_id").alias("duration"), F.when(i % 2 == 0, "20240105").alias("upload_date"),
        F.when(i % 5 > 0, i).alias("view_count"), F.when(i % 3 == 0, F.array(F.lit("a"), F.lit("b"))).alias("tags"), F.when(i % 4 == 0, tag).alias("subtitles"), F.when(i % 4 == 1, tag).alias("automatic_captions"),
    ))
    rows = t(s, d, "events").select("event_id", F.parse_json(body).alias("payload")).select("event_id", *p.video(F.col("payload")))
    return rows.withColumns({"tags": F.array_join("tags", ","), "categories": F.array_join("categories", ",")})


@query("src06_channel", "SELECT user_id, 'c' || user_id AS channel_id, 'N' || user_id AS name, '' AS description, CASE WHEN user_id % 2 = 0 THEN user_id * 10 ELSE 0 END AS subscriber_count, 0::BIGINT AS video_count, '' AS channel_url, 'a' AS avatar_url, '' AS banner_url FROM (SELECT DISTINCT user_id FROM events)")
def channel(s, d):
    u = F.col("user_id")
    body = F.to_json(F.struct(F.concat(F.lit("c"), u.cast("string")).alias("channel_id"), F.concat(F.lit("N"), u.cast("string")).alias("channel"), F.when(u % 2 == 0, u * 10).alias("subscriber_count"), F.lit("a").alias("avatar")))
    return t(s, d, "events").select("user_id").distinct().select("user_id", *p.project(F.parse_json(body), p.CHANNEL))


@query("src07_playlist", "SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag <> 'R') AS entries FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag <> 'R') > 0")
def playlist(s, d):
    entry = F.when(F.col("l_returnflag") != "R", F.col("l_partkey"))
    lists = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(entry.alias("id"))).alias("all"))
    lists = lists.select("l_orderkey", F.transform("all", lambda x: x["id"]).alias("entries"))
    return p.playlist(lists, "entries").groupBy("l_orderkey").agg(F.count("*").alias("entries"))


@query("src08_pick_subtitle", """WITH k AS (SELECT doc_id % 50 AS video, lang, CASE WHEN doc_id % 3 = 0 THEN 'vtt' WHEN doc_id % 3 = 1 THEN 'srt' ELSE 'ttml' END AS format, doc_id % 2 = 0 AS automatic FROM documents),
g AS (SELECT video, lang, format, bool_and(automatic) AS automatic, CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 ELSE 3 END AS l FROM k WHERE format <> 'ttml' GROUP BY ALL)
SELECT video, lang AS language, format, automatic OR l = 3 AS automatic FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY l, CASE format WHEN 'vtt' THEN 1 ELSE 2 END, lang) AS r FROM g) WHERE r = 1""")
def pick(s, d):
    fmt = F.when(F.col("doc_id") % 3 == 0, "vtt").when(F.col("doc_id") % 3 == 1, "srt").otherwise("ttml")
    tracks = t(s, d, "documents").select((F.col("doc_id") % 50).alias("video"), F.col("lang").alias("language"), fmt.alias("format"), (F.col("doc_id") % 2 == 0).alias("a"))
    tracks = tracks.groupBy("video", "language", "format").agg(F.every("a").alias("automatic"))
    return p.pick_subtitle(tracks, "video", ["de", "en"])


@query("src09_catalogue", "SELECT source, lang, array_to_string(list_sort(list(DISTINCT CASE doc_id % 3 WHEN 0 THEN 'vtt' WHEN 1 THEN 'srt' ELSE 'ttml' END)), ',') AS formats FROM documents GROUP BY ALL")
def catalogue(s, d):
    ext = F.when(F.col("doc_id") % 3 == 0, "vtt").when(F.col("doc_id") % 3 == 1, "srt").otherwise("ttml")
    each = t(s, d, "documents").groupBy("source", "lang").agg(F.collect_set(F.struct(ext.alias("ext"))).alias("f"))
    maps = each.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("lang", "f"))).alias("m"))
    return maps.select("source", F.explode(p.catalogue(F.col("m"))).alias("lang", "found")).select("source", "lang", F.array_join(F.sort_array("found"), ",").alias("formats"))


@query("src11_crawl_sink", "SELECT source, count(*) AS videos, sum(length(text))::BIGINT AS characters, count(*) FILTER (WHERE lang = 'en') AS with_subtitles FROM documents GROUP BY 1")
def crawl_sink(s, d):
    """Results as JSON files by source, and the summary of what is in place, read back."""
    rows = t(s, d, "documents").select("doc_id", "source", F.length("text").alias("characters"), (F.col("lang") == "en").alias("subtitled"))
    folder = p.scratch(s, "crawl")
    return p.crawl_sink(rows, folder, "source").groupBy("source").agg(F.count("*").alias("videos"), F.sum("characters").alias("characters"), F.count_if("subtitled").alias("with_subtitles"))


@query("src10_versions", "SELECT DISTINCT p_partkey % 7 AS k, sha256('{\"p_brand\":\"' || p_brand || '\",\"p_size\":' || p_size || '}') AS payload_hash, '{\"p_brand\":\"' || p_brand || '\",\"p_size\":' || p_size || '}' AS payload FROM part")
def versions(s, d):
    """Payloads under a few keys: each version once, by its hash."""
    return p.version(t(s, d, "part").withColumn("k", F.col("p_partkey") % 7), "k", "p_brand", "p_size")


@query("src12_seed", "SELECT n_name AS slug FROM nation WHERE n_nationkey >= 5")
def seed(s, d):
    n = t(s, d, "nation")
    return n.select(F.col("n_name").alias("slug")).join(n.filter("n_nationkey < 5").select(F.col("n_name").alias("slug")), "slug", "left_anti")


@query("src14_graph_sink", """WITH x AS (SELECT DISTINCT 'supplier' AS label, l_suppkey AS id FROM lineitem UNION SELECT DISTINCT 'part', l_partkey FROM lineitem), h AS (SELECT 'supplier' AS label, s_suppkey AS id FROM supplier WHERE s_suppkey % 2 = 0),
e AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
SELECT (SELECT count(*) FROM x WHERE (label, id) NOT IN (SELECT label, id FROM h))::BIGINT AS nodes_created, (SELECT count(*) FROM e)::BIGINT AS relationships_created, (SELECT count(*) FROM (SELECT * FROM x UNION SELECT * FROM h))::BIGINT AS nodes""")
def graph_sink(s, d):
    """Lines as relationships of suppliers and parts, put into a graph that has half of the suppliers."""
    lines = t(s, d, "lineitem")
    nodes = lines.select(F.inline(F.array(F.struct(F.lit("supplier").alias("label"), F.col("l_suppkey").alias("id")), F.struct(F.lit("part").alias("label"), F.col("l_partkey").alias("id")))))
    edges = lines.select(F.lit("SUPPLIES").alias("type"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    held = t(s, d, "supplier").filter("s_suppkey % 2 = 0").select(F.lit("supplier").alias("label"), F.col("s_suppkey").alias("id"))
    merged = p.graph_upsert(held, edges.limit(0), nodes, edges)
    counts = [f.agg(F.count("*").alias("n")) for f in (merged["new_nodes"], merged["new_edges"], merged["nodes"])]
    return counts[0].select(F.col("n").alias("nodes_created")).join(counts[1].select(F.col("n").alias("relationships_created"))).join(counts[2].select(F.col("n").alias("nodes")))


@query("src15_story_tables", """SELECT 'stories' AS tab, count(*) AS n, count(DISTINCT conv_id) AS stories FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT 'validation_results', count(DISTINCT conv_id), count(DISTINCT conv_id) FROM conversations
UNION ALL SELECT 'entities', count(*), count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'claims', count(*), count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'relationships', count(*) FILTER (WHERE turn > 0), count(DISTINCT conv_id) FILTER (WHERE turn > 0) FROM conversations""")
def story_tables(s, d):
    """Conversations as canonical stories: every turn an entity and a claim, and a relationship to the turn before."""
    tables = p.story_tables(stories(s, d))
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.lit(name).alias("tab"), F.count("*").alias("n"), F.count_distinct("story_id").alias("stories"))
        out = one if out is None else out.unionByName(one)
    return out


@query("src15_story_entities", "SELECT conv_id::VARCHAR AS story_id, role || turn AS name, CASE WHEN turn % 2 = 0 THEN 'spirit' ELSE 'person' END AS type, (turn * 7 % 100)::INT AS confidence FROM conversations")
def story_entities(s, d):
    return p.story_tables(stories(s, d))["entities"].select("story_id", "name", "type", "confidence")


def stories(s, d):
    turn = F.col("turn")
    name = F.concat("role", turn.cast("string"))
    entity = F.struct(name.alias("name"), F.when(turn % 2 == 0, "spirit").otherwise("person").alias("type"), F.col("role").alias("role"), (turn * 7 % 100).cast("int").alias("confidence"))
    claim = F.struct(F.col("text").alias("text"), F.lit("event").alias("claim_type"), (turn * 3 % 100).cast("int").alias("confidence"))
    tie = F.when(turn > 0, F.struct(name.alias("source"), (turn - 1).cast("string").alias("target"), F.lit("FOLLOWS").alias("relationship_type"), F.lit(50).alias("confidence")))
    rows = t(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", entity.alias("e"), claim.alias("c"), tie.alias("t")))).alias("a"))
    head = {c: F.lit(None).cast("string").alias(c) for c in ("summary", "primary_culture", "region", "time_period", "extraction_model", "extraction_version", "source_video_id", "source_transcript_id")}
    return rows.select(F.col("conv_id").cast("string").alias("story_id"), F.concat(F.lit("Story "), F.col("conv_id").cast("string")).alias("title"), F.lit("legend").alias("story_type"), F.lit(70).alias("confidence"), *head.values(),
                       F.lit(0.8).alias("quality_score"), F.lit(True).alias("ready_for_graph"), F.array().cast("array<string>").alias("errors"), F.array().cast("array<string>").alias("warnings"),
                       F.col("a.e").alias("entities"), F.col("a.c").alias("claims"), F.filter("a.t", lambda v: v.isNotNull()).alias("relationships"))


@query("src02_upsert", "SELECT l_orderkey, max(l_linenumber) AS l_linenumber, max_by(l_quantity, l_linenumber * 1000000000::BIGINT + l_partkey) AS l_quantity FROM lineitem GROUP BY 1")
def upsert(s, d):
    """Odd lines over even ones by order; the last line of an order stays, of equal ones that which the table has first."""
    place = (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("place")
    rows = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", place, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return p.upsert(rows.filter("l_linenumber % 2 = 0"), rows.filter("l_linenumber % 2 = 1"), "l_orderkey", "place", "file", "row").select("l_orderkey", "l_linenumber", "l_quantity")


@query("src04_topic_records", "SELECT event_id::VARCHAR AS event_id, CASE WHEN event_id % 3 = 0 THEN 'v' || event_id WHEN event_id % 3 = 1 THEN 'p' || event_id END AS key, CASE WHEN event_id % 3 = 0 THEN 'v' || event_id END AS video_id FROM events")
def topic_records(s, d):
    """Keys of topic records: the video's id, else the run's, else none."""
    i = F.col("event_id").cast("string")
    rows = t(s, d, "events").select(i.alias("event_id"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("v"), i)).alias("video_id"), F.when(F.col("event_id") % 3 < 2, F.concat(F.lit("p"), i)).alias("pipeline_id"))
    records = jobs.records(rows)
    body = F.parse_json(F.col("value"))
    return records.select(F.variant_get(body, "$.event_id", "string").alias("event_id"), "key", F.try_variant_get(body, "$.video_id", "string").alias("video_id"))


@query("src18_extractor", "SELECT conv_id, turn, array_to_string(regexp_extract_all(text, '(?:^|[^\\p{L}\\p{N}_])([A-Z][\\p{L}\\p{N}_]+)', 1), ',') AS items, len(text) // 4 AS input_tokens FROM conversations")
def extractor(s, d):
    """An extractor behind the model interface, with its usage: the capitalised words of each turn."""
    df = t(s, d, "conversations").select("conv_id", "turn", "text")
    found = p.extract(df, "text", lambda x: x.str.findall(r"\b[A-Z]\w+"), "array<string>")
    return found.select("conv_id", "turn", F.array_join("items", ",").alias("items"), "input_tokens")


@query("src_lexicon", "SELECT doc_id, term, kind FROM (SELECT doc_id, unnest(list_distinct(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'))) AS term FROM documents) JOIN (VALUES ('the', 'article'), ('und', 'conjunction'), ('que', 'pronoun')) v(term, kind) USING (term)")
def lexicon(s, d):
    terms = s.createDataFrame([("the", "article"), ("und", "conjunction"), ("que", "pronoun")], "term string, kind string")
    return p.lexicon(t(s, d, "documents").select("doc_id", "text"), "text", terms).select("doc_id", "term", "kind")


@query("vs10_embed", """WITH w AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda v: v <> '')) AS w FROM conversations), h AS (SELECT conv_id, turn, ('0x' || substring(md5(w), 1, 8))::BIGINT AS h FROM w),
s AS (SELECT conv_id, turn, h % 32 AS place, sum(CASE WHEN h // 32 % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM h GROUP BY ALL), n AS (SELECT conv_id, turn, sqrt(sum(v * v)) AS norm FROM s GROUP BY ALL)
SELECT conv_id, turn, place::INT AS place, floor(v / norm * 1e6 + 0.5123)::BIGINT AS value, 32 AS dimension FROM s JOIN n USING (conv_id, turn) WHERE v <> 0""")
def embed(s, d):
    rows = p.hash_embedding(t(s, d, "conversations").select("conv_id", "turn", "text"), "text", ["conv_id", "turn"], 32, kind="double")
    flat = rows.select("conv_id", "turn", "dimension", F.posexplode("vector").alias("place", "v"))
    return flat.filter("v <> 0").select("conv_id", "turn", "place", F.floor(F.col("v") * 1e6 + 0.5123).alias("value"), "dimension")


@query("src20_export", "SELECT 'completed' AS status, o_orderstatus AS part, count(*) AS records, sum(o_orderkey)::BIGINT AS total FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'failed', NULL, 0::BIGINT, NULL")
def export(s, d):
    """All orders exported and read back from where the job says they are, and an export that fails."""
    orders = t(s, d, "orders").select("o_orderkey", "o_orderstatus")
    job = p.export(orders, p.scratch(s, "export"), "json")
    bad = p.export(orders.withColumn("x", F.raise_error(F.lit("no"))), p.scratch(s, "export"))
    found = s.read.schema(orders.schema).json(job["url"])
    kept = found.groupBy(F.lit(job["status"]).alias("status"), F.col("o_orderstatus").alias("part")).agg(F.count("*").alias("records"), F.sum("o_orderkey").alias("total"))
    return kept.unionByName(s.createDataFrame([(bad["status"], None, bad["records"], None)], "status string, part string, records long, total long"))


CHANGED = """WITH c AS (SELECT event_id, event_type, strftime(ts, '%Y-%m') AS month, CASE WHEN event_id % 10 = 0 THEN value + 100 ELSE value END::DECIMAL(18,4) AS value FROM events WHERE event_id % 17 <> 0)
"""


def changed_events(s, d):
    """A stored table of all events: loaded, a tenth of them upserted with later rows and older ones, some deleted. -> (table, what to do after each step)"""
    rows = t(s, d, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM").alias("month"), F.col("value").cast("decimal(18,4)").alias("value"), F.lit(1).cast("long").alias("at"))
    table = store.Table(s, p.scratch(s, "events"), rows.schema, ["event_id"])
    later = rows.filter("event_id % 10 = 0").withColumns({"value": (F.col("value") + 100).cast("decimal(18,4)"), "at": F.lit(2).cast("long")})
    older = rows.filter("event_id % 4 = 0").withColumns({"value": (F.col("value") - 100).cast("decimal(18,4)"), "at": F.lit(0).cast("long")})
    yield table, lambda: table.upsert(rows, "at")
    yield table, lambda: table.upsert(later.unionByName(older), "at")
    yield table, lambda: table.delete(rows.filter("event_id % 17 = 0").select("event_id"))


@query("src02_stored_upsert", CHANGED + "SELECT event_id, event_type, value::DOUBLE AS value FROM c")
def stored_upsert(s, d):
    """The table after an upsert and a delete of its buckets."""
    for table, step in changed_events(s, d):
        step()
    return table.read().select("event_id", "event_type", F.col("value").cast("double").alias("value"))


@query("ag15_kept_summary", CHANGED + "SELECT event_type, month, count(*) AS n, coalesce(sum(value), 0)::DOUBLE AS total, coalesce(sum(CASE WHEN value > 100 THEN value END), 0)::DOUBLE AS large FROM c GROUP BY ALL")
def kept_summary(s, d):
    """A summary by type and month that is kept up by the table's changes, deletes among them."""
    summary = store.Summary(s, p.scratch(s, "summary"), "event_type string, month string", {"total": "value", "large": "CASE WHEN value > 100 THEN value END"})
    for table, step in changed_events(s, d):
        step()
        summary.refresh(table)
    return summary.read().select("event_type", "month", "n", F.col("total").cast("double").alias("total"), F.col("large").cast("double").alias("large"))
