"""TX, DT, MTH, AR, MP, JS, HS families: column expressions."""

from pyspark.sql import functions as F

from skein.functions import scalars as c
from skein.functions import text as x
from skein.registry import query
from skein.session import table as t

NB = "[\\p{L}\\p{N}_]"


@query("tx03_strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS body FROM pages")
def tags(s, d):
    return t(s, d, "pages").select("page_id", x.strip_tags(F.col("html")).alias("body"))


@query("tx04_cue_settings", "SELECT conv_id, turn, regexp_replace(regexp_replace('align:' || role || ' ' || text || ' line:5%', 'align:\\S+', '', 'g'), 'line:\\S+', '', 'g') AS body FROM conversations")
def cue(s, d):
    return t(s, d, "conversations").select("conv_id", "turn", x.strip_cue_settings(F.concat(F.lit("align:"), "role", F.lit(" "), "text", F.lit(" line:5%"))).alias("body"))


@query("tx05_sounds", "SELECT conv_id, turn, regexp_replace(regexp_replace('[Musik] ' || text || ' ♪[SOUND]', '\\[(musik|music|suara|sound)\\]', '', 'gi'), '[♪♫]', '', 'g') AS body FROM conversations")
def sounds(s, d):
    return t(s, d, "conversations").select("conv_id", "turn", x.strip_sounds(F.concat(F.lit("[Musik] "), "text", F.lit(" ♪[SOUND]"))).alias("body"))


@query("tx06_speakers", f"SELECT conv_id, turn, regexp_replace(role || ': ' || text, '{NB}+\\s*:', '', 'g') AS body FROM conversations")
def speakers(s, d):
    return t(s, d, "conversations").select("conv_id", "turn", x.strip_speakers(F.concat("role", F.lit(": "), "text")).alias("body"))


@query("tx07_squeeze", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS body FROM documents")
def squeeze(s, d):
    return t(s, d, "documents").select("doc_id", x.squeeze(F.col("text")).alias("body"))


def phrase_dedup(source: str) -> str:
    """SQL for a relation (id, text): word i goes if the set of the four before it is that of four that began 1 to 7 places earlier."""
    back = ", ".join(f"lag(k, {n}) OVER p" for n in range(5, 12))
    return f"""w AS (SELECT id, text, list_filter(string_split_regex(text, '\\s+'), lambda v: v <> '') AS w FROM ({source})),
    u AS (SELECT id, unnest(w) AS v, unnest(range(len(w))) AS i FROM w WHERE len(w) > 4),
    k AS (SELECT id, v, i, list_sort(list_distinct([lower(v), lower(lead(v, 1) OVER p), lower(lead(v, 2) OVER p), lower(lead(v, 3) OVER p)]))::VARCHAR AS k FROM u WINDOW p AS (PARTITION BY id ORDER BY i)),
    r AS (SELECT id, v, i, coalesce(i >= 5 AND list_contains([{back}], lag(k, 4) OVER p), false) AS again FROM k WINDOW p AS (PARTITION BY id ORDER BY i)),
    body AS (SELECT id, string_agg(v, ' ' ORDER BY i) FILTER (WHERE NOT again) AS body FROM r GROUP BY id UNION ALL SELECT id, text FROM w WHERE len(w) <= 4)"""


@query("tx08_phrase_dedup", f"WITH {phrase_dedup('SELECT doc_id AS id, text FROM documents')} SELECT id AS doc_id, body FROM body")
def phrases(s, d):
    return t(s, d, "documents").select("doc_id", x.drop_repeated_phrases(F.col("text")).alias("body"))


@query("tx09_word_jaccard", "SELECT a.conv_id, a.turn, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE, 6) AS j FROM (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda v: v <> '')) AS w FROM conversations) a JOIN (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda v: v <> '')) AS w FROM conversations) b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def jaccard(s, d):
    a = t(s, d, "conversations").select("conv_id", "turn", x.lower_words(F.col("text")).alias("w"))
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("w2"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(x.jaccard(F.col("w"), F.col("w2")), 6).alias("j"))


@query("tx10_format", "SELECT doc_id, CASE WHEN trim(text) = '' AND doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'srt' ELSE 'vtt' END AS kind FROM documents")
def kind(s, d):
    k = F.col("doc_id") % 3
    text = F.when(k == 1, F.concat(F.lit(" 1\n00:00:01,000 --> 00:00:02,000\n"), "text")).when(k == 2, F.concat(F.lit("WEBVTT\n"), "text")).otherwise(F.col("text"))
    return t(s, d, "documents").select("doc_id", x.subtitle_format(text).alias("kind"))


@query("tx14_seconds", "SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)))::DOUBLE AS sec FROM events")
def seconds(s, d):
    return t(s, d, "events").select("event_id", x.seconds(F.date_format("ts", "HH:mm:ss")).alias("sec"))


SENTENCES = "string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


@query("tx16_sentences", f"SELECT doc_id, unnest({SENTENCES}) AS sentence, unnest(range(len({SENTENCES})))::INT AS place FROM documents")
def sentences(s, d):
    return t(s, d, "documents").select("doc_id", F.posexplode(x.sentences(F.col("text"))).alias("place", "sentence"))


@query("tx17_sentence_chunks", f"""WITH RECURSIVE s AS (SELECT doc_id, list_filter({SENTENCES}, lambda v: trim(v) <> '') AS s FROM documents),
c AS (SELECT doc_id, s, list_transform(s, lambda v: len(list_filter(string_split_regex(v, '\\s+'), lambda w: w <> ''))::BIGINT) AS n FROM s WHERE len(s) > 0),
p AS (SELECT doc_id, s, n, list_transform(range(len(n) + 1), lambda i: coalesce(list_sum(n[1:i]), 0)::BIGINT) AS p FROM c),
f AS (SELECT doc_id, 0 AS i, 0 AS a, 0::BIGINT AS w, NULL::INT AS b, NULL::INT AS e, 0 AS k FROM p
 UNION ALL SELECT f.doc_id, i + 1, CASE WHEN full_ THEN kept ELSE a END, CASE WHEN full_ THEN p[i + 1] - p[kept + 1] ELSE w END + n[i + 1], CASE WHEN full_ THEN a END, CASE WHEN full_ THEN i END, k + full_::INT
 FROM (SELECT f.*, p.n, p.p, f.w + p.n[f.i + 1] > 512 AND f.i > f.a AS full_, list_filter(range(f.a, f.i + 1), lambda j: p.p[f.i + 1] - p.p[j + 1] <= 50)[1] AS kept FROM f JOIN p USING (doc_id) WHERE f.i < len(p.n)) f),
o AS (SELECT doc_id, k - 1 AS chunk, b, e FROM f WHERE b IS NOT NULL UNION ALL SELECT doc_id, k, a, i FROM f JOIN p USING (doc_id) WHERE i = len(n))
SELECT o.doc_id, chunk, list_sum(n[b + 1:e])::BIGINT AS words, md5(array_to_string(s[b + 1:e], ' ')) AS digest FROM o JOIN p USING (doc_id)""")
def chunks(s, d):
    df = t(s, d, "documents").select("doc_id", F.posexplode(x.chunk(x.sentences(F.col("text")))).alias("chunk", "body"))
    return df.select("doc_id", "chunk", x.word_count(F.col("body")).alias("words"), F.md5("body").alias("digest"))


@query("tx18_segment_chunks", """WITH RECURSIVE c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i, turn, text, len(list_filter(string_split_regex(text, '\\s+'), lambda v: v <> ''))::BIGINT AS n FROM conversations),
f AS (SELECT conv_id, i, n AS w, 0 AS k FROM c WHERE i = 1 UNION ALL SELECT c.conv_id, c.i, CASE WHEN f.w + c.n > 128 THEN c.n ELSE f.w + c.n END, f.k + (f.w + c.n > 128)::INT FROM f JOIN c ON c.conv_id = f.conv_id AND c.i = f.i + 1)
SELECT conv_id, k AS chunk, sum(n)::INT AS word_count, (min(turn) * 2)::DOUBLE AS start_seconds, (max(turn) * 2 + 1.5)::DOUBLE AS end_seconds, count(*)::INT AS segment_count, md5(string_agg(text, ' ' ORDER BY i)) AS digest FROM f JOIN c USING (conv_id, i) GROUP BY ALL""")
def segment_chunks(s, d):
    """Turns of a conversation, two seconds apart, packed into chunks of up to 128 words."""
    cue = F.struct("turn", "text", (F.col("turn") * 2.0).alias("start"), (F.col("turn") * 2.0 + 1.5).alias("end"), F.col("text").alias("content"))
    lines = t(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(cue)).alias("l"))
    cues = F.transform("l", lambda v: F.struct(v["start"].alias("start"), v["end"].alias("end"), v["content"].alias("content")))
    packed = lines.select("conv_id", F.posexplode(x.chunk_segments(cues, 128)).alias("chunk", "c"))
    return packed.select("conv_id", "chunk", "c.word_count", "c.start_seconds", "c.end_seconds", "c.segment_count", F.md5("c.text").alias("digest"))


@query("tx19_join_segments", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS body FROM conversations GROUP BY 1")
def joined(s, d):
    lines = t(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    return lines.select("conv_id", F.array_join("l.text", " ").alias("body"))


@query("tx20_word_count", "SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS words FROM documents")
def word_count(s, d):
    return t(s, d, "documents").select("doc_id", x.word_count(F.col("text")).alias("words"))


@query("tx21_tokens", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def tokens(s, d):
    return t(s, d, "documents").select("doc_id", x.token_estimate(F.col("text")).alias("tokens"))


@query("tx22_truncate", "SELECT doc_id, substring(text, 1, 5000) AS description, substring(text, 1, 500) AS summary, substring(text, 1, 500) AS error, substring(text, 1, 15000) AS transcript, substring(text, 1, 5000) AS knowledge FROM documents")
def truncate(s, d):
    return t(s, d, "documents").select("doc_id", *[x.truncate(F.col("text"), use).alias(use) for use in x.LIMITS])


@query("tx23_seo", """SELECT page_id, substring(url, 1, 60) AS meta_title, substring(CASE WHEN html = '' OR html IS NULL OR page_id % 4 = 0 THEN url ELSE html END, 1, 160) AS meta_description,
regexp_replace(replace(replace(lower(url), ' ', '-'), '/', '-'), '[^\\p{L}\\p{N}-]', '', 'g') AS slug, array_to_string(list_slice(string_split(url, '/'), 1, 5), '|') AS keywords FROM pages""")
def seo(s, d):
    made = x.seo(F.col("url"), F.when(F.col("page_id") % 4 > 0, F.col("html")), F.split("url", "/"))
    return t(s, d, "pages").select("page_id", *[made[k].alias(k) for k in ("meta_title", "meta_description", "slug")], F.array_join(made["focus_keywords"], "|").alias("keywords"))


@query("tx24_slug", "SELECT p_partkey, regexp_replace(replace(replace(lower(p_name), ' ', '-'), '/', '-'), '[^\\p{L}\\p{N}-]', '', 'g') AS slug FROM part")
def slug(s, d):
    return t(s, d, "part").select("p_partkey", x.slug(F.col("p_name")).alias("slug"))


@query("tx25_heading", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN trim(string_split(text, chr(10))[1]) ELSE 'Untitled Article' END AS title FROM documents")
def heading(s, d):
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# "), "text")).otherwise(F.col("text"))
    return t(s, d, "documents").select("doc_id", x.heading(text).alias("title"))


@query("tx26_graph_key", "SELECT p_partkey, 'entity_' || replace(lower(p_name), ' ', '_') AS k FROM part")
def key(s, d):
    return t(s, d, "part").select("p_partkey", x.graph_key("entity", F.col("p_name")).alias("k"))


@query("tx27_handle_url", """WITH h AS (SELECT c_custkey, c_custkey % 8 AS k, replace(c_name, '#', '') AS n FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN 'https://www.youtube.com/@' || n || '/videos' WHEN 1 THEN 'https://www.youtube.com/@' || n || '/videos' WHEN 2 THEN 'https://www.youtube.com/@' || n || '/shorts' WHEN 3 THEN 'http://x.test/' || n || '/'
WHEN 4 THEN 'https://www.youtube.com/@' || n || '/videos' WHEN 5 THEN 'https://www.youtube.com/channel/UC' || substr(n || 'abcdefghijklmnopqrstuv', 1, 22) || '/videos' WHEN 6 THEN 'https://www.youtube.com/@UC' || n || '/videos' ELSE 'https://www.youtube.com/@' || n || '/videos' END AS url FROM h""")
def handle(s, d):
    """Handles in all their forms: URLs with and without a page, with @, ids of channels, bare names, with space around."""
    k, n = F.col("c_custkey") % 8, F.regexp_replace("c_name", "#", "")
    at = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    form = (
        F.when(k == 0, at(" https://www.youtube.com/@", n, "// ")).when(k == 1, at("https://www.youtube.com/@", n, "/videos")).when(k == 2, at("https://www.youtube.com/@", n, "/shorts"))
        .when(k == 3, at("http://x.test/", n, "/")).when(k == 4, at("\t@", n, "\n")).when(k == 5, at("UC", F.substring(at(n, "abcdefghijklmnopqrstuv"), 1, 22))).when(k == 6, at("UC", n)).otherwise(at(n, " "))
    )
    return t(s, d, "customer").select("c_custkey", x.channel_url(form).alias("url"))


@query("tx28_rescue_json", "SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN props END AS body FROM events")
def rescue(s, d):
    k = F.col("event_id") % 3  # fenced, plain within talk, broken
    text = F.when(k == 0, F.concat(F.lit("Sure, here:\n```json\n"), "props", F.lit("\n```\nDone."))).when(k == 1, F.concat(F.lit("> "), "props")).otherwise(F.concat(F.lit("{ "), "props"))
    return t(s, d, "events").select("event_id", x.rescue_json(text).alias("body"))


SQL_FUNCTION_WORDS = "len(regexp_extract_all(regexp_replace(' ' || lower(text) || ' ', '[^\\p{L}\\p{N}_]+', '  ', 'g'), ' (the|is|are|was|were|has|have|been|will|would|could|should|may|might) '))"
SQL_ENDS = "greatest(len(regexp_extract_all(text, '[.!?]+')), 1)"


@query("tx29_citations", f"SELECT doc_id, len(regexp_extract_all(text, '\\[[^\\n]*?\\]')) AS citations, {SQL_FUNCTION_WORDS} AS function_words, {SQL_ENDS} AS sentence_ends FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' [a] [b' || chr(10) || 'c] [d]' ELSE '' END AS text FROM documents)")
def citations(s, d):
    df = t(s, d, "documents").select("doc_id", F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.lit(" [a] [b\nc] [d]")).otherwise("")).alias("text"))
    text = F.col("text")
    return df.select("doc_id", x.citations(text).cast("long").alias("citations"), x.function_words(text).cast("long").alias("function_words"), x.sentence_ends(text).cast("long").alias("sentence_ends"))


@query("tx30_music", "SELECT conv_id, turn, conv_id % 3 = 0 OR turn % 4 = 1 AS flag FROM conversations")
def music(s, d):
    label = F.when(F.col("conv_id") % 3 == 0, " [Music] ").when(F.col("turn") % 4 == 1, "(MUSIC)").otherwise(" music ")
    return t(s, d, "conversations").select("conv_id", "turn", x.music_label(F.concat(label, "text")).alias("flag"))


@query("tx31_template", "SELECT conv_id, turn, 'Role: ' || role || chr(10) || 'Turn ' || turn || ' of <' || coalesce(CASE WHEN conv_id % 2 = 0 THEN conv_id END::VARCHAR, '') || '>: ' || text AS prompt FROM conversations")
def template(s, d):
    values = {"role": F.col("role"), "turn": F.col("turn"), "conv": F.when(F.col("conv_id") % 2 == 0, F.col("conv_id")), "text": F.col("text")}
    return t(s, d, "conversations").select("conv_id", "turn", x.render("Role: {{ role }}\nTurn {{turn}} of <{{ conv }}>: {{ text }}", values).alias("prompt"))


@query("tx32_assembly", """SELECT p_partkey, 'Title: ' || p_name || chr(10) || chr(10) || 'Summary: ' || CASE WHEN p_size > 10 THEN p_type ELSE '' END || chr(10) || chr(10) || 'Narrative: ' || p_brand
 || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || chr(10) || 'Cultural Context: {"region":"' || p_type || '"}' ELSE '' END AS body FROM part""")
def assembly(s, d):
    context = F.when(F.col("p_partkey") % 3 == 0, F.to_json(F.struct(F.col("p_type").alias("region")))).when(F.col("p_partkey") % 3 == 1, "{}")
    return t(s, d, "part").select("p_partkey", x.embedding_text(F.col("p_name"), F.when(F.col("p_size") > 10, F.col("p_type")), F.col("p_brand"), context).alias("body"))


@query("tx33_error_class", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'rate|quota') THEN 'rate' WHEN contains(lower(text), 'context') THEN 'context' ELSE 'other' END AS kind FROM documents")
def error_class(s, d):
    low = F.lower("text")
    return t(s, d, "documents").select("doc_id", F.when(low.rlike("rate|quota"), "rate").when(F.contains(low, F.lit("context")), "context").otherwise("other").alias("kind"))


@query("tx34_snippet", "SELECT doc_id, substring(text, greatest(1, instr(text, ' the ') - 20)::BIGINT, 60) AS snippet FROM documents WHERE contains(text, ' the ')")
def snippet(s, d):
    df = t(s, d, "documents").filter(F.contains("text", F.lit(" the ")))
    return df.select("doc_id", F.substring(F.col("text"), F.greatest(F.lit(1), F.instr("text", " the ") - 20), F.lit(60)).alias("snippet"))


@query("dt01_compact_date", "SELECT event_id, CASE WHEN event_id % 4 > 0 THEN strftime(ts, '%Y-%m-%d') END AS day FROM events")
def compact(s, d):
    raw = F.when(F.col("event_id") % 4 > 0, F.date_format("ts", "yyyyMMdd")).otherwise(F.lit("2024"))
    return t(s, d, "events").select("event_id", c.compact_date(raw).alias("day"))


@query("dt02_trunc", "SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS month FROM orders")
def trunc(s, d):
    return t(s, d, "orders").select("o_orderkey", F.date_trunc("month", "o_orderdate").cast("date").alias("month"))


@query("dt03_intervals", "SELECT o_orderkey, o_orderdate - INTERVAL 60 MINUTE AS a, o_orderdate + INTERVAL 7 DAY AS b FROM orders")
def intervals(s, d):
    return t(s, d, "orders").select("o_orderkey", F.expr("o_orderdate - INTERVAL '60' MINUTE").alias("a"), F.expr("o_orderdate + INTERVAL '7' DAY").alias("b"))


@query("dt04_epoch", "SELECT l_orderkey, l_linenumber, l_partkey, (epoch(l_shipdate) - epoch(o_orderdate))::BIGINT AS lag FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def epoch(s, d):
    sec = lambda n: F.unix_timestamp(F.col(n).cast("timestamp"))
    return t(s, d, "lineitem").join(t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", (sec("l_shipdate") - sec("o_orderdate")).alias("lag"))


@query("dt05_first_set", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END, CASE WHEN o_orderstatus = 'O' THEN TIMESTAMP '2002-01-01 00:00:00' END) AS started FROM orders")
def first_set(s, d):
    held = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate"))
    return t(s, d, "orders").select("o_orderkey", F.coalesce(held, F.when(F.col("o_orderstatus") == "O", F.expr("TIMESTAMP_NTZ '2002-01-01 00:00:00'"))).alias("started"))


@query("dt06_iso", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def iso(s, d):
    return t(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("mth02_clamp", "SELECT event_id, least(1.0, greatest(0.0, value / 50 - 0.5)) AS v FROM events")
def clamp(s, d):
    return t(s, d, "events").select("event_id", c.clamp(F.col("value") / 50 - 0.5).alias("v"))


@query("mth03_cost", """WITH e AS (SELECT event_id, user_id, CASE event_id % 4 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gemini-1.5-flash' WHEN 2 THEN 'gpt-4o-mini' ELSE 'other' END AS model FROM events),
m(model, a, b) AS (VALUES ('gpt-4o', 2.5::DOUBLE, 10.0::DOUBLE), ('gemini-1.5-flash', 0.075, 0.3), ('gpt-4o-mini', 0.15, 0.6)),
k(model, c, d) AS (VALUES ('gpt-4o', 0.0025::DOUBLE, 0.01::DOUBLE), ('gpt-4o-mini', 0.00015, 0.0006)),
v AS (SELECT event_id, coalesce(user_id / 1000000 * a + event_id / 1000000 * b, 0) AS by_million, coalesce(user_id / 1000 * c + event_id / 1000 * d, 0) AS by_thousand,
event_id / 2.0::DOUBLE / 15 * 0.006 AS by_seconds, event_id / 120.0::DOUBLE * 0.015 AS by_minute, event_id / 120.0::DOUBLE * 0.0059 AS by_minute_low, user_id * 0.006::DOUBLE AS file FROM e LEFT JOIN m USING (model) LEFT JOIN k USING (model))
SELECT event_id, """ + ", ".join(f"floor({c} * 1e7 + 0.5123)::BIGINT AS {c}" for c in ("by_million", "by_thousand", "by_seconds", "by_minute", "by_minute_low", "file")) + " FROM v")
def cost(s, d):
    """In ten-millionths."""
    k = F.col("event_id") % 4
    model = F.when(k == 0, "gpt-4o").when(k == 1, "gemini-1.5-flash").when(k == 2, "gpt-4o-mini").otherwise("other")
    n_in, n_out = F.col("user_id"), F.col("event_id")
    made = {"by_million": c.token_cost(model, n_in, n_out), "by_thousand": c.token_cost_by_thousand(model, n_in, n_out), **c.speech_cost(n_out), "file": c.file_cost(n_in)}
    return t(s, d, "events").select("event_id", *[F.floor(v * 1e7 + 0.5123).alias(n) for n, v in made.items()])


@query("mth05_backoff", """WITH a AS (SELECT DISTINCT l_orderkey, l_linenumber, least(60 * power(3, l_linenumber), 3600) AS wait FROM lineitem)
SELECT l_orderkey, l_linenumber, wait::BIGINT AS wait, round(wait * (0.8 + 0.4 * ('0x' || substr(md5('7/' || l_orderkey || '/' || l_linenumber), 1, 8))::BIGINT / 4294967296.0), 3) AS jittered FROM a""")
def backoff(s, d):
    """Waits of every order's tries, plain and moved by a seeded fifth."""
    n = F.col("l_linenumber")
    moved = c.backoff(n, jitter=c.seeded_unit(7, F.col("l_orderkey"), n))
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber").distinct().select("l_orderkey", "l_linenumber", c.backoff(n).alias("wait"), F.round(moved, 3).alias("jittered"))


@query("mth06_steps", "SELECT l_linenumber, ([60, 300, 900, 3600, 3600])[l_linenumber]::BIGINT AS wait FROM (SELECT DISTINCT l_linenumber FROM lineitem)")
def steps(s, d):
    return t(s, d, "lineitem").select("l_linenumber").distinct().select("l_linenumber", c.step_wait(F.col("l_linenumber")).cast("long").alias("wait"))


@query("mth07_safe_division", "SELECT l_orderkey, round(sum(l_quantity) / greatest(count(*) FILTER (WHERE l_returnflag = 'R'), 1), 6) AS v FROM lineitem GROUP BY 1")
def safe(s, d):
    return t(s, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_quantity") / F.greatest(F.count_if(F.col("l_returnflag") == "R"), F.lit(1)), 6).alias("v"))


@query("ar01_arrays", "SELECT vec_id, len(list_filter(embedding, lambda v: v > 0)) AS positive FROM embeddings")
def arrays(s, d):
    return t(s, d, "embeddings").select("vec_id", F.size(F.filter("embedding", lambda v: v > 0)).cast("long").alias("positive"))


@query("ar03_extremes", "SELECT vec_id, list_max(embedding)::DOUBLE AS most, list_min(embedding)::DOUBLE AS least FROM embeddings")
def extremes(s, d):
    return t(s, d, "embeddings").select("vec_id", F.array_max("embedding").cast("double").alias("most"), F.array_min("embedding").cast("double").alias("least"))


@query("mp01_map_default", "SELECT c_custkey, coalesce(map {'BUILDING': 'b', 'MACHINERY': 'm'}[c_mktsegment], 'other') AS v FROM customer")
def lookup(s, d):
    table = F.create_map(F.lit("BUILDING"), F.lit("b"), F.lit("MACHINERY"), F.lit("m"))
    return t(s, d, "customer").select("c_custkey", F.coalesce(F.try_element_at(table, F.col("c_mktsegment")), F.lit("other")).alias("v"))


@query("js01_nested", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id ELSE (props->>'k')::BIGINT END AS k FROM events")
def nested(s, d):
    broken = F.when(F.col("event_id") % 3 == 0, F.lit("{oops")).otherwise(F.col("props"))
    flat = F.concat(F.lit('{"k":'), F.col("event_id").cast("string"), F.lit("}"))
    return t(s, d, "events").select("event_id", F.variant_get(c.json_or_self(broken, flat), "$.k", "long").alias("k"))


@query("js02_serialise", """SELECT p_partkey, '{"p_brand":"' || p_brand || '","p_size":' || p_size || '}' AS j FROM part""")
def serialise(s, d):
    return t(s, d, "part").select("p_partkey", F.to_json(F.struct("p_brand", "p_size")).alias("j"))


@query("hs01_sha256", "SELECT doc_id, sha256(text) AS h FROM documents")
def sha(s, d):
    return t(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))


@query("hs02_stable_id", "SELECT c_custkey, sha256(c_name || chr(31) || c_mktsegment) AS id FROM customer")
def stable(s, d):
    return t(s, d, "customer").select("c_custkey", c.stable_id(F.col("c_name"), F.col("c_mktsegment")).alias("id"))
