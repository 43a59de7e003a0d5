"""QA and NM families: validation of knowledge documents, their scores, and entity resolution."""

from pyspark.sql import functions as F

from skein.functions.text import words
from skein.operators import aggregates, quality, resolve
from skein.registry import query
from skein.session import table as t

KINDS = [*quality.ENTITY_TYPES, "thing"]
TOPICS = [*quality.CATEGORIES, "odd"]


def knowledge(s, d):
    """Knowledge documents made of conversations, a claim and an entity for each turn, with all that can be wrong."""
    rows = t(s, d, "conversations")
    turn, conv, role = F.col("turn"), F.col("conv_id"), F.col("role")
    conf = ((turn * 37 + conv * 11) % 101).cast("int")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))
    proof = lambda n: F.transform(F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(1), n.cast("int")), lambda i: F.struct(F.col("text").alias("text"), F.when(i == 0, role).otherwise("").alias("speaker"))).cast(quality.EVIDENCE)
    entity_id = F.when(turn % 3 > 0, F.concat_ws("-", "role", (turn % 4).cast("string")))
    entity = F.struct(
        entity_id.alias("entityId"), F.when(turn % 9 < 8, role).alias("name"), F.when(turn % 5 == 0, F.concat(role, F.lit("!"))).alias("normalizedName"),
        F.when(turn % 13 < 12, pick(KINDS, turn + conv)).alias("entityType"), F.when(turn % 6 < 5, conf).alias("confidence"),
        F.when(turn % 2 == 0, "Bali").when(turn % 3 == 0, "").alias("region"), proof(turn % 4).alias("evidence"),
    )
    ids = F.when(turn % 8 < 7, F.concat(F.array(F.concat_ws("-", "role", (turn % 4).cast("string"))), F.when(turn % 5 == 1, F.array(F.lit("lost"), F.lit("lost"))).otherwise(F.array().cast("array<string>"))))
    claim = F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("claimId"), F.when(turn % 5 > 0, F.col("text")).alias("statement"), pick(TOPICS, turn * 3 + conv).alias("category"),
        F.when(turn % 7 < 6, conf).alias("confidence"), ids.alias("entityIds"), F.when(turn % 4 < 3, proof(turn % 3)).alias("evidence"),
    )
    docs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", claim.alias("c"), entity.alias("e")))).alias("all"))
    named = "array<struct<name:string>>"
    one = F.array(F.struct(F.lit("x").alias("name")))
    side = lambda i: F.struct(F.concat(F.lit("side "), i.cast("string")).alias("label"), F.when(i > 0, F.array(F.struct(F.lit("t").alias("text"), F.lit("s").alias("speaker")))).alias("evidence"))
    sides = F.transform(F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), (F.floor(conv / 4) % 3).cast("int")), side)
    return docs.select(
        conv.cast("string").alias("knowledgeId"), F.col("all.e").alias("entities"), F.col("all.c").alias("claims"),
        F.when(conv % 2 == 0, F.array(F.struct(F.when(conv % 3 > 0, "t").alias("themeId"), F.lit("x").alias("name"), F.lit(5).alias("confidence")))).alias("themes"),
        F.when(conv % 5 == 0, one).cast(named).alias("motifs"), F.when(conv % 3 == 0, one).cast(named).alias("beliefs"), F.when(conv % 6 == 0, one).cast(named).alias("rituals"),
        F.when(conv % 4 == 0, F.array(F.struct(conv.cast("string").alias("contradictionId"), sides.alias("sides")))).cast(f"array<struct<contradictionId:string,sides:array<struct<label:string,evidence:{quality.EVIDENCE}>>>>").alias("contradictions"),
    )


def sql_pick(names, n):
    return f"([{', '.join(repr(x) for x in names)}])[({n}) % {len(names)} + 1]"


def sql_even(x, digits):
    """The SQL of a double rounded to the nearest of its exact binary value, ties to even."""
    size, a = f"{10 ** digits}::DOUBLE", "abs(v)"
    k, high = f"floor({a} * {size})", f"({a} * 134217729::DOUBLE - ({a} * 134217729::DOUBLE - {a}))"
    off = f"(({high} * (2 * {size}) - (2 * {k} + 1)) + ({a} - {high}) * (2 * {size}))"
    return f"list_transform([({x})::DOUBLE], lambda v: sign(v) * ((CASE WHEN {off} > 0 THEN {k} + 1 WHEN {off} < 0 THEN {k} ELSE {k} + {k} % 2 END) / {size}))[1]"


NEED = "CASE WHEN {c} >= 80 THEN 3 WHEN {c} >= 60 THEN 2 WHEN {c} >= 20 THEN 1 ELSE 0 END"
COUNTS = f"""t AS (SELECT conv_id, turn, role, (turn * 37 + conv_id * 11) % 101 AS conf, CASE WHEN turn % 3 > 0 THEN role || '-' || turn % 4 END AS eid, {sql_pick(KINDS, 'turn + conv_id')} AS kind0,
  {sql_pick(TOPICS, 'turn * 3 + conv_id')} AS topic, CASE WHEN turn % 4 < 3 THEN turn % 3 END AS proofs, turn % 4 AS eproofs FROM conversations),
v AS (SELECT *, CASE WHEN turn % 13 < 12 THEN kind0 END AS kind, CASE WHEN turn % 6 < 5 THEN conf END AS econf, CASE WHEN turn % 7 < 6 THEN conf END AS cconf, coalesce(proofs, 0) AS n FROM t),
k AS (SELECT DISTINCT conv_id, eid FROM v WHERE eid IS NOT NULL),
o AS (SELECT v.conv_id, count(*) FILTER (WHERE k.eid IS NULL) + 2 * count(*) FILTER (WHERE turn % 5 = 1) AS orphans FROM v LEFT JOIN k ON k.conv_id = v.conv_id AND k.eid = v.role || '-' || v.turn % 4 WHERE turn % 8 < 7 GROUP BY 1),
dn AS (SELECT conv_id, count(*) AS doubles FROM (SELECT conv_id FROM v GROUP BY conv_id, CASE WHEN turn % 5 = 0 THEN lower(role) || '!' WHEN turn % 9 < 8 THEN lower(role) ELSE '' END HAVING count(*) > 1) GROUP BY 1),
g AS (SELECT conv_id, conv_id % 2 = 0 AS themed, conv_id % 5 = 0 AS motif,
  count(*) FILTER (WHERE eid IS NULL OR turn % 9 = 8 OR kind IS NULL OR econf IS NULL) + count(*) FILTER (WHERE turn % 5 = 0 OR cconf IS NULL OR proofs IS NULL) + (conv_id % 6 = 0)::INT AS missing,
  count(*) FILTER (WHERE kind = 'thing') AS types, count(*) FILTER (WHERE topic = 'odd') AS topics,
  count(*) FILTER (WHERE n < {NEED.format(c='coalesce(cconf, 0)')}) AS few, count(*) FILTER (WHERE eproofs = 0) AS bare,
  count(*) FILTER (WHERE coalesce(cconf, 0) >= 80 AND n < 2) + count(*) FILTER (WHERE coalesce(econf, 0) >= 90 AND eproofs = 0) AS mismatch, count(*) FILTER (WHERE coalesce(cconf, 0) < 20 AND n = 0) AS low,
  CASE WHEN conv_id % 4 = 0 THEN (conv_id // 4 % 3 < 2)::INT ELSE 0 END AS halved, CASE WHEN conv_id % 4 = 0 THEN (conv_id // 4 % 3 > 0)::INT ELSE 0 END AS unproven,
  count(*) FILTER (WHERE kind IN ('spirit', 'deity', 'creature') AND turn % 2 > 0) + (conv_id % 2 > 0)::INT + (conv_id % 6 = 3)::INT + (count(DISTINCT role) FILTER (WHERE n > 0) <= 1)::INT AS gaps,
  list_reduce(list_concat(list(coalesce(cconf, 0) / 100.0::DOUBLE ORDER BY turn), list(coalesce(econf, 0) / 100.0::DOUBLE ORDER BY turn)), lambda a, b: a + b) / (2 * count(*)) AS mean
  FROM v GROUP BY conv_id),
q AS (SELECT conv_id::VARCHAR AS id, *, coalesce(orphans, 0) AS lost, coalesce(doubles, 0) AS twice, 0.6::DOUBLE + 0.2::DOUBLE * themed::INT + 0.2::DOUBLE * motif::INT AS complete, missing + types + topics AS issues, few + bare AS evidence,
  few + bare + mismatch + low + coalesce(orphans, 0) + coalesce(doubles, 0) + halved + unproven + gaps AS warnings FROM g LEFT JOIN o USING (conv_id) LEFT JOIN dn USING (conv_id))"""
WITH_COUNTS = f"WITH {COUNTS} "
CLAMP = "greatest(0::DOUBLE, least(1::DOUBLE, {x}))"
CONSISTENT = CLAMP.format(x="1::DOUBLE - warnings * 0.05::DOUBLE")
COMPLIANT = CLAMP.format(x="1::DOUBLE - issues * 0.1::DOUBLE")
OVERALL = sql_even(CLAMP.format(x=f"complete * 0.25::DOUBLE + mean * 0.25::DOUBLE + {CONSISTENT} * 0.2::DOUBLE + {COMPLIANT} * 0.2::DOUBLE + (1::DOUBLE - evidence * 0.05::DOUBLE) * 0.1::DOUBLE"), 4)


def found(s, d, column, *kinds):
    """Number of findings of some (type, target) by document."""
    wanted = lambda f: F.concat_ws("/", f["type"], f["target"]).isin(*kinds)
    return quality.validate(knowledge(s, d)).select(F.col("knowledgeId").alias("id"), F.size(F.filter("kinds", wanted)).cast("long").alias(column))


def counts(column, expression):
    return WITH_COUNTS + f"SELECT id, ({expression})::BIGINT AS {column} FROM q"


@query("qa01_13_validate", WITH_COUNTS + f"""SELECT id AS "knowledgeId", {sql_even("complete", 4)} AS completeness, {sql_even("mean", 4)} AS confidence, {sql_even(CONSISTENT, 4)} AS consistency, {COMPLIANT} AS schema_score, issues = 0 AS schema_valid,
{OVERALL} AS overall, {OVERALL} >= 0.6::DOUBLE AS passed, issues::INT AS n_issues, warnings::INT AS n_warnings, evidence::INT AS n_evidence, least(issues, 10)::INT AS listed_issues, least(warnings, 20)::INT AS listed_warnings FROM q""")
def validate(s, d):
    return quality.validate(knowledge(s, d)).drop("kinds").withColumns({"listed_issues": F.size("issues"), "listed_warnings": F.size("warnings")}).drop("issues", "warnings")


@query("qa01_required_fields", counts("missing", "missing"))
def required_fields(s, d):
    return found(s, d, "missing", "missing_field/entity", "missing_field/claim", "missing_field/theme")


@query("qa02_domains", WITH_COUNTS + "SELECT id, types::BIGINT AS types, topics::BIGINT AS topics FROM q")
def domains(s, d):
    return found(s, d, "types", "invalid_entity_type/entity").join(found(s, d, "topics", "invalid_category/claim"), "id")


@query("qa03_evidence", counts("few", "few"))
def evidence(s, d):
    return found(s, d, "few", "insufficient_evidence/claim")


@query("qa04_bare_entities", counts("bare", "bare"))
def bare_entities(s, d):
    return found(s, d, "bare", "missing_evidence/entity")


@query("qa05_calibration", counts("miscalibrated", "mismatch + low"))
def calibration(s, d):
    return found(s, d, "miscalibrated", "confidence_mismatch/claim", "confidence_mismatch/entity", "low_confidence_no_evidence/claim")


@query("qa06_orphans", counts("orphans", "lost"))
def orphans(s, d):
    return found(s, d, "orphans", "orphaned_entity_reference/claim")


@query("qa07_duplicates", counts("doubles", "twice"))
def duplicates(s, d):
    return found(s, d, "doubles", "possible_duplicate/entity")


@query("qa08_contradictions", counts("open", "halved + unproven"))
def contradictions(s, d):
    return found(s, d, "open", "incomplete_contradiction/contradiction", "missing_evidence/contradiction")


@query("qa09_gaps", counts("gaps", "gaps"))
def gaps(s, d):
    return found(s, d, "gaps", "research_gap/entity", "research_gap/story")


def score(s, d, name):
    return quality.validate(knowledge(s, d)).select(F.col("knowledgeId").alias("id"), name)


@query("qa10_completeness", WITH_COUNTS + f"SELECT id, {sql_even('complete', 4)} AS completeness FROM q")
def completeness(s, d):
    return score(s, d, "completeness")


@query("qa11_confidence", WITH_COUNTS + f"SELECT id, {sql_even('mean', 4)} AS confidence FROM q")
def confidence(s, d):
    return score(s, d, "confidence")


@query("qa12_consistency", WITH_COUNTS + f"SELECT id, {sql_even(CONSISTENT, 4)} AS consistency FROM q")
def consistency(s, d):
    return score(s, d, "consistency")


@query("qa13_overall", WITH_COUNTS + f"SELECT id, {OVERALL} AS overall FROM q")
def overall(s, d):
    return score(s, d, "overall")


FW = "len(regexp_extract_all(regexp_replace(' ' || lower(text) || ' ', '[^\\p{L}\\p{N}_]+', '  ', 'g'), ' (the|is|are|was|were|has|have|been|will|would|could|should|may|might) '))"
ARTICLE = f"""a AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' [1] [2]' ELSE '' END AS text FROM documents),
n AS (SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS words, {FW} AS fw, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS ends, len(regexp_extract_all(text, '\\[[^\\n]*?\\]')) AS cites FROM a),
m AS (SELECT doc_id, words, cites, least(words / 150.0::DOUBLE, 1) AS l, greatest(0, 1::DOUBLE - fw / ends::DOUBLE) AS g, least(cites / 3.0::DOUBLE, 1) AS c FROM n)"""


def marked_text():
    return F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.lit(" [1] [2]")).otherwise(""))


QUALITY = "l * 0.4::DOUBLE + g * 0.3::DOUBLE + c * 0.3::DOUBLE"
RISK = "greatest(0::DOUBLE, 1::DOUBLE - (c * 0.5::DOUBLE + l * 0.3::DOUBLE + g * 0.2::DOUBLE))"


@query("qa14_article_metrics", f"WITH {ARTICLE} SELECT doc_id, words, cites AS citations, {sql_even(QUALITY, 2)} AS quality, {sql_even(RISK, 2)} AS risk, least({QUALITY} + 0.2::DOUBLE, 1) AS confidence FROM m")
def article_metrics(s, d):
    m = quality.article_metrics(marked_text())
    return t(s, d, "documents").select("doc_id", *[v.alias(k) for k, v in m.items()])


@query("qa15_article_score", "SELECT doc_id, CASE WHEN text = '' THEN 0.0 ELSE round(1.0 - CASE WHEN length(text) < 500 THEN 0.3 ELSE 0 END - CASE WHEN contains(lower(text), 'the') THEN 0 ELSE 0.2 END, 2) END::DOUBLE AS score, concat_ws(';', CASE WHEN length(text) < 500 THEN 'Content too short' END, CASE WHEN NOT contains(lower(text), 'the') THEN 'No canonical entities mentioned in article' END, CASE WHEN text = '' THEN 'Empty article content' END) AS issues FROM documents")
def article_score(s, d):
    names = F.array(F.lit("The"))
    return t(s, d, "documents").select("doc_id", quality.article_score(F.col("text"), names).alias("score"), F.array_join(quality.article_issues(F.col("text"), names), ";").alias("issues"))


@query("qa16_status", f"WITH {ARTICLE} SELECT doc_id, CASE WHEN {sql_even(QUALITY, 2)} > 0.5 THEN 'pending_review' ELSE 'needs_revision' END AS status FROM m")
def status(s, d):
    return t(s, d, "documents").select("doc_id", quality.review_status(quality.article_metrics(marked_text())["quality"]).alias("status"))


@query("qa18_gate", "SELECT d.doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'graph' ELSE 'review' END AS route, CASE WHEN quality = 1 AND toxic = 0 THEN NULL WHEN coalesce(quality, 0) < 0.7 THEN 'quality_below_threshold' ELSE 'not_ready_for_graph' END AS reason FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def gate(s, d):
    scored = t(s, d, "documents").select("doc_id").join(t(s, d, "labels"), "doc_id", "left").select("doc_id", F.col("quality").cast("double").alias("score"), (F.col("toxic") == 0).alias("ready"))
    return quality.quality_gate(scored, "score", "ready").select("doc_id", "route", F.col("dead.reason").alias("reason"))


@query("qa22_prompt_quality", """SELECT user_id, round(0.4 * (1 - err / n) + 0.2 * seen / n + 0.2 * (1 - err / n / 2) + 0.1 * (1 - spread) + 0.05 * cheap + 0.05 * (1 - slow), 6) AS score,
1 - err / n >= 0.85 AND seen / n >= 0.9 AND err / n / 2 <= 0.05 AND spread <= 0.1 AND cheap >= 0.8 AND coalesce(p95 <= 30, false) AS deployable
FROM (SELECT user_id, count(*)::DOUBLE AS n, count(*) FILTER (WHERE event_type = 'error')::DOUBLE AS err, count(value)::DOUBLE AS seen, (user_id % 20) / 100.0::DOUBLE AS spread, (user_id % 7 + 4) / 10.0::DOUBLE AS cheap, (user_id % 4) / 10.0::DOUBLE AS slow, CASE WHEN user_id % 9 > 0 THEN (user_id % 40)::DOUBLE END AS p95 FROM events GROUP BY 1)""")
def prompt_quality(s, d):
    """Users as prompt versions: error rates, and the other metrics by id."""
    n, err, u = F.count("*").cast("double"), F.count_if(F.col("event_type") == "error").cast("double"), F.col("user_id")
    runs = t(s, d, "events").groupBy("user_id").agg((1 - err / n).alias("accuracy"), (F.count("value") / n).alias("completeness"), (err / n / 2).alias("hallucination_rate"))
    runs = runs.withColumns({"consistency": (u % 20) / 100.0, "cost_efficiency": (u % 7 + 4) / 10.0, "latency_regression": (u % 4) / 10.0, "latency_p95": F.when(u % 9 > 0, (u % 40).cast("double"))})
    return quality.prompt_quality(runs).select("user_id", F.round("quality_score", 6).alias("score"), "deployable")


@query("qa23_rollback", """WITH r AS (SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') / count(*) AS quality, 0.8::DOUBLE AS before, sum(value) / count(*) AS tokens, 40::DOUBLE AS tokens_before FROM events GROUP BY 1),
h AS (SELECT user_id, max(rate) AS worst FROM (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS b, count(*) FILTER (WHERE event_type = 'error') / count(*) AS rate FROM events GROUP BY ALL) GROUP BY 1),
f AS (SELECT user_id, quality < 0.95 * before AS a, worst > 0.10 AS b, tokens > 1.5 * tokens_before AS c FROM r JOIN h USING (user_id))
SELECT user_id, concat_ws(',', CASE WHEN a THEN 'quality_drop' END, CASE WHEN b THEN 'hallucination_rate' END, CASE WHEN c THEN 'token_usage' END) AS triggers, CASE WHEN a OR b THEN 'automatic' WHEN c THEN 'operator' ELSE 'none' END AS action FROM f""")
def rollback(s, d):
    e = t(s, d, "events")
    bad = F.count_if(F.col("event_type") == "error")
    now = e.groupBy("user_id").agg((F.count_if(F.col("event_type") != "error") / F.count("*")).alias("quality"), (F.sum("value") / F.count("*")).alias("tokens"))
    hours = e.groupBy("user_id", F.window("ts", "1 hour")).agg((bad / F.count("*")).alias("rate")).groupBy("user_id").agg(F.max("rate").alias("hallucination_1h"))
    rows = now.join(hours, "user_id").withColumns({"quality_before": F.lit(0.8), "tokens_before": F.lit(40.0)})
    return quality.rollback_triggers(rows).select("user_id", F.array_join("triggers", ",").alias("triggers"), "action")


@query("qa25_state", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount * 10 > 0.9 THEN 'VERIFIED' WHEN l_discount * 10 > 0.7 THEN 'REVIEW_REQUIRED' WHEN l_discount * 10 < 0.5 THEN 'REJECTED' ELSE 'EXTRACTED' END AS state FROM lineitem")
def state(s, d):
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", quality.knowledge_state(F.col("l_discount") * 10).alias("state"))


#: Names for the customers of a nation: known ones in several spellings, aliases, and others.
NAMES = ("Kuntilanak", "pontianak", " KUNTI ", "gendruwo", "Genderuwo", "Leyak", "leak", "celeng", "Tuyul", "wewe gombel", "Sundel Bolong", "boneka arwah")


def entities(s, d):
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("c_custkey") % len(NAMES) + 1).cast("int"))
    rows = t(s, d, "customer").select(F.col("c_nationkey").alias("doc"), F.col("c_custkey").alias("place"), F.concat(F.lit("e"), F.col("c_custkey").cast("string")).alias("id"), name.alias("name"), F.col("c_acctbal").alias("confidence"), F.array("c_mktsegment").alias("evidence"))
    return resolve.canonical(rows, resolve.alias_table(s), "name")


ENTITIES = f"""n AS (SELECT c_nationkey AS doc, c_custkey AS place, 'e' || c_custkey AS id, {sql_pick(NAMES, 'c_custkey')} AS name, c_acctbal AS confidence, c_mktsegment AS seg FROM customer),
known(canonical, alias) AS (VALUES ('kuntilanak', 'kuntilanak'), ('kuntilanak', 'pontianak'), ('kuntilanak', 'kunti'), ('genderuwo', 'gendruwo'), ('genderuwo', 'genderuwo'), ('tuyul', 'tuyul'), ('wewe', 'wewe gombel'), ('leak', 'leyak'), ('leak', 'leak'), ('babi ngepet', 'celeng'), ('jelangkung', 'boneka arwah')),
e AS (SELECT n.*, coalesce(known.canonical, lower(trim(name))) AS canonical, known.canonical IS NOT NULL AS known FROM n LEFT JOIN known ON alias = lower(trim(name)))"""


@query("nm01_alias_map", f"WITH {ENTITIES} SELECT doc, canonical, coalesce(string_agg(DISTINCT lower(trim(name)), ',' ORDER BY lower(trim(name))) FILTER (WHERE known), '') AS names FROM e GROUP BY ALL")
def alias_map(s, d):
    return resolve.alias_map(entities(s, d), resolve.alias_table(s), "doc").select("doc", "canonical", F.array_join("names", ",").alias("names"))


@query("nm02_canonical", f"WITH {ENTITIES} SELECT id, canonical FROM e")
def canonical(s, d):
    return entities(s, d).select("id", "canonical")


@query("nm03_merge", f"WITH {ENTITIES} SELECT doc, canonical, min(place) AS place, min_by(name, place) AS name, max(confidence) AS confidence, count(*) AS merged, (SELECT string_agg(seg, ',' ORDER BY p) FROM (SELECT seg, min(place) AS p FROM e i WHERE i.doc = o.doc AND i.canonical = o.canonical GROUP BY seg)) AS evidence FROM e o GROUP BY doc, canonical")
def merge(s, d):
    return resolve.merge(entities(s, d), "doc", "place").select("doc", "canonical", "place", "name", "confidence", "merged", F.array_join("evidence", ",").alias("evidence"))


@query("nm04_backfill", f"WITH {ENTITIES} SELECT id, CASE canonical WHEN 'leak' THEN CASE lower(name) WHEN 'leyak' THEN 'own,leak bali' ELSE 'own,leyak,leak bali' END WHEN 'wewe' THEN 'own,gandarwa' WHEN 'tuyul' THEN 'own,hantu anak kecil' WHEN 'babi ngepet' THEN 'own,babi ngepet' WHEN 'jelangkung' THEN 'own,jelangkung' WHEN 'genderuwo' THEN CASE lower(name) WHEN 'gendruwo' THEN 'own,genderuwo,hantu bodoh' ELSE 'own,gendruwo,hantu bodoh' END WHEN 'kuntilanak' THEN CASE lower(name) WHEN 'pontianak' THEN 'own,kunti,hantu perempuan' ELSE 'own,pontianak,kunti,hantu perempuan' END ELSE 'own' END AS aliases FROM e")
def backfill(s, d):
    """The entity's own alias first; its name in lower case is left out, which ' KUNTI ' with its spaces is not."""
    return entities(s, d).select("id", F.array_join(resolve.backfill(F.col("canonical"), F.col("name"), F.array(F.lit("own"))), ",").alias("aliases"))


@query("nm05_regions", "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'Jawa Timur' WHEN 1 THEN 'Bali' WHEN 2 THEN 'Sumatera Utara' WHEN 3 THEN ' Papua' ELSE NULL END AS region FROM supplier")
def regions(s, d):
    k = F.col("s_suppkey") % 5
    name = F.when(k == 0, " JAWA timur ").when(k == 1, "bali").when(k == 2, "Sumatera Utara").when(k == 3, " Papua")
    return t(s, d, "supplier").select("s_suppkey", resolve.region(name).alias("region"))


@query("nm06_rewrite", f"WITH {ENTITIES}, f AS (SELECT doc, canonical, min_by(id, place) AS target FROM e GROUP BY ALL), m AS (SELECT e.doc, e.id, f.target FROM e JOIN f USING (doc, canonical)) SELECT n.place, coalesce(a.target, 'e' || n.place) || ',' || coalesce(b.target, 'e' || (n.place + 12)) || ',x' AS ids FROM n LEFT JOIN m a ON a.doc = n.doc AND a.id = 'e' || n.place LEFT JOIN m b ON b.doc = n.doc AND b.id = 'e' || (n.place + 12)")
def rewrite(s, d):
    e = entities(s, d)
    claims = e.select("doc", "place", F.array(F.col("id"), F.concat(F.lit("e"), (F.col("place") + 12).cast("string")), F.lit("x")).alias("ids"))
    return resolve.rewrite_references(claims, resolve.merge_log(e, "doc", "place", "id"), "doc", "ids").select("place", F.array_join("ids", ",").alias("ids"))


@query("nm07_report", f"WITH {ENTITIES}, a AS (SELECT doc, count(DISTINCT lower(trim(name))) FILTER (WHERE known) AS resolved, count(*) - count(DISTINCT canonical) AS merged FROM e GROUP BY 1) SELECT doc, resolved, merged FROM a")
def report(s, d):
    """Aliases resolved and entities merged, by document."""
    e = entities(s, d)
    resolved = resolve.alias_map(e, resolve.alias_table(s), "doc").groupBy("doc").agg(F.sum(F.size("names")).alias("resolved"))
    merged = resolve.merge_log(e, "doc", "place", "id").groupBy("doc").agg(F.count("*").alias("merged"))
    return resolved.join(merged, "doc", "left").select("doc", "resolved", F.coalesce("merged", F.lit(0)).cast("long").alias("merged"))


@query("nm08_registry", f"WITH {ENTITIES} SELECT canonical, count(DISTINCT doc) AS stories, min(place) AS first_seen FROM e GROUP BY 1")
def registry(s, d):
    return resolve.registry(entities(s, d), "doc", "place")


@query("jn14_dictionary", f"WITH {ENTITIES} SELECT canonical, count(*) AS n FROM e WHERE known GROUP BY 1")
def dictionary(s, d):
    """Rows of the dictionary's names alone, by canonical name."""
    aliases = resolve.alias_table(s)
    first = aliases.groupBy("alias").agg(F.min_by("canonical", "place").alias("found"))
    rows = entities(s, d).join(F.broadcast(first), F.lower(F.trim("name")) == F.col("alias"))
    return rows.groupBy(F.col("found").alias("canonical")).agg(F.count("*").alias("n"))


EXTRACTED = """c AS (SELECT l_orderkey, coalesce(CASE WHEN l_linenumber % 5 > 0 THEN l_discount * 10 END, 0.5) AS v FROM lineitem WHERE l_partkey % 3 = 0),
m AS (SELECT l_orderkey, sum(v::DECIMAL(18,4))::DOUBLE / count(*) AS mean, min(v) AS least, count(*) FILTER (WHERE v < 0.6) AS low, count(*) FILTER (WHERE v < 0.6) / count(*) AS risk FROM c GROUP BY 1)"""


@query("ag17_extraction_metrics", f"WITH {EXTRACTED} SELECT o_orderkey, {sql_even('coalesce(mean, 0)', 3)} AS mean, {sql_even('coalesce(least, 1)', 3)} AS least, coalesce(low, 0) AS low, {sql_even('coalesce(risk, 0)', 3)} AS risk FROM orders LEFT JOIN m ON l_orderkey = o_orderkey")
def extraction(s, d):
    """Orders as runs, a third of their lines as extracted items; some runs have none."""
    items = t(s, d, "lineitem").filter("l_partkey % 3 = 0").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linenumber") % 5 > 0, F.col("l_discount") * 10).alias("c"))
    return aggregates.extraction_metrics(t(s, d, "orders"), items, "o_orderkey", "c")


@query("ag18_transcript_stats", "SELECT conv_id, count(*) AS segments, sum(n)::BIGINT AS words, sum(n)::DOUBLE / count(*) AS mean, sum(c::DECIMAL(18,4))::DOUBLE / count(*) AS confidence FROM (SELECT conv_id, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS n, CASE WHEN turn % 3 > 0 THEN (turn * 7 % 100) / 100.0 ELSE 0.95 END AS c FROM conversations) GROUP BY 1")
def transcripts(s, d):
    """Segments, words and confidence of transcripts; an unknown confidence is 0.95."""
    known = F.when(F.col("turn") % 3 > 0, (F.col("turn") * 7 % 100) / 100.0)
    sized = t(s, d, "conversations").select("conv_id", F.size(words(F.col("text"))).alias("n"), F.coalesce(known, F.lit(0.95)).alias("c"))
    return sized.groupBy("conv_id").agg(F.count("*").alias("segments"), F.sum("n").alias("words"), aggregates.mean("n").alias("mean"), aggregates.mean("c").alias("confidence"))


@query("ag29_entity_frequency", "SELECT lower(role) AS name, count(*) AS mentions, count(DISTINCT conv_id) AS documents FROM conversations WHERE turn % 9 < 8 GROUP BY 1")
def entity_frequency(s, d):
    named = knowledge(s, d).select("knowledgeId", F.explode("entities").alias("e")).select("knowledgeId", F.lower("e.name").alias("name")).filter("name is not null")
    return named.groupBy("name").agg(F.count("*").alias("mentions"), F.count_distinct("knowledgeId").alias("documents"))


@query("ag29_contradiction_density", "WITH r AS (SELECT DISTINCT conv_id, coalesce(CASE WHEN turn % 2 = 0 THEN 'Bali' WHEN turn % 3 = 0 THEN '' END, 'unknown') AS region FROM conversations) SELECT region, count(*) AS documents, count(*) FILTER (WHERE conv_id % 4 = 0) AS contradictions, count(*) FILTER (WHERE conv_id % 4 = 0) / count(*) AS density FROM r GROUP BY 1")
def contradiction_density(s, d):
    """Contradictions of the documents that touch a region."""
    docs = knowledge(s, d).select(F.coalesce(F.size("contradictions"), F.lit(0)).alias("n"), F.explode(F.array_distinct(F.transform("entities", lambda e: F.coalesce(e["region"], F.lit("unknown"))))).alias("region"))
    out = docs.groupBy("region").agg(F.count("*").alias("documents"), F.sum("n").alias("contradictions"))
    return out.withColumn("density", F.col("contradictions") / F.col("documents"))


@query("ag29_weak_claims", "SELECT conv_id || '-' || turn AS claim, ((turn * 37 + conv_id * 11) % 101)::INT AS confidence FROM conversations WHERE turn % 7 < 6 ORDER BY 2, 1 LIMIT 20")
def weak_claims(s, d):
    """The twenty claims of the least confidence."""
    claims = knowledge(s, d).select(F.explode("claims").alias("c")).select(F.col("c.claimId").alias("claim"), "c.confidence").filter("confidence is not null")
    return claims.orderBy("confidence", "claim").limit(20)


@query("ag29_gaps", WITH_COUNTS + "SELECT gaps > 2 AS many, count(*) AS documents, sum(gaps)::BIGINT AS gaps FROM q GROUP BY 1")
def gap_totals(s, d):
    gaps = quality.validate(knowledge(s, d)).select(F.size(F.filter("kinds", lambda k: k["type"] == "research_gap")).alias("gaps"))
    return gaps.groupBy((F.col("gaps") > 2).alias("many")).agg(F.count("*").alias("documents"), F.sum("gaps").alias("gaps"))
