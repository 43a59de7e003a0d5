"""RT family and stateful SS rows: state machines, dispatch, retries, priorities, editorial decisions."""

from pyspark.sql import functions as F

from skein.operators import routing
from skein.registry import query
from skein.session import table as t

STATES = """s(i, state) AS (VALUES (0, 'SUBMITTED'), (1, 'QUEUED'), (2, 'METADATA_EXTRACTING'), (3, 'METADATA_EXTRACTED'), (4, 'TRANSCRIPT_EXTRACTING'), (5, 'TRANSCRIPT_READY'), (6, 'CANONICALIZING'), (7, 'CANONICALIZED'),
 (8, 'KNOWLEDGE_EXTRACTING'), (9, 'KNOWLEDGE_READY'), (10, 'GRAPH_SYNCING'), (11, 'GRAPH_READY'), (12, 'ARTICLES_GENERATING'), (13, 'ARTICLES_GENERATED'), (14, 'PUBLISHED'), (15, 'COMPLETED'),
 (16, 'FAILED_METADATA'), (17, 'FAILED_TRANSCRIPT'), (18, 'FAILED_LLM'), (19, 'FAILED_ARTICLE'), (20, 'FAILED_GRAPH'), (21, 'FAILED_REVIEW'), (22, 'MANUAL_REVIEW_REQUIRED'))"""
#: Allowed moves by the numbers above; the stages follow each other but for those named.
MOVES = """m(a, b) AS (VALUES (0, 1), (1, 2), (1, 16), (2, 3), (2, 16), (3, 4), (3, 15), (4, 5), (4, 17), (4, 22), (5, 6), (6, 7), (6, 18), (7, 8), (8, 9), (8, 18), (9, 10), (10, 11), (10, 20), (11, 12), (11, 15), (12, 13), (12, 19), (13, 14), (14, 15),
 (16, 1), (17, 1), (18, 1), (19, 1), (20, 1), (21, 1))"""
REQUESTS = f"""{STATES}, {MOVES}, r AS (SELECT event_id, CASE WHEN event_id % 29 > 0 THEN event_id % 23 END AS i, (user_id * 7 + event_id // 23) % 23 AS j, event_id % 5 AS retries, ts FROM events)"""


def requests(s, d):
    """Events as requested moves; some videos have no state yet."""
    pick = lambda n: F.element_at(F.array(*[F.lit(x) for x in routing.STATES]), (n % len(routing.STATES) + 1).cast("int"))
    e, i = t(s, d, "events"), F.col("event_id")
    return e.select("event_id", "ts", F.when(i % 29 > 0, pick(i)).alias("current"), pick(F.col("user_id") * 7 + F.floor(i / 23)).alias("new"), (i % 5).alias("retries"))


@query("rt05_state_machine", f"WITH {REQUESTS} SELECT event_id, CASE WHEN m.a IS NULL THEN 'invalid' WHEN j BETWEEN 16 AND 21 AND retries >= 3 THEN 'retries' END AS reason FROM r LEFT JOIN m ON m.a = coalesce(i, 0) AND m.b = j")
def machine(s, d):
    return routing.check_moves(requests(s, d)).select("event_id", "reason")


@query("rt05_applied", f"""WITH {REQUESTS}, ok AS (SELECT r.* FROM r JOIN m ON m.a = coalesce(i, 0) AND m.b = j WHERE NOT (j BETWEEN 16 AND 21 AND retries >= 3))
SELECT event_id, state, retries + (j BETWEEN 16 AND 21)::INT AS retries, CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' WHEN j > 1 THEN ts END AS started, CASE WHEN j IN (14, 15) THEN ts END AS completed FROM ok JOIN s ON s.i = j""")
def applied(s, d):
    """What the granted moves change."""
    rows = requests(s, d).withColumns({"started": F.when(F.col("event_id") % 2 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")), "completed": F.lit(None).cast("timestamp_ntz")})
    return routing.apply_moves(routing.check_moves(rows), "ts").select("event_id", "state", "retries", "started", "completed")


@query("rt06_lenient", f"WITH {REQUESTS} SELECT event_id, m.a IS NOT NULL OR j = 22 AS ok FROM r LEFT JOIN m ON m.a = coalesce(i, 0) AND m.b = j")
def lenient(s, d):
    """The database's own rules: to manual review from anywhere, no ceiling of retries."""
    return routing.check_moves(requests(s, d), lenient=True).select("event_id", "ok")


@query("rt07_dispatch", f"""WITH {REQUESTS} SELECT event_id, CASE WHEN retries = 4 THEN 'skip' ELSE CASE i WHEN 1 THEN 'metadata_extraction' WHEN 3 THEN 'transcript_extraction' WHEN 5 THEN 'canonicalization' WHEN 7 THEN 'knowledge_extraction' WHEN 9 THEN 'graph_sync' WHEN 11 THEN 'article_generation' END END AS stage,
CASE WHEN retries = 4 THEN CASE WHEN i IN (3, 11, 14) THEN 'COMPLETED' ELSE 'QUEUED' END END AS after FROM r""")
def dispatch(s, d):
    priority = F.when(F.col("retries") == 4, "SKIP").otherwise("HIGH")
    rows = requests(s, d).withColumn("stage", routing.dispatch(F.col("current"), priority))
    return rows.select("event_id", "stage", F.when(F.col("stage") == "skip", F.coalesce(routing.skip_outcome(F.col("current")), F.lit("QUEUED"))).alias("after"))


@query("rt08_error_state", f"WITH {REQUESTS} SELECT event_id, CASE i WHEN 2 THEN 'FAILED_METADATA' WHEN 4 THEN 'FAILED_TRANSCRIPT' WHEN 6 THEN 'FAILED_LLM' WHEN 8 THEN 'FAILED_LLM' WHEN 10 THEN 'FAILED_GRAPH' WHEN 12 THEN 'FAILED_ARTICLE' ELSE 'FAILED_REVIEW' END AS state FROM r")
def error_state(s, d):
    return requests(s, d).select("event_id", routing.error_state(F.col("current")).alias("state"))


@query("rt09_skipped_steps", "SELECT o_orderkey, greatest(0, 6 - CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderpriority = '5-LOW' THEN 3 WHEN o_orderpriority = '1-URGENT' THEN 6 ELSE 5 END) AS skipped FROM orders")
def skipped_steps(s, d):
    """How many of a full run's steps its priority leaves out."""
    p = F.when(F.col("o_orderkey") % 7 == 0, "SKIP").when(F.col("o_orderpriority") == "5-LOW", "LOW").when(F.col("o_orderpriority") == "1-URGENT", "HIGH")
    runs = t(s, d, "orders").select("o_orderkey", F.lit("full").alias("kind"), p.alias("priority"))
    steps = routing.expand_runs(runs, "kind", "priority").groupBy("o_orderkey").agg(F.count("*").alias("n"))
    return runs.join(steps, "o_orderkey", "left").select("o_orderkey", (len(routing.STEPS) - F.coalesce("n", F.lit(0))).cast("int").alias("skipped"))


@query("rt11_step_retry", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag <> 'R' THEN 'COMPLETED' WHEN l_linenumber >= 3 THEN 'FAILED' ELSE 'PENDING' END AS step, CASE WHEN l_returnflag = 'R' AND l_linenumber >= 3 THEN 'FAILED' ELSE 'RUNNING' END AS run FROM lineitem")
def step_retry(s, d):
    step, run = routing.step_outcome(F.col("l_returnflag") != "R", F.col("l_linenumber"), F.lit(3))
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", step.alias("step"), run.alias("run"))


@query("rt12_inherit", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'OWN' END, CASE WHEN c_custkey IS NULL THEN NULL WHEN c_custkey % 8 = 0 OR c_acctbal * 10 < 10000 THEN 'LOW' WHEN c_custkey % 5 > 0 THEN c_mktsegment END, 'MEDIUM') AS priority FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 11 > 0) ON c_custkey = o_custkey")
def inherit(s, d):
    """Customers as channels with a size; some unknown, some without a priority, some of unknown size."""
    c = t(s, d, "customer").filter("c_custkey % 11 > 0")
    channels = c.select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).alias("default"), F.when(F.col("c_custkey") % 8 > 0, F.col("c_acctbal") * 10).alias("size"))
    df = t(s, d, "orders").join(channels, F.col("c_custkey") == F.col("o_custkey"), "left")
    own = F.when(F.col("o_orderkey") % 3 == 0, "OWN")
    return df.select("o_orderkey", routing.inherit_priority(own, F.col("c_custkey").isNotNull(), F.col("default"), F.col("size")).alias("priority"))


@query("rt15_dispatch", "SELECT CASE lang WHEN 'en' THEN 'crawl_video' WHEN 'de' THEN 'crawl_channel' END AS route, count(*) AS n FROM documents WHERE lang IN ('en', 'de') GROUP BY 1")
def source_dispatch(s, d):
    """Languages as kinds of sources; unknown kinds are dropped."""
    kind = F.when(F.col("lang") == "en", "youtube_video").when(F.col("lang") == "de", "youtube_channel").otherwise(F.col("lang"))
    routes = t(s, d, "documents").select(routing.source_route(kind).alias("route"))
    return routes.filter("route is not null").groupBy("route").agg(F.count("*").alias("n"))


@query("rt17_retry_class", """WITH k AS (SELECT event_id, event_id % 6 AS tries, ([ 'RateLimitError', 'TimeoutError', 'ServiceUnavailable', 'NetworkError', 'InternalServerError', 'InvalidRequestError', 'AuthenticationError', 'AuthorizationError', 'ContentFilterError', 'SchemaValidationError', 'Odd'])[user_id % 11 + 1] AS error, user_id % 11 AS i FROM events)
SELECT event_id, error, CASE WHEN i = 10 THEN 'UNKNOWN' WHEN i >= 5 OR tries >= 5 THEN 'DEAD_LETTER' ELSE 'RETRY' END AS decision FROM k""")
def retry_class(s, d):
    names = [*routing.RETRYABLE, *routing.NOT_RETRYABLE, "Odd"]
    error = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("user_id") % len(names) + 1).cast("int"))
    rows = t(s, d, "events").select("event_id", error.alias("error"), (F.col("event_id") % 6).alias("tries"))
    return rows.select("event_id", "error", routing.retry_decision(F.col("error"), F.col("tries")).alias("decision"))


EDITORIAL = """x(kind, a, b, roles) AS (VALUES ('story', 'DRAFT', 'REVIEW', 'Creator'), ('story', 'REVIEW', 'APPROVED', 'Reviewer'), ('story', 'REVIEW', 'REJECTED', 'Reviewer'), ('story', 'APPROVED', 'PUBLISHED', 'Editor'), ('story', 'APPROVED', 'DRAFT', 'Admin'),
 ('story', 'REJECTED', 'DRAFT', 'Creator'), ('story', 'PUBLISHED', 'ARCHIVED', 'Admin'), ('story', 'PUBLISHED', 'DRAFT', 'Admin'), ('story', 'ARCHIVED', 'DRAFT', 'Admin'),
 ('knowledge_object', 'EXTRACTED', 'REVIEW_REQUIRED', 'System'), ('knowledge_object', 'EXTRACTED', 'VERIFIED', 'System'), ('knowledge_object', 'EXTRACTED', 'REJECTED', 'System'), ('knowledge_object', 'REVIEW_REQUIRED', 'VERIFIED', 'Reviewer'), ('knowledge_object', 'REVIEW_REQUIRED', 'REJECTED', 'Reviewer'),
 ('knowledge_object', 'VERIFIED', 'PUBLISHED', 'Editor'), ('knowledge_object', 'VERIFIED', 'FLAGGED', 'System Reviewer'), ('knowledge_object', 'FLAGGED', 'VERIFIED', 'Reviewer'), ('knowledge_object', 'FLAGGED', 'REJECTED', 'Admin'), ('knowledge_object', 'PUBLISHED', 'FLAGGED', 'System'),
 ('article', 'GENERATING', 'DRAFT', 'System'), ('article', 'DRAFT', 'REVIEW', 'Editor'), ('article', 'REVIEW', 'PUBLISHED', 'Reviewer'), ('article', 'REVIEW', 'DRAFT', 'Reviewer'), ('article', 'PUBLISHED', 'ARCHIVED', 'Editor'), ('article', 'ARCHIVED', 'DRAFT', 'Editor'))"""
KINDS = ("story", "knowledge_object", "article")
ENDS = ("DRAFT", "REVIEW", "APPROVED", "PUBLISHED", "REJECTED", "ARCHIVED", "EXTRACTED", "REVIEW_REQUIRED", "VERIFIED", "FLAGGED", "GENERATING")
ROLES = ("Creator", "Reviewer", "Editor", "Admin", "System")


@query("rt18_editorial", f"WITH {EDITORIAL}, r AS (SELECT event_id, ({list(KINDS)})[event_id % 3 + 1] AS kind, ({list(ENDS)})[event_id // 3 % 11 + 1] AS a, ({list(ENDS)})[event_id // 33 % 11 + 1] AS b, ({list(ROLES)})[event_id // 7 % 5 + 1] AS role FROM events) SELECT event_id, x.kind IS NOT NULL AND (role = 'Admin' OR list_contains(string_split(roles, ' '), role)) AS ok FROM r LEFT JOIN x USING (kind, a, b)")
def editorial(s, d):
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (F.floor(n) % len(names) + 1).cast("int"))
    i = F.col("event_id")
    rows = t(s, d, "events").select("event_id", pick(KINDS, i).alias("kind"), pick(ENDS, i / 3).alias("current"), pick(ENDS, i / 33).alias("new"), pick(ROLES, i / 7).alias("role"))
    return routing.check_editorial(rows).select("event_id", "ok")


@query("rt19_decisions", """WITH k(kind, action, status) AS (VALUES ('review', 'request', 'requested'), ('review', 'start', 'in_review'), ('review', 'approve', 'approved'), ('review', 'reject', 'rejected'), ('approval', 'request', 'pending'), ('approval', 'approve', 'approved'), ('approval', 'reject', 'rejected'),
 ('publication', 'create', 'draft'), ('publication', 'publish', 'published'), ('publication', 'unpublish', 'unpublished'), ('moderation', 'flag', 'flagged'), ('moderation', 'resolve', 'resolved'), ('moderation', 'reopen', 'flagged')),
r AS (SELECT user_id, event_id, (['review', 'approval', 'publication', 'moderation'])[event_id % 4 + 1] AS kind, (['request', 'approve', 'publish', 'flag', 'reject', 'start', 'unpublish', 'resolve', 'reopen', 'create', 'odd'])[event_id // 4 % 11 + 1] AS action FROM events)
SELECT user_id, kind, max_by(status, event_id) AS status, max(event_id) AS event_id FROM r JOIN k USING (kind, action) GROUP BY ALL""")
def decisions(s, d):
    actions = ("request", "approve", "publish", "flag", "reject", "start", "unpublish", "resolve", "reopen", "create", "odd")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (F.floor(n) % len(names) + 1).cast("int"))
    rows = t(s, d, "events").select("user_id", "event_id", pick(tuple(routing.DECISIONS), F.col("event_id")).alias("kind"), pick(actions, F.col("event_id") / 4).alias("action"))
    return routing.latest_status(rows, "user_id", "event_id")


RUN = f"""WITH RECURSIVE {STATES}, {MOVES}, e AS (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN 1 + event_id // 2 % 15 ELSE event_id // 2 % 23 END AS j, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, 0::BIGINT AS n, 0 AS i, 0 AS retries, NULL::BIGINT AS event_id, false AS ok FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL SELECT user_id, n, CASE WHEN ok THEN j ELSE i END, retries + CASE WHEN ok AND j BETWEEN 16 AND 21 THEN 1 ELSE 0 END, event_id, ok
 FROM (SELECT f.user_id, e.n, f.i, f.retries, e.j, e.event_id, m.a IS NOT NULL AND NOT (e.j BETWEEN 16 AND 21 AND f.retries >= 3) AS ok FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1 LEFT JOIN m ON m.a = f.i AND m.b = e.j))
"""


def requests_of(s, d):
    """Each user's events as requests to move one video on."""
    i = F.col("event_id")
    pick = lambda n: F.element_at(F.array(*[F.lit(x) for x in routing.STATES]), (n + 1).cast("int"))
    new = F.when(i % 2 == 0, pick(1 + F.floor(i / 2) % 15)).otherwise(pick(F.floor(i / 2) % 23))
    return t(s, d, "events").select("user_id", "event_id", "ts", new.alias("new"))


@query("ss10_state_machine", RUN + "SELECT event_id, state, retries, ok FROM f JOIN s ON s.i = f.i WHERE event_id IS NOT NULL")
def stateful(s, d):
    """The requests in order of time: the state, retries and verdict after each."""
    return routing.run_moves(requests_of(s, d), "user_id", "ts", "event_id").select("event_id", "state", "retries", "ok")
