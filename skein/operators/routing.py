"""State machines, retries and routing as tables and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.machines import run_blocks

#: The 23 states of a video and the states that each may move to.
MOVES: dict[str, tuple[str, ...]] = {
    "SUBMITTED": ("QUEUED",),
    "QUEUED": ("METADATA_EXTRACTING", "FAILED_METADATA"),
    "METADATA_EXTRACTING": ("METADATA_EXTRACTED", "FAILED_METADATA"),
    "METADATA_EXTRACTED": ("TRANSCRIPT_EXTRACTING", "COMPLETED"),
    "TRANSCRIPT_EXTRACTING": ("TRANSCRIPT_READY", "FAILED_TRANSCRIPT", "MANUAL_REVIEW_REQUIRED"),
    "TRANSCRIPT_READY": ("CANONICALIZING",),
    "CANONICALIZING": ("CANONICALIZED", "FAILED_LLM"),
    "CANONICALIZED": ("KNOWLEDGE_EXTRACTING",),
    "KNOWLEDGE_EXTRACTING": ("KNOWLEDGE_READY", "FAILED_LLM"),
    "KNOWLEDGE_READY": ("GRAPH_SYNCING",),
    "GRAPH_SYNCING": ("GRAPH_READY", "FAILED_GRAPH"),
    "GRAPH_READY": ("ARTICLES_GENERATING", "COMPLETED"),
    "ARTICLES_GENERATING": ("ARTICLES_GENERATED", "FAILED_ARTICLE"),
    "ARTICLES_GENERATED": ("PUBLISHED",),
    "PUBLISHED": ("COMPLETED",),
    "COMPLETED": (),
    "FAILED_METADATA": ("QUEUED",),
    "FAILED_TRANSCRIPT": ("QUEUED",),
    "FAILED_LLM": ("QUEUED",),
    "FAILED_ARTICLE": ("QUEUED",),
    "FAILED_GRAPH": ("QUEUED",),
    "FAILED_REVIEW": ("QUEUED",),
    "MANUAL_REVIEW_REQUIRED": (),
}
STATES = tuple(MOVES)
MAX_RETRIES = 3

#: Fixed values: (from, to, role) of the editorial state machines.
EDITORIAL: dict[str, tuple[tuple[str, str, str], ...]] = {
    "story": (
        ("DRAFT", "REVIEW", "Creator"),
        ("REVIEW", "APPROVED", "Reviewer"),
        ("REVIEW", "REJECTED", "Reviewer"),
        ("APPROVED", "PUBLISHED", "Editor"),
        ("APPROVED", "DRAFT", "Admin"),
        ("REJECTED", "DRAFT", "Creator"),
        ("PUBLISHED", "ARCHIVED", "Admin"),
        ("PUBLISHED", "DRAFT", "Admin"),
        ("ARCHIVED", "DRAFT", "Admin"),
    ),
    "knowledge_object": (
        ("EXTRACTED", "REVIEW_REQUIRED", "System"),
        ("EXTRACTED", "VERIFIED", "System"),
        ("EXTRACTED", "REJECTED", "System"),
        ("REVIEW_REQUIRED", "VERIFIED", "Reviewer"),
        ("REVIEW_REQUIRED", "REJECTED", "Reviewer"),
        ("VERIFIED", "PUBLISHED", "Editor"),
        ("VERIFIED", "FLAGGED", "System/Reviewer"),
        ("FLAGGED", "VERIFIED", "Reviewer"),
        ("FLAGGED", "REJECTED", "Admin"),
        ("PUBLISHED", "FLAGGED", "System"),
    ),
    "article": (
        ("GENERATING", "DRAFT", "System"),
        ("DRAFT", "REVIEW", "Editor"),
        ("REVIEW", "PUBLISHED", "Reviewer"),
        ("REVIEW", "DRAFT", "Reviewer"),
        ("PUBLISHED", "ARCHIVED", "Editor"),
        ("ARCHIVED", "DRAFT", "Editor"),
    ),
}


def transitions(spark: SparkSession, lenient: bool = False) -> DataFrame:
    """Allowed moves (current, new) of a video; lenient: to manual review from anywhere too."""
    moves = {(a, b) for a, to in MOVES.items() for b in to}
    if lenient:
        moves |= {(a, "MANUAL_REVIEW_REQUIRED") for a in STATES}
    return spark.createDataFrame(sorted(moves), "current string, new string")


def editorial(spark: SparkSession) -> DataFrame:
    """(kind, current, new, role) of the editorial machines."""
    return spark.createDataFrame([(kind, *move) for kind, moves in EDITORIAL.items() for move in moves], "kind string, current string, new string, role string")


def check_moves(requests: DataFrame, lenient: bool = False, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Requests (current, new, retries) with ``ok`` and ``reason`` (null, invalid or retries).

    A video without a state is SUBMITTED. A move to a failure is refused once
    the video has as many retries as allowed; the lenient rules have no ceiling.
    """
    allowed = transitions(requests.sparkSession, lenient).select(F.col("current").alias("_from"), F.col("new").alias("_to"), F.lit(True).alias("_ok"))
    at = F.coalesce("current", F.lit("SUBMITTED"))
    marked = requests.join(F.broadcast(allowed), (at == F.col("_from")) & (F.col("new") == F.col("_to")), "left")
    reason = F.when(F.col("_ok").isNull(), "invalid")
    if not lenient:
        reason = reason.when(F.startswith("new", F.lit("FAILED_")) & (F.coalesce("retries", F.lit(0)) >= max_retries), "retries")
    return marked.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull()).drop("_from", "_to", "_ok")


def apply_moves(checked: DataFrame, at: str) -> DataFrame:
    """What granted moves change: state, retry count, first start and completion, with the time column ``at``.

    Rows: started, completed and retries as they are before the move.
    """
    new = F.col("new")
    going = ~new.isin("SUBMITTED", "QUEUED")
    return checked.filter("ok").withColumns(
        {
            "state": new,
            "retries": F.coalesce("retries", F.lit(0)) + F.startswith(new, F.lit("FAILED_")).cast("int"),
            "started": F.coalesce("started", F.when(going, F.col(at))),
            "completed": F.when(new.isin("COMPLETED", "PUBLISHED"), F.col(at)).otherwise(F.col("completed")),
        }
    )


def run_moves(requests: DataFrame, key: str, *order: str, max_retries: int = MAX_RETRIES, blocks: int | None = None) -> DataFrame:
    """Requests (key, order, new) run one after another for each key, from SUBMITTED on: all columns, state, retries and ok after each.

    A refused request changes nothing. The columns of ``order`` come first and
    decide; the last one is unique. A key's requests are run in blocks, as many
    as its share of all needs.
    """
    return run_blocks(requests, key, list(order), MOVES, max_retries, "SUBMITTED", blocks)


def check_editorial(requests: DataFrame) -> DataFrame:
    """Requests (kind, current, new, role) with ``ok``: the move is in the machine of its kind and the role may make it; administrators may make any that exists."""
    allowed = editorial(requests.sparkSession).select(F.col("kind").alias("_kind"), F.col("current").alias("_from"), F.col("new").alias("_to"), F.split("role", "/").alias("_roles"))
    same = (F.col("kind") == F.col("_kind")) & (F.col("current") == F.col("_from")) & (F.col("new") == F.col("_to"))
    held = F.col("_roles").isNotNull() & F.coalesce(F.array_contains("_roles", F.col("role")) | (F.col("role") == "Admin"), F.lit(False))
    return requests.join(F.broadcast(allowed), same, "left").withColumn("ok", held).drop("_kind", "_from", "_to", "_roles")


#: What is done with a video in a state.
DISPATCH = {
    "QUEUED": "metadata_extraction",
    "METADATA_EXTRACTED": "transcript_extraction",
    "TRANSCRIPT_READY": "canonicalization",
    "CANONICALIZED": "knowledge_extraction",
    "KNOWLEDGE_READY": "graph_sync",
    "GRAPH_READY": "article_generation",
}
#: The failure of a stage.
FAILURES = {
    "METADATA_EXTRACTING": "FAILED_METADATA",
    "TRANSCRIPT_EXTRACTING": "FAILED_TRANSCRIPT",
    "CANONICALIZING": "FAILED_LLM",
    "KNOWLEDGE_EXTRACTING": "FAILED_LLM",
    "GRAPH_SYNCING": "FAILED_GRAPH",
    "ARTICLES_GENERATING": "FAILED_ARTICLE",
}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def dispatch(state: Column, priority: Column) -> Column:
    """The stage that runs next; ``skip`` for videos to leave out, null where no stage begins."""
    return F.when(priority == "SKIP", "skip").otherwise(_lookup(state, DISPATCH))


def skip_outcome(state: Column) -> Column:
    """What becomes of a video to leave out: completed where that move exists, else back in the queue, as after any invalid move."""
    closing = [a for a, to in MOVES.items() if "COMPLETED" in to]
    return F.when(state.isin(*closing), "COMPLETED").otherwise("QUEUED")


def error_state(state: Column) -> Column:
    return F.coalesce(_lookup(state, FAILURES), F.lit("FAILED_REVIEW"))


#: Errors by whether a retry can help.
RETRYABLE = ("RateLimitError", "TimeoutError", "ServiceUnavailable", "NetworkError", "InternalServerError")
NOT_RETRYABLE = ("InvalidRequestError", "AuthenticationError", "AuthorizationError", "ContentFilterError", "SchemaValidationError")


def retry_decision(error: Column, retries: Column, most: int = 5) -> Column:
    """RETRY, DEAD_LETTER (can't be retried, or tried too often), or UNKNOWN."""
    return (
        F.when(error.isin(*NOT_RETRYABLE), "DEAD_LETTER")
        .when(error.isin(*RETRYABLE), F.when(retries >= most, "DEAD_LETTER").otherwise("RETRY"))
        .otherwise("UNKNOWN")
    )


def step_outcome(success: Column, attempt: Column, most: Column) -> tuple[Column, Column]:
    """(step, run) after a step's try: a failed step is pending again until its last attempt, which fails the run."""
    step = F.when(success, "COMPLETED").when(attempt < most, "PENDING").otherwise("FAILED")
    return step, F.when(step == "FAILED", "FAILED").otherwise("RUNNING")


#: What a discovered source of a kind leads to, and how many videos of a channel.
SOURCES = {"youtube_video": "crawl_video", "youtube_channel": "crawl_channel"}
CHANNEL_VIDEOS = 50


def source_route(kind: Column) -> Column:
    """The crawl that a source asks for; null for unknown kinds, which are logged and dropped."""
    return _lookup(kind, SOURCES)


#: Subscribers under which a channel has low priority.
SMALL_CHANNEL = 10_000


def inherit_priority(own: Column, known: Column, default: Column, subscribers: Column) -> Column:
    """A video's own priority, or its channel's: low where the channel is small or of unknown size, else its default; medium where there is none."""
    channel = F.when(known, F.when(F.coalesce(subscribers, F.lit(0)) < SMALL_CHANNEL, "LOW").otherwise(default))
    return F.coalesce(own, channel, F.lit("MEDIUM"))


#: Decisions of editors and the status that each sets.
DECISIONS = {
    "review": {"request": "requested", "start": "in_review", "approve": "approved", "reject": "rejected"},
    "approval": {"request": "pending", "approve": "approved", "reject": "rejected"},
    "publication": {"create": "draft", "publish": "published", "unpublish": "unpublished"},
    "moderation": {"flag": "flagged", "resolve": "resolved", "reopen": "flagged"},
}


def latest_status(decisions: DataFrame, key: str, at: str) -> DataFrame:
    """(kind, action, by ``key`` and time) -> the status that the last known decision of each kind has set."""
    table = F.create_map(*[F.lit(x) for kind, to in DECISIONS.items() for a, b in to.items() for x in (f"{kind}/{a}", b)])
    known = decisions.withColumn("status", F.try_element_at(table, F.concat_ws("/", "kind", "action"))).filter("status is not null")
    return known.groupBy(key, "kind").agg(F.max_by("status", at).alias("status"), F.max(at).alias(at))


def next_step(success: Column, attempt: Column, most: int = 5) -> tuple[Column, Column]:
    """(status, attempts) after a try: done, pending again, or dead at the limit."""
    tries = F.when(success, attempt).otherwise(attempt + 1)
    return F.when(success, "PUBLISHED").when(tries >= most, "DEAD_LETTER").otherwise("PENDING"), tries


def topic(kind: Column, routes: dict[str, str], other: str) -> Column:
    """Topic by the event type's prefix."""
    out = F.lit(other)
    for prefix, name in routes.items():
        out = F.when(F.startswith(kind, F.lit(prefix)), name).otherwise(out)
    return out


#: Topics by the prefix of an event's type; all others go to the first.
EVENT_TOPICS: dict[str, tuple[str, ...]] = {
    "content.evt": ("Story", "Source", "Transcript", "Article"),
    "knowledge.evt": ("Knowledge",),
    "workflow.evt": ("Review", "Publication"),
    "research.evt": ("Collection", "Annotation", "Export"),
    "identity.evt": ("User", "Role", "Tenant"),
}


def event_topic(kind: Column) -> Column:
    """The topic of a domain event; types of no known prefix, null ones too, are content."""
    routes = {prefix: name for name, prefixes in EVENT_TOPICS.items() for prefix in prefixes}
    return topic(kind, routes, "content.evt")


def model_chain(length: Column) -> Column:
    return F.when(length < 100_000, F.array(F.lit("small"), F.lit("large"))).when(length < 800_000, F.array(F.lit("large"), F.lit("long"))).otherwise(F.array(F.lit("long")))


def first_success(attempts: DataFrame, key: str, order: str, result: str) -> DataFrame:
    """The first attempt in order that has a result."""
    return attempts.filter(F.col(result).isNotNull()).groupBy(key).agg(F.min_by(result, order).alias(result), F.min(order).alias(order))


#: Steps of a pipeline run; which a priority leaves out.
STEPS = ("ingest", "extract", "normalize", "canonicalize", "validate", "article")


def expand_runs(runs: DataFrame, kind: str, priority: str) -> DataFrame:
    """The ordered steps of each run: one for ingestion alone, none beyond what its priority asks for."""
    each = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("name")) for i, n in enumerate(STEPS)])
    p = F.coalesce(F.col(priority), F.lit("MEDIUM"))
    last = F.when(F.col(kind) == "ingestion_only", 0).when(p == "SKIP", -1).when(p == "LOW", 2).when(p == "MEDIUM", 4).otherwise(5)
    return runs.withColumn("_last", last).select("*", F.inline(each)).filter("step <= _last").drop("_last")


def tier(important: Column, manual: Column, automatic: Column, cloud: Column | None = None) -> tuple[Column, Column]:
    """(tier, score) of a transcript: review for important channels, manual, automatic, cloud; error, without a score, where there is none (``cloud`` false)."""
    cloud = F.lit(True) if cloud is None else F.coalesce(cloud, F.lit(False))
    kind = F.when(important, "review").when(manual, "manual").when(automatic.isNotNull(), "automatic").when(cloud, "cloud").otherwise("error")
    return kind, F.when(important, F.lit(1.0)).when(manual, 0.95).when(automatic.isNotNull(), automatic).when(cloud, 0.9)
