"""Rule-based validation of nested knowledge documents, and quality scores.

A knowledge document has arrays entities, claims, themes, motifs, beliefs,
rituals and contradictions. Missing arrays count as empty; a missing and a null
field are both missing. Confidences run from 0 to 100 here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.scalars import clamp, round_even
from skein.functions.text import citations, function_words, sentence_ends, word_count

#: Required fields by object.
REQUIRED = {
    "entity": ("entityId", "name", "entityType", "confidence"),
    "claim": ("claimId", "statement", "confidence", "evidence"),
    "theme": ("themeId", "name", "confidence"),
}
#: Least confidence -> least number of evidence segments.
EVIDENCE_STEPS = ((0, 0), (20, 1), (40, 1), (60, 2), (80, 3))
#: Kinds of entities and of claims; kinds of entities that belong to a region.
ENTITY_TYPES = ("spirit", "deity", "creature", "person", "location", "object", "phenomenon", "concept", "group", "other")
CATEGORIES = ("existence", "behavior", "appearance", "location", "history", "origin", "power", "relationship", "ritual", "belief")
REGIONAL = ("spirit", "deity", "creature")
#: How many issues and warnings a result lists.
ISSUES, WARNINGS = 10, 20

EVIDENCE = "array<struct<text:string,speaker:string>>"
KNOWLEDGE = (
    "knowledgeId string, "
    f"entities array<struct<entityId:string,name:string,normalizedName:string,entityType:string,confidence:int,region:string,evidence:{EVIDENCE}>>, "
    f"claims array<struct<claimId:string,statement:string,category:string,confidence:int,entityIds:array<string>,evidence:{EVIDENCE}>>, "
    "themes array<struct<themeId:string,name:string,confidence:int>>, motifs array<struct<name:string>>, beliefs array<struct<name:string>>, rituals array<struct<name:string>>, "
    f"contradictions array<struct<contradictionId:string,sides:array<struct<label:string,evidence:{EVIDENCE}>>>>"
)
FINDINGS = "array<struct<type:string,target:string,targetId:string,message:string,severity:string>>"


def arr(name: str) -> Column:
    """The array column, never null."""
    return F.coalesce(F.col(name), F.expr("array()"))


def count(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def required_evidence(confidence: Column) -> Column:
    out = F.lit(0)
    for bound, n in EVIDENCE_STEPS:
        out = F.when(confidence >= bound, n).otherwise(out)
    return out


def _finding(kind: str, target: str, id_: Column | str, message: Column, severity: Column | str) -> Column:
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(
        F.lit(kind).alias("type"), F.lit(target).alias("target"), F.coalesce(as_col(id_), F.lit("unknown")).alias("targetId"),
        message.alias("message"), as_col(severity).alias("severity"),
    )


def _each(name: str, *make) -> Column:
    """The findings about each element, element by element; a maker gives a finding or null."""
    return F.flatten(F.transform(arr(name), lambda x: F.array_compact(F.array(*[m(x) for m in make])))).cast(FINDINGS)


def _missing(target: str, severity: str):
    fields = REQUIRED[target]

    def make(x: Column) -> Column:
        names = F.array_compact(F.array(*[F.when(x[f].isNull(), f) for f in fields]))
        message = F.concat(F.lit(f"{target.capitalize()} missing required fields: "), F.array_join(names, ", "))
        return F.when(F.size(names) > 0, _finding("missing_field", target, x[fields[0]], message, severity))

    return make


def schema_issues() -> Column:
    """Stage one, the only one that makes issues: one for an incomplete object, one for an unknown kind."""

    def unknown_type(x: Column) -> Column:
        kind = x["entityType"]
        message = F.concat(F.lit("Invalid entity type '"), kind, F.lit(f"'. Must be one of: {', '.join(ENTITY_TYPES)}"))
        return F.when((kind != "") & ~kind.isin(*ENTITY_TYPES), _finding("invalid_entity_type", "entity", x["entityId"], message, "medium"))

    def unknown_category(x: Column) -> Column:
        kind = x["category"]
        return F.when((kind != "") & ~kind.isin(*CATEGORIES), _finding("invalid_category", "claim", x["claimId"], F.concat(F.lit("Invalid claim category '"), kind, F.lit("'")), "low"))

    return F.concat(_each("entities", _missing("entity", "high"), unknown_type), _each("claims", _missing("claim", "high"), unknown_category), _each("themes", _missing("theme", "medium")))


def _confidence(x: Column) -> Column:
    return F.coalesce(x["confidence"], F.lit(0))


def evidence_warnings() -> Column:
    def few(x: Column) -> Column:
        need, n = required_evidence(_confidence(x)), count(x["evidence"])
        message = F.concat(F.lit("Claim has "), n.cast("string"), F.lit(" evidence segments, expected at least "), need.cast("string"), F.lit(" for confidence "), _confidence(x).cast("string"))
        return F.when(n < need, _finding("insufficient_evidence", "claim", x["claimId"], message, F.when(need > 1, "medium").otherwise("low")))

    def bare(x: Column) -> Column:
        message = F.concat(F.lit("Entity '"), F.coalesce(x["name"], F.lit("unknown")), F.lit("' has no evidence"))
        return F.when(count(x["evidence"]) == 0, _finding("missing_evidence", "entity", x["entityId"], message, "medium"))

    return F.concat(_each("claims", few), _each("entities", bare))


def calibration_warnings() -> Column:
    def high(x: Column) -> Column:
        c, n = _confidence(x), count(x["evidence"])
        message = F.concat(F.lit("Confidence "), c.cast("string"), F.lit(" is high but only "), n.cast("string"), F.lit(" evidence(s) provided"))
        return F.when((c >= 80) & (n < 2), _finding("confidence_mismatch", "claim", x["claimId"], message, "medium"))

    def low(x: Column) -> Column:
        c = _confidence(x)
        message = F.concat(F.lit("Claim has low confidence ("), c.cast("string"), F.lit(") and no evidence"))
        return F.when((c < 20) & (count(x["evidence"]) == 0), _finding("low_confidence_no_evidence", "claim", x["claimId"], message, "low"))

    def sure(x: Column) -> Column:
        c = _confidence(x)
        message = F.concat(F.lit("Entity confidence "), c.cast("string"), F.lit(" with zero evidence"))
        return F.when((c >= 90) & (count(x["evidence"]) == 0), _finding("confidence_mismatch", "entity", x["entityId"], message, "high"))

    return F.concat(_each("claims", high, low), _each("entities", sure))


def consistency_warnings() -> Column:
    """References to unknown entities, one for each reference; names that several entities have."""
    known = F.filter(F.transform(arr("entities"), lambda e: e["entityId"]), lambda i: i != "")

    def orphan(claim: Column) -> Column:
        lost = F.filter(F.coalesce(claim["entityIds"], F.array().cast("array<string>")), lambda i: ~F.coalesce(F.array_contains(known, i), F.lit(False)))
        return F.transform(lost, lambda i: _finding("orphaned_entity_reference", "claim", claim["claimId"], F.concat(F.lit("Claim references entity "), F.coalesce(i, F.lit("None")), F.lit(" which is not in entities list")), "medium"))

    names = F.transform(arr("entities"), lambda e: F.lower(F.coalesce(e["normalizedName"], e["name"], F.lit(""))))
    times = lambda n: F.size(F.filter(names, lambda m: m == n))
    twice = F.filter(F.array_distinct(names), lambda n: times(n) > 1)
    repeated = F.transform(twice, lambda n: _finding("possible_duplicate", "entity", "multiple", F.concat(F.lit("Entity name '"), n, F.lit("' appears "), times(n).cast("string"), F.lit(" times, may need normalization merge")), "low"))
    return F.concat(F.flatten(F.transform(arr("claims"), orphan)).cast(FINDINGS), repeated.cast(FINDINGS))


def contradiction_warnings() -> Column:
    def review(x: Column) -> Column:
        sides = F.coalesce(x["sides"], F.array().cast(f"array<struct<label:string,evidence:{EVIDENCE}>>"))
        message = F.concat(F.lit("Contradiction has only "), F.size(sides).cast("string"), F.lit(" side(s), expected at least 2"))
        few = F.array_compact(F.array(F.when(F.size(sides) < 2, _finding("incomplete_contradiction", "contradiction", x["contradictionId"], message, "high")))).cast(FINDINGS)
        bare = F.filter(sides, lambda y: count(y["evidence"]) == 0)
        return F.concat(few, F.transform(bare, lambda y: _finding("missing_evidence", "contradiction", x["contradictionId"], F.concat(F.lit("Contradiction side '"), F.coalesce(y["label"], F.lit("unknown")), F.lit("' has no evidence")), "medium")).cast(FINDINGS))

    return F.flatten(F.transform(arr("contradictions"), review)).cast(FINDINGS)


def gap_warnings() -> Column:
    """Research gaps; they are warnings like the others."""

    def no_region(x: Column) -> Column:
        message = F.concat(F.lit("Entity '"), F.coalesce(x["name"], F.lit("unknown")), F.lit("' missing cultural context (region)"))
        return F.when(x["entityType"].isin(*REGIONAL) & (F.coalesce(x["region"], F.lit("")) == ""), _finding("research_gap", "entity", x["entityId"], message, "medium"))

    speakers = F.flatten(F.transform(arr("claims"), lambda x: F.transform(F.coalesce(x["evidence"], F.array().cast(EVIDENCE)), lambda v: v["speaker"])))
    seen = F.size(F.array_distinct(F.filter(speakers, lambda v: v != "")))
    overall = lambda message, severity: _finding("research_gap", "story", "overall", message, severity)
    story = F.array_compact(
        F.array(
            F.when((F.size(arr("themes")) == 0) & (F.size(arr("entities")) > 0), overall(F.lit("No themes extracted despite having entities"), "low")),
            F.when((F.size(arr("beliefs")) > 0) & (F.size(arr("rituals")) == 0), overall(F.lit("Beliefs present but no associated rituals extracted"), "low")),
            F.when((F.size(arr("claims")) > 0) & (seen <= 1), overall(F.concat(F.lit("Only "), seen.cast("string"), F.lit(" speaker(s) identified; corroboration recommended")), "medium")),
        )
    )
    return F.concat(_each("entities", no_region), story.cast(FINDINGS))


def validate(docs: DataFrame) -> DataFrame:
    """Scores, issues and warnings of knowledge documents.

    Issues are what the schema stage finds, whatever its severity; what every
    later stage finds is a warning, gaps included. Scores count them all; the
    lists keep the first 10 and 20. A missing confidence counts as 0. Scores are
    rounded half to even on the binary value.
    """
    df = docs.withColumns({"all_issues": schema_issues(), "all_evidence": evidence_warnings()})
    df = df.withColumn("all_warnings", F.concat("all_evidence", calibration_warnings(), consistency_warnings(), contradiction_warnings(), gap_warnings()))
    has = lambda n: F.when(F.size(arr(n)) > 0, 1.0).otherwise(0.0)
    conf = F.transform(F.concat(F.transform(arr("claims"), _confidence), F.transform(arr("entities"), _confidence)), lambda c: c / 100.0)
    mean = F.when(F.size(conf) > 0, F.aggregate(conf, F.lit(0.0), lambda s, x: s + x) / F.size(conf)).otherwise(0.0)
    df = df.withColumns(
        {
            "n_issues": F.size("all_issues"), "n_warnings": F.size("all_warnings"), "n_evidence": F.size("all_evidence"),
            "_complete": 0.3 * has("entities") + 0.3 * has("claims") + 0.2 * has("themes") + 0.2 * has("motifs"), "_confidence": mean,
        }
    )
    consistency, compliance = clamp(1.0 - F.col("n_warnings") * 0.05), clamp(1.0 - F.col("n_issues") * 0.1)
    overall = clamp(F.col("_complete") * 0.25 + F.col("_confidence") * 0.25 + consistency * 0.2 + compliance * 0.2 + (1.0 - F.col("n_evidence") * 0.05) * 0.1)
    df = df.withColumn("overall", round_even(overall, 4))
    return df.select(
        "knowledgeId", round_even(F.col("_complete"), 4).alias("completeness"), round_even(F.col("_confidence"), 4).alias("confidence"), round_even(consistency, 4).alias("consistency"),
        compliance.alias("schema_score"), "overall", (F.col("overall") >= 0.6).alias("passed"), (F.col("n_issues") == 0).alias("schema_valid"),
        "n_issues", "n_warnings", "n_evidence", F.slice("all_issues", 1, ISSUES).alias("issues"), F.slice("all_warnings", 1, WARNINGS).alias("warnings"),
        F.transform(F.concat("all_issues", "all_warnings"), lambda f: F.struct(f["type"].alias("type"), f["target"].alias("target"), f["severity"].alias("severity"))).alias("kinds"),
    )


#: Words of a full article, citations of a full score, score from which a review can begin.
BODY_WORDS, CITATIONS, REVIEW_AT = 150, 3, 0.5


def article_metrics(text: Column) -> dict[str, Column]:
    """Length, language and citation terms of an article, its quality, risk and confidence (from the unrounded quality)."""
    length = F.least(word_count(text) / float(BODY_WORDS), F.lit(1.0))
    language = F.greatest(F.lit(0.0), 1.0 - function_words(text) / sentence_ends(text))
    cited = F.least(citations(text) / float(CITATIONS), F.lit(1.0))
    q = length * 0.4 + language * 0.3 + cited * 0.3
    risk = F.greatest(F.lit(0.0), 1.0 - (cited * 0.5 + length * 0.3 + language * 0.2))
    return {
        "quality": round_even(q, 2), "risk": round_even(risk, 2), "confidence": F.least(q + 0.2, F.lit(1.0)),
        "words": word_count(text), "citations": citations(text).cast("long"),
    }


def review_status(quality: Column) -> Column:
    return F.when(quality > REVIEW_AT, "pending_review").otherwise("needs_revision")


#: Least score of a document that goes on to the graph.
GATE = 0.7


def quality_gate(scored: DataFrame, score: str, ready: str) -> DataFrame:
    """Add ``route`` (graph or review) and, for those held back, the dead-letter record ``dead``: reason and score.

    An unknown score counts as 0, an unknown readiness as not ready.
    """
    value, good = F.coalesce(F.col(score), F.lit(0.0)), F.coalesce(F.col(ready), F.lit(False))
    passed = (value >= GATE) & good
    reason = F.when(value < GATE, "quality_below_threshold").otherwise("not_ready_for_graph")
    dead = F.struct(reason.alias("reason"), value.alias("score"), F.lit("NEEDS_REVIEW").alias("status"))
    return scored.withColumn("route", F.when(passed, "graph").otherwise("review")).withColumn("dead", F.when(~passed, dead))


def knowledge_state(confidence: Column) -> Column:
    """Above 0.9 verified, above 0.7 for review, under 0.5 rejected, else as extracted."""
    return F.when(confidence > 0.9, "VERIFIED").when(confidence > 0.7, "REVIEW_REQUIRED").when(confidence < 0.5, "REJECTED").otherwise("EXTRACTED")


#: Fixed values: (metric, weight, whether less is better, gate) of a prompt version.
PROMPT_METRICS = (
    ("accuracy", 0.40, False, 0.85), ("completeness", 0.20, False, 0.90), ("hallucination_rate", 0.20, True, 0.05),
    ("consistency", 0.10, True, 0.10), ("cost_efficiency", 0.05, False, 0.80), ("latency_regression", 0.05, True, None),
)
LATENCY_SECONDS = 30


def prompt_quality(runs: DataFrame) -> DataFrame:
    """Add ``quality_score`` and ``deployable`` (every gate holds) to rows with the prompt metrics and latency_p95; an unknown metric holds no gate."""
    score, gates = F.lit(0.0), F.coalesce(F.col("latency_p95") <= LATENCY_SECONDS, F.lit(False))
    for name, weight, less, gate in PROMPT_METRICS:
        value = F.col(name)
        score = score + (1.0 - value if less else value) * weight
        if gate is not None:
            gates = gates & F.coalesce(value <= gate if less else value >= gate, F.lit(False))
    return runs.withColumns({"quality_score": score, "deployable": gates})


def rollback_triggers(now: DataFrame) -> DataFrame:
    """Rows (quality, quality_before, hallucination_1h, tokens, tokens_before) -> the triggers that fire, and the action.

    Fixed values: quality down by over 5 %, hallucinations in over 10 % of an
    hour's calls (both automatic), tokens up by over 50 % (by an operator).
    """
    fired = F.array_compact(
        F.array(
            F.when(F.col("quality") < 0.95 * F.col("quality_before"), "quality_drop"),
            F.when(F.col("hallucination_1h") > 0.10, "hallucination_rate"),
            F.when(F.col("tokens") > 1.5 * F.col("tokens_before"), "token_usage"),
        )
    )
    automatic = F.array_contains("triggers", "quality_drop") | F.array_contains("triggers", "hallucination_rate")
    return now.withColumn("triggers", fired).withColumn("action", F.when(automatic, "automatic").when(F.size("triggers") > 0, "operator").otherwise("none"))


def article_score(text: Column, names: Column) -> Column:
    """1, less 0.3 under 500 characters, less 0.2 where no entity is named; empty is 0."""
    named = F.exists(names, lambda n: F.contains(F.lower(text), F.lower(n)))
    score = 1.0 - F.when(F.length(text) < 500, 0.3).otherwise(0.0) - F.when((F.size(names) > 0) & ~named, 0.2).otherwise(0.0)
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(F.round(F.greatest(score, F.lit(0.0)), 2))


def article_issues(text: Column, names: Column) -> Column:
    """What ``article_score`` takes off for, as a list."""
    named = F.exists(names, lambda n: F.contains(F.lower(text), F.lower(n)))
    return F.array_compact(F.array(
        F.when(F.length(F.coalesce(text, F.lit(""))) < 500, "Content too short"),
        F.when((F.size(names) > 0) & ~F.coalesce(named, F.lit(False)), "No canonical entities mentioned in article"),
        F.when(F.coalesce(text, F.lit("")) == "", "Empty article content"),
    ))


#: Automatic captions below this quality go to manual review.
CAPTION_REVIEW = 0.5


def caption_review(quality: Column) -> Column:
    """Whether captions must be looked at; null where they have no quality."""
    return quality < CAPTION_REVIEW


#: Labels of confidence by who gives it, from the lowest band on; a band ends at 20, 40, 60 and 80, included.
CONFIDENCE_LABELS = {
    "extraction": ("Speculative", "Low", "Moderate", "High", "Very High"),
    "validation": ("Rejected", "Poor", "Fair", "Good", "Excellent"),
    "editorial": ("Rejected", "Needs Major Revision", "Needs Minor Revision", "Approved with Notes", "Approved"),
}


def confidence_label(confidence: Column, kind: str) -> Column:
    low, *higher = CONFIDENCE_LABELS[kind]
    out = F.when(confidence <= 20, low)
    for bound, label in zip((40, 60, 80), higher, strict=False):
        out = out.when(confidence <= bound, label)
    return out.when(confidence.isNotNull(), higher[-1])


def composite_confidence(extraction: Column, validation: Column, editorial: Column) -> Column:
    """The three weighed .30, .40 and .30; without an editor's, .40 and .60."""
    return F.when(editorial.isNull(), 0.4 * extraction + 0.6 * validation).otherwise(0.3 * extraction + 0.4 * validation + 0.3 * editorial)


def submissible(evidence: Column, entities: Column, reviewer: Column, creator: Column) -> Column:
    """Whether a story may be submitted: it has evidence and an entity, and its reviewer is known and not its creator."""
    return F.coalesce((evidence >= 1) & (entities >= 1) & (reviewer != creator), F.lit(False))


def caption_quality(music: Column, segments: Column, words: Column, distinct: Column) -> Column:
    """Quality of automatic captions; null without words."""
    q = 0.75 - F.when(music, 0.15).otherwise(0.0) - F.when(words / segments < 3, 0.1).otherwise(0.0) - F.when(distinct / words < 0.5, 0.2).otherwise(0.0)
    return F.when(words > 0, F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), q)), 4))


def regressions(cases: DataFrame, drop: float = 0.05) -> DataFrame:
    """Golden cases (case_id, old, new, floor, and hallucination with its ceiling where they have them): whether the new version passes, and fell by more than ``drop``."""
    passed = F.col("new") >= F.col("floor")
    if "hallucination" in cases.columns:
        passed = passed & (F.col("hallucination") <= F.col("ceiling"))
    return cases.withColumns({"passed": passed, "regressed": F.round(F.col("old") - F.col("new"), 9) > drop})
