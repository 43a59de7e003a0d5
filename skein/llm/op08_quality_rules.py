"""Quality rules: weak supervision over voting rules, all in DataFrame operations.

Each rule votes good (+1), bad (-1) or abstains (0). Votes are summarised as a
table of vote patterns (at most 3**rules rows), on which expectation-maximisation
estimates, for either class, how often each rule votes each way. The posterior
probability of the good class, a closed expression of the votes, replaces
"every rule must pass".
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import SPACE, SPACE_RE, cut, packed, quoted, table

SYMBOLS = "#*$%&|<>"
#: (rule, good when, bad when): between the two the rule abstains.
RULES: tuple[tuple[str, str, str], ...] = (
    ("length", "n_words >= 100", "n_words < 50"),
    ("word_length", "word_chars BETWEEN 3 * n_words AND 8 * n_words", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    ("symbols", "100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    ("symbol_words", "50 * n_symbol_words <= n_words", "5 * n_symbol_words > n_words"),
    ("duplicate_lines", "n_dup_lines = 0", "2 * n_dup_lines > n_lines"),
    ("repeated_windows", "100 * n_repeat_words <= 10 * n_words", "100 * n_repeat_words > 30 * n_words"),
    ("capitals", "10 * n_upper <= word_chars", "2 * n_upper > word_chars"),
    ("exclamations", "50 * n_exclaim <= n_words", "5 * n_exclaim > n_words"),
    ("digits", "20 * n_digits <= word_chars", "4 * n_digits > word_chars"),
)
#: Start of the estimation: share of good texts; P(bad, none, good vote | good text); the same for bad texts.
#: Most rules look at one kind of fault each, so a bad text still gets good votes.
PRIOR = 0.8
START = {1: (0.02, 0.13, 0.85), 0: (0.35, 0.15, 0.5)}
ROUNDS = 12
THRESHOLD = 0.5


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


#: Of a sorted array _seen, the places of the entries that {same} finds equal to the one before or after.
_REPEATED = (
    "transform(filter(sequence(0, greatest(size({seen}) - 1, 0)), j -> size({seen}) > 0 AND ("
    "(j > 0 AND {same_before}) OR (j < size({seen}) - 1 AND {same_after}))), j -> {place})"
)


def measures(docs: DataFrame, text: str = "text", spare_bits: int = 0) -> DataFrame:
    """Add the counts that the rules look at; all whole texts, null counts as empty.

    A word is a run of anything but ASCII white space; n_repeat_words counts the
    words inside three-word windows that occur at least twice in the text.
    Windows are compared by full 64-bit hashes, without a row for each window:
    longs of a hash's low bits and the place are sorted, which is exact unless
    two different hashes share those bits. That is counted, and such a text (the
    more likely the longer; ``spare_bits`` provokes it) sorts whole hashes.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_body", body)
    df = df.withColumn("_words", F.array_remove(F.split(F.col("_body"), SPACE_RE), ""))
    df = df.withColumn("_n", F.size("_words"))
    # the number of low bits that hold a place
    df = df.withColumn("_bits", F.least(F.lit(62), F.length(F.bin(F.col("_n").cast("long"))) + spare_bits))
    hashed = F.expr("CASE WHEN _n < 4 THEN array() ELSE transform(sequence(0, _n - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) END")
    df = df.withColumn("_hashes", hashed.cast("array<bigint>"))
    df = df.withColumn("_clash", F.expr("size(array_distinct(_hashes)) <> size(array_distinct(transform(_hashes, h -> shiftleft(h, _bits))))"))
    df = df.withColumn("_seen", F.expr("CASE WHEN _clash THEN array() ELSE sort_array(transform(_hashes, (h, i) -> shiftleft(h, _bits) + i)) END").cast("array<bigint>"))
    dense = _REPEATED.format(
        seen="_seen", place="CAST(_seen[j] & (shiftleft(1L, _bits) - 1) AS INT)", same_before="shiftright(_seen[j], _bits) = shiftright(_seen[j - 1], _bits)",
        same_after="shiftright(_seen[j], _bits) = shiftright(_seen[j + 1], _bits)",
    )
    whole = _REPEATED.format(seen="s", place="s[j].at", same_before="s[j].h = s[j - 1].h", same_after="s[j].h = s[j + 1].h")
    whole = f"transform(array(sort_array(transform(_hashes, (h, i) -> struct(h AS h, i AS at)))), s -> {whole})[0]"
    repeats = F.expr(f"sort_array(CASE WHEN _clash THEN {whole} ELSE {dense} END)")
    df = df.withColumn("_at", repeats)
    covered = F.expr(
        "CASE WHEN size(_at) = 0 THEN 0L ELSE 3L + aggregate(sequence(1, size(_at)), 0L, "
        "(s, j) -> s + CASE WHEN j < size(_at) THEN least(3, _at[j] - _at[j - 1]) ELSE 0 END) END"
    )
    lines = F.filter(F.split(F.col("_body"), "\n"), lambda line: F.length(F.translate(line, SPACE, "")) > 0)
    df = df.withColumn("_lines", lines)
    return df.withColumns(
        {
            "n_words": F.col("_n").cast("long"),
            "word_chars": F.length(F.translate(F.col("_body"), SPACE, "")).cast("long"),
            "n_symbols": _without(F.col("_body"), SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": covered.cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_upper": F.length(F.regexp_replace("_body", r"[^\p{Lu}]+", "")).cast("long"),
            "n_symbol_words": F.coalesce(F.regexp_count("_body", F.lit(r"[#*$%&|<>](?=[\x20\x09-\x0D]|$)")), F.lit(0)).cast("long"),
            "n_exclaim": _without(F.col("_body"), "!").cast("long"),
            "n_digits": _without(F.col("_body"), "0123456789").cast("long"),
        }
    ).drop("_body", "_words", "_n", "_bits", "_hashes", "_clash", "_seen", "_at", "_lines")


def votes(df: DataFrame, rules=RULES) -> DataFrame:
    """Add ``votes``: an array with -1, 0 or 1 for each rule."""
    vote = [F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END") for _, good, bad in rules]
    return df.withColumn("votes", F.array(*vote))


def posterior(model: dict, n_rules: int) -> Column:
    """P(good | votes): the tables' log ratios, laid out rule by rule, summed over the votes."""
    weights = [math.log(model[i, 1, v] / model[i, 0, v]) for i in range(n_rules) for v in (-1, 0, 1)]
    start = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    table_ = F.array(*map(F.lit, weights))
    odds = F.aggregate(
        F.sequence(F.lit(0), F.lit(n_rules - 1)), start,
        lambda s, i: s + F.get(table_, F.lit(3) * i + F.get("votes", i) + F.lit(1)),
    )
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit(voted: DataFrame, n_rules: int = len(RULES), rounds: int = ROUNDS, tolerance: float = 1e-4) -> dict:
    """Estimate by expectation-maximisation how each rule votes in either class.

    ``voted`` shrinks to its table of vote patterns first (bounded by the number
    of rules, not by the rows), so a round is one aggregate over a few rows.
    An empty input gives the starting model.
    """
    patterns = cut(voted.groupBy("votes").agg(F.count("*").alias("rows")).coalesce(1), "patterns")
    model: dict = {"prior": PRIOR}
    for i in range(n_rules):
        model |= {(i, y, v): START[y][v + 1] for y in START for v in (-1, 0, 1)}
    for _ in range(rounds):
        expected = patterns.withColumn("p", posterior(model, n_rules)).select("rows", "p", F.posexplode("votes").alias("i", "v"))
        sums = expected.groupBy("i", "v").agg(F.sum(F.col("rows") * F.col("p")).alias("good"), F.sum(F.col("rows") * (1 - F.col("p"))).alias("bad"))
        seen = {(r["i"], r["v"]): (r["good"], r["bad"]) for r in sums.collect()}  # three rows a rule at most
        if not seen:
            break
        good, bad = (sum(x[k] for (i, _), x in seen.items() if i == 0) for k in (0, 1))
        new: dict = {"prior": min(0.999, max(0.001, good / (good + bad)))}
        for i in range(n_rules):
            for v in (-1, 0, 1):
                g, b = seen.get((i, v), (0.0, 0.0))
                # one pseudo-count for each vote keeps every probability above 0
                new[i, 1, v], new[i, 0, v] = (g + 1) / (good + 3), (b + 1) / (bad + 3)
        moved = max(abs(new[k] - model[k]) for k in model)
        model = new
        if moved < tolerance:
            break
    return model


def judge(measured: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Add votes, base_failed, posterior and kept to a table of measures."""
    voted = votes(measured, rules)
    model = fit(voted.select("votes"), len(rules))
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    scored = voted.withColumn("base_failed", failed).withColumn("posterior", posterior(model, len(rules)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep(docs: DataFrame, text: str = "text", rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns, whatever their names.

    Nulls and empty texts count no word and fail the base rules. Repeated rows
    are judged alike, one result each. An empty table gives an empty result.
    """
    named = docs.select(packed(docs).alias("_row"), F.col(quoted(text)).alias("text"))
    # stored with its measures: read once for the estimation, once for the verdict
    measured = cut(measures(named).drop("text"), "measured")
    return judge(measured, rules, threshold).filter("kept").select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = cut(measures(docs).drop("text"), "measures")
    return judge(measured).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", F.round("posterior", 6).alias("posterior"), "kept",
    )
