"""Typed extraction: phrases of a dictionary found in texts, model responses read leniently.

Seven kinds of extractors share a response schema each. A response is whatever a
model has written: the JSON object in it is looked for, what can be read is kept,
and what goes wrong is recorded by type, so one bad response costs its own items.
The offline model answers from a dictionary: its phrases are matched over words,
the leftmost first, the longest of those that start together, without overlaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import rescue_json
from skein.operators.joins import small_join

_NAMED = ("name string, confidence double, evidence string", ("name", "confidence", "evidence"))
#: The list's key in a response, its items' fields, and those that an item must have.
SCHEMAS: dict[str, tuple[str, tuple[str, ...]]] = {
    "themes": _NAMED,
    "motifs": _NAMED,
    "archetypes": _NAMED,
    "entities": ("name string, type string, aliases array<string>, description string, confidence double", ("name", "type", "confidence")),
    "claims": ("text string, claim_type string, confidence double, evidence string", ("text", "claim_type", "confidence")),
    "relationships": ("subject string, predicate string, object string, confidence double, evidence string", ("subject", "predicate", "object", "confidence")),
    "stories": ("title string, start_timestamp double, end_timestamp double, summary string, confidence double", ("title", "start_timestamp", "end_timestamp", "summary", "confidence")),
}


def tokens(text: Column) -> Column:
    """Lower-case words: runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def phrases(df: DataFrame, keys: list[str], text: str, terms: DataFrame) -> DataFrame:
    """(keys, place, start, words, phrase, term columns): where phrases of the dictionary (phrase, ...) stand in the texts.

    Of phrases that overlap the leftmost counts, of those that start together the
    longest; ``place`` numbers a text's hits from 1, ``start`` its words from 0.
    Words and phrases are compared in lower case, whatever stands between words.
    Runs of words of the dictionary's lengths meet it by equality, so a text
    costs its words times the number of lengths. Phrases that are equal then are
    one, the first by the other columns. Null texts and phrases match nothing.
    """
    named = terms.withColumn("_gram", F.array_join(tokens(F.col("phrase")), " ")).filter("_gram <> ''")
    rest = [c for c in terms.columns if c != "phrase"]
    named = named.groupBy("_gram").agg(F.min(F.struct("phrase", *rest)).alias("_t")).select("_gram", "_t.*")
    lengths = sorted(r[0] for r in named.select(F.size(F.split("_gram", " "))).distinct().collect())  # a few small numbers
    if not lengths:
        lengths = [1]

    def run(n: int) -> Column:
        starts = F.when(F.size("_w") >= n, F.sequence(F.lit(0), F.size("_w") - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(n).alias("words"), F.array_join(F.slice("_w", i + 1, F.lit(n)), " ").alias("_gram")))

    each = df.select(*keys, tokens(F.col(text)).alias("_w")).select(*keys, F.inline(F.concat(*[run(n) for n in lengths])))
    hits = small_join(each, named.select("_gram"), "_gram")
    found = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("words")).alias("_less"), "_gram"))).alias("_hits"))
    one = "struct<start:int,_less:int,_gram:string>"
    begin = F.struct(F.lit(0).alias("free"), F.array().cast(f"array<{one}>").alias("out"))
    # hits come by start, the longest first: one counts if it begins where the last has ended, or later
    step = lambda s, h: F.when(h["start"] >= s["free"], F.struct((h["start"] - h["_less"]).alias("free"), F.concat(s["out"], F.array(h)).alias("out"))).otherwise(s)
    kept = found.select(*keys, F.posexplode(F.aggregate("_hits", begin, step, lambda s: s["out"])).alias("_p", "_h"))
    flat = kept.select(*keys, (F.col("_p") + 1).alias("place"), F.col("_h.start").alias("start"), (-F.col("_h._less")).alias("words"), F.col("_h._gram").alias("_gram"))
    return small_join(flat, named, "_gram").drop("_gram")


def parse(response: Column, kind: str) -> dict[str, Column]:
    """``items`` (those with all that they must have), ``incomplete`` (how many have not) and ``error`` of a response.

    Errors: ``no_response`` (null), ``no_json`` (no object in it that can be read),
    ``not_a_list`` (the kind's key holds something else). An object without the
    key has no items, which is no error. Fields of another type are null.
    """
    fields, required = SCHEMAS[kind]
    held = F.try_parse_json(rescue_json(response))
    value = F.try_variant_get(held, f"$.{kind}", "variant")
    rows = F.try_variant_get(held, f"$.{kind}", "array<variant>")
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = [f.split(" ", 1)[1] for f in fields.split(", ")]

    def field(v: Column, name: str, kind: str) -> Column:
        got = F.try_variant_get(v, f"$.{name}", kind)
        if kind != "string":
            return got
        form = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))  # a list or an object is no text
        return F.when(~F.coalesce(F.startswith(form, F.lit("ARRAY")) | F.startswith(form, F.lit("OBJECT")), F.lit(False)), got)

    read = F.transform(rows, lambda v: F.struct(*[field(v, n, k).alias(n) for n, k in zip(names, kinds, strict=True)]))
    whole = lambda x: F.forall(F.array(*[x[r].isNotNull() for r in required]), lambda b: b)
    none = F.array().cast(f"array<struct<{', '.join(f'{n}: {k}' for n, k in zip(names, kinds, strict=True))}>>")
    every = F.coalesce(read, none)
    object_ = F.coalesce(F.startswith(F.schema_of_variant(held), F.lit("OBJECT")), F.lit(False))
    error = F.when(response.isNull(), "no_response").when(~object_, "no_json").when(value.isNotNull() & (F.schema_of_variant(value) != "VOID") & rows.isNull(), "not_a_list")
    items = F.filter(every, whole)
    return {"items": items, "incomplete": (F.size(every) - F.size(items)).cast("int"), "error": error}


def answers(df: DataFrame, keys: list[str], text: str, terms: DataFrame, kind: str) -> DataFrame:
    """(keys, response): what the offline model says about each text, as the kind's JSON; texts without hits get an empty list.

    terms: (phrase, name, type). Names that are hit again are the surer. A claim
    is a hit, a relationship two hits that follow each other and differ in name,
    a story goes from its hit to the next or the text's end (in words).
    """
    hits = phrases(df, keys, text, terms)
    sure = F.round(F.least(F.lit(1.0), 0.5 + 0.1 * F.size("_own")), 2)
    if kind in ("themes", "motifs", "archetypes", "entities"):
        own = hits.groupBy(*keys, "name", "type").agg(F.array_sort(F.collect_list(F.struct("start", "phrase"))).alias("_own"))
        first = F.get("_own", F.lit(0))
        item = F.struct("name", sure.alias("confidence"), first["phrase"].alias("evidence"))
        if kind == "entities":
            aliases = F.array_sort(F.array_distinct(F.transform("_own", lambda h: h["phrase"])))
            item = F.struct("name", "type", aliases.alias("aliases"), sure.alias("confidence"))
        lists = own.select(*keys, first["start"].alias("_at"), item.alias("_item"))
    else:
        line = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "start", "phrase", "name", "type"))).alias("_all")).join(df.select(*keys, F.size(tokens(F.col(text))).alias("_n")), keys)
        pairs = F.transform("_all", lambda h, i: F.struct(h.alias("own"), F.get("_all", i + 1).alias("next")))
        each = line.select(*keys, "_n", F.inline(pairs))
        if kind == "claims":
            item = F.struct(F.col("own.phrase").alias("text"), F.col("own.type").alias("claim_type"), F.lit(0.5).alias("confidence"), F.col("own.phrase").alias("evidence"))
        elif kind == "relationships":
            each = each.filter("next IS NOT NULL AND next.name <> own.name")
            item = F.struct(F.col("own.name").alias("subject"), F.lit("precedes").alias("predicate"), F.col("next.name").alias("object"), F.lit(0.5).alias("confidence"), F.concat_ws(" ", "own.phrase", "next.phrase").alias("evidence"))
        else:
            end = F.coalesce("next.start", "_n")
            item = F.struct(F.col("own.name").alias("title"), F.col("own.start").cast("double").alias("start_timestamp"), end.cast("double").alias("end_timestamp"), F.col("own.type").alias("summary"), F.lit(0.5).alias("confidence"))
        lists = each.select(*keys, F.col("own.start").alias("_at"), item.alias("_item"))
    whole = lists.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_item"))), lambda x: x["_item"]).alias("_items"))
    empty = F.lit(f'{{"{kind}":[]}}')
    return df.select(*keys).join(whole, keys, "left").select(*keys, F.coalesce(F.to_json(F.struct(F.col("_items").alias(kind))), empty).alias("response"))


def run(df: DataFrame, keys: list[str], responses: dict[str, str]) -> DataFrame:
    """(keys, kind, items as JSON, count, incomplete, error): several kinds of responses (kind -> column) of each row read together; an error is that of its kind alone."""
    parts = []
    for kind, column in responses.items():
        got = parse(F.col(column), kind)
        parts.append(F.struct(F.lit(kind).alias("kind"), F.to_json(got["items"]).alias("items"), F.size(got["items"]).alias("count"), got["incomplete"].alias("incomplete"), got["error"].alias("error")))
    return df.select(*keys, F.inline(F.array(*parts)))
