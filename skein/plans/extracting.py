"""Typed extraction of seven kinds over the conversations, and prompts from templates."""

from pyspark.sql import functions as F

from skein.functions.templates import render
from skein.registry import query
from skein.session import table as t
from skein.sources import extraction as x

#: The dictionaries of the offline model: phrase, name, type.
TERMS = {
    "themes": (("the of the", "loss", "t"), ("of the", "fear", "t"), ("the", "curiosity", "t"), ("and the", "warning", "t"), ("the and the", "afterlife", "t")),
    "motifs": (("ci n", "mysterious voice", "m"), ("de ci", "shadow figure", "m"), ("de ci n", "possession", "m"), ("ci", "dream vision", "m")),
    "archetypes": (("that", "the skeptic", "a"), ("that the", "the elder", "a"), ("is", "the witness", "a"), ("is a", "the guide", "a")),
    "entities": (("la", "pocong", "spirit"), ("de la", "kuntilanak", "spirit"), ("en", "leak", "witch"), ("en la", "leak", "witch"), ("der", "tuyul", "child")),
    "claims": (("was", "w", "historical"), ("it was", "iw", "testimony"), ("for", "f", "belief")),
    "relationships": (("la", "pocong", "spirit"), ("de la", "kuntilanak", "spirit"), ("the", "leak", "witch"), ("the of", "tuyul", "child")),
    "stories": (("to the", "arrival", "s"), ("in the", "inside", "s"), ("in", "place", "s")),
}
KEYS = ["conv_id", "turn"]


def answered(s, d, kind):
    """Responses to each turn: as the model writes them, some within prose, some cut off, some of another form."""
    terms = s.createDataFrame([(p, n, k) for p, n, k in TERMS[kind]], "phrase string, name string, type string")
    # turns of one id and number are told apart by their text
    rows = t(s, d, "conversations").select("conv_id", "turn", "text").distinct()
    out = x.answers(rows.groupBy(*KEYS).agg(F.min("text").alias("text")), KEYS, "text", terms, kind)
    r, i = F.col("response"), F.col("conv_id") + F.col("turn")
    fence = F.concat(F.lit("Here it is:\n```json\n"), r, F.lit("\n```\nDone."))
    odd = F.when(i % 11 == 3, fence).when(i % 11 == 5, F.lit("I can't say.")).when(i % 11 == 7, F.lit(f'{{"{kind}": "none"}}')).when(i % 11 == 9, F.lit("{}")).otherwise(r)
    return out.select(*KEYS, odd.alias("response"))


def twin(kind: str, body: str) -> str:
    """Hits by a pattern whose alternatives stand from the longest to the shortest, over words that are joined by single spaces."""
    terms = sorted(TERMS[kind], key=lambda p: -len(p[0].split()))
    pattern = "|".join(p for p, _, _ in terms)
    values = ", ".join(f"('{p}', '{n}', '{k}')" for p, n, k in terms)
    return f"""WITH v(phrase, name, type) AS (VALUES {values}), c AS (SELECT conv_id, turn, array_to_string(list_filter(string_split_regex(lower(min(text)), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), ' ') AS j, (conv_id + turn) % 11 AS m FROM conversations GROUP BY conv_id, turn),
m AS (SELECT conv_id, turn, m, len(list_filter(string_split(j, ' '), lambda w: w <> '')) AS n, string_split(regexp_replace(' ' || replace(j, ' ', '  ') || ' ', ' ({pattern.replace(" ", "  ")}) ', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts FROM c),
u AS (SELECT conv_id, turn, m, n, generate_subscripts(parts, 1) AS i, unnest(parts) AS part FROM m),
w AS (SELECT *, len(list_filter(string_split_regex(part, '[ \\x02]+'), lambda w: w <> '')) AS size, replace(string_split(part, chr(2))[1], '  ', ' ') AS phrase FROM u),
s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id, turn ORDER BY i) - size AS start FROM w),
h AS (SELECT conv_id, turn, m, n, i - 1 AS place, start, phrase, name, type FROM s JOIN v USING (phrase) WHERE i > 1 AND m NOT IN (5, 7, 9)) {body}"""


NAMED = "SELECT conv_id, turn, name, round(least(1, 0.5 + 0.1 * count(*)), 2)::DOUBLE AS confidence, min_by(phrase, start) AS evidence FROM h GROUP BY conv_id, turn, name"


def items(s, d, kind):
    df = answered(s, d, kind)
    return df.select(*KEYS, F.inline(x.parse(F.col("response"), kind)["items"]))


@query("x16_themes", twin("themes", NAMED))
def themes(s, d):
    return items(s, d, "themes").select(*KEYS, "name", "confidence", "evidence")


@query("x16_motifs", twin("motifs", NAMED))
def motifs(s, d):
    return items(s, d, "motifs").select(*KEYS, "name", "confidence", "evidence")


@query("x16_archetypes", twin("archetypes", NAMED))
def archetypes(s, d):
    return items(s, d, "archetypes").select(*KEYS, "name", "confidence", "evidence")


@query("x16_entities", twin("entities", "SELECT conv_id, turn, name, type, string_agg(DISTINCT phrase, ',' ORDER BY phrase) AS aliases, round(least(1, 0.5 + 0.1 * count(*)), 2)::DOUBLE AS confidence FROM h GROUP BY conv_id, turn, name, type"))
def entities(s, d):
    return items(s, d, "entities").select(*KEYS, "name", "type", F.array_join("aliases", ",").alias("aliases"), "confidence")


@query("x16_claims", twin("claims", "SELECT conv_id, turn, phrase AS text, type AS claim_type, count(*) AS claims FROM h GROUP BY ALL"))
def claims(s, d):
    return items(s, d, "claims").groupBy(*KEYS, "text", "claim_type").agg(F.count("*").alias("claims"))


@query("x16_relationships", twin("relationships", ", p AS (SELECT conv_id, turn, name AS subject, lead(name) OVER (PARTITION BY conv_id, turn ORDER BY place) AS object FROM h) SELECT conv_id, turn, subject, object, count(*) AS times FROM p WHERE subject <> object GROUP BY ALL"))
def relationships(s, d):
    return items(s, d, "relationships").groupBy(*KEYS, "subject", "object").agg(F.count("*").alias("times"))


@query("x16_stories", twin("stories", "SELECT conv_id, turn, name AS title, start::DOUBLE AS start_timestamp, coalesce(lead(start) OVER (PARTITION BY conv_id, turn ORDER BY place), n)::DOUBLE AS end_timestamp FROM h"))
def stories(s, d):
    return items(s, d, "stories").select(*KEYS, "title", "start_timestamp", "end_timestamp")


@query("x16_errors", "SELECT kind, CASE (conv_id + turn) % 11 WHEN 5 THEN 'no_json' WHEN 7 THEN 'not_a_list' END AS error, count(*) AS responses FROM (SELECT DISTINCT conv_id, turn FROM conversations), (VALUES ('themes'), ('claims'), ('stories')) k(kind) GROUP BY ALL")
def errors(s, d):
    """The responses of three kinds read together: how many went wrong, and how."""
    kinds = ("themes", "claims", "stories")
    df = None
    for kind in kinds:
        one = answered(s, d, kind).withColumnRenamed("response", kind)
        df = one if df is None else df.join(one, KEYS)
    return x.run(df, KEYS, {k: k for k in kinds}).groupBy("kind", "error").agg(F.count("*").alias("responses"))


TEMPLATE = """Conversation {{ conv }}{% if turns | length > 3 %} (long){% elif turns | length == 1 %} (single){% endif %}
{% for m in turns -%}
{{ loop.index }}. {{ m.role | default("nobody") | upper }}: {{ m.text | default("-") }}{% if not loop.last %};{% endif %}
{% else %}nothing
{% endfor -%}
Roles: {{ turns | join(", ", attribute="role") }}{% if "system" in roles %} with instructions{% endif %}"""


@query("tx31_prompts", """WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, 'Conversation ' || conv_id || CASE WHEN n > 3 THEN ' (long)' WHEN n = 1 THEN ' (single)' ELSE '' END || chr(10)
 || string_agg(i || '. ' || upper(coalesce(role, 'nobody')) || ': ' || coalesce(text, '-') || CASE WHEN i < n THEN ';' ELSE '' END || chr(10), '' ORDER BY i) || 'Roles: ' || string_agg(coalesce(role, ''), ', ' ORDER BY i) || CASE WHEN bool_or(role = 'system') THEN ' with instructions' ELSE '' END AS prompt FROM m GROUP BY conv_id, n""")
def prompts(s, d):
    """A prompt for each conversation from a template with a loop, conditions and filters."""
    rows = t(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    roles = F.transform("turns", lambda m: m["role"])
    return rows.select("conv_id", render(rows, TEMPLATE, conv="conv_id", turns="turns", roles=roles).alias("prompt"))
