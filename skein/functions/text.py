"""Text columns: transcript cleaning, cues, sentences, slugs, counts.

Word and space classes are Unicode ones, as a text editor sees them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside other lambdas an expression would be computed at each call."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Pieces between white space, none of them empty; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def strip_cue_settings(text: Column) -> Column:
    for name in ("align", "position", "line", "size"):
        text = F.regexp_replace(text, rf"(?U){name}:\S+", "")
    return text


#: Sound markers in subtitles.
SOUND_MARKERS = ("musik", "music", "suara", "sound")


def strip_sounds(text: Column) -> Column:
    for name in SOUND_MARKERS:
        text = F.regexp_replace(text, rf"(?i)\[{name}\]", "")
    return F.regexp_replace(text, "[♪♫]", "")


def strip_speakers(text: Column, strict: bool = True) -> Column:
    """Speaker labels. Strict mode takes any word before a colon, times and addresses too."""
    text = F.regexp_replace(text, r"(?U)>>\s*\w+:", "")
    text = F.regexp_replace(text, r"(?U)SPEAKER\s+\d+:", "")
    return F.regexp_replace(text, r"(?U)\w+\s*:", "") if strict else text


def content_lines(text: Column) -> Column:
    """Trimmed lines that are neither headers, time lines nor empty, joined by spaces."""
    lines = F.transform(F.split(text, "\n"), F.trim)
    good = F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("WEBVTT")) & ~F.startswith(x, F.lit("Kind:")) & ~F.startswith(x, F.lit("Language:")) & ~F.contains(x, F.lit("-->")))
    return F.array_join(good, " ")


def clean_transcript(text: Column, dedup: bool = True) -> Column:
    """Lines, tags, cue settings, sounds, speakers, white space, near-duplicate phrases: in this order."""
    text = squeeze(strip_speakers(strip_sounds(strip_cue_settings(strip_tags(content_lines(text))))))
    return F.trim(drop_repeated_phrases(text)) if dedup else text


def drop_repeated_phrases(text: Column) -> Column:
    """Drop word i (from the fifth on) if the four words before it are, as a set, four words that began 1 to 7 places earlier.

    Linear in the words: each word is hashed once, each run of four has a number
    that depends on its set alone, and only where two numbers are equal are the
    words themselves compared. A text without equal numbers is left as it is.
    """

    def keys(h: Column) -> Column:
        last = F.greatest(F.size(h) - 4, F.lit(0))

        def key(j: Column) -> Column:
            a, b, c, d = (F.get(h, j + n) for n in range(4))
            zero = F.lit(0).cast("long")
            # a sum of the different ones, without regard to order; bits are mixed by the hash
            return a.bitwiseXOR(F.when(b == a, zero).otherwise(b)).bitwiseXOR(F.when((c == a) | (c == b), zero).otherwise(c)).bitwiseXOR(F.when((d == a) | (d == b) | (d == c), zero).otherwise(d))

        return F.transform(F.sequence(F.lit(0), last), key)

    def kept(both: Column) -> Column:
        key, low = both["key"], both["low"]

        def alike(i: Column, j: Column) -> Column:
            run = lambda at: F.array_sort(F.array_distinct(F.slice(low, at + 1, F.lit(4))))
            return F.coalesce((F.get(key, j) == F.get(key, i)) & (run(j) == run(i)), F.lit(False))

        def keep(word: Column, i: Column) -> Column:
            again = (i > 4) & alike(i - 4, i - 5)
            for back in range(6, 12):
                again = again | ((i >= back) & alike(i - 4, i - back))
            return ~again

        return F.array_join(F.filter(both["w"], keep), " ")

    def clean(w: Column) -> Column:
        low = F.transform(w, F.lower)
        key = let(F.transform(w, lambda x: F.xxhash64(F.lower(x))), keys)
        found = let(F.struct(w.alias("w"), low.alias("low"), key.alias("key")), lambda both: F.when(F.size(F.array_distinct(both["key"])) == F.size(both["key"]), F.array_join(both["w"], " ")).otherwise(kept(both)))
        return F.when(F.size(w) < 5, text).otherwise(found)

    return let(words(text), clean)


def light_clean(text: Column) -> Column:
    return squeeze(F.regexp_replace(strip_tags(text), r"(?U)>>\s*\w+:", ""))


def subtitle_format(text: Column) -> Column:
    """vtt or srt by how the text begins; vtt else; blank is empty."""
    body = F.trim(text)
    kind = F.when(F.startswith(body, F.lit("WEBVTT")), "vtt").when(F.regexp_like(body, F.lit(r"^\d+\n\d\d:\d\d:\d\d")), "srt").otherwise("vtt")
    return F.when(F.coalesce(body, F.lit("")) == "", "").otherwise(kind)


def seconds(stamp: Column) -> Column:
    """h:m:s or m:s, a comma or point before the fraction; anything else is 0."""
    p = F.split(F.replace(stamp, F.lit(","), F.lit(".")), ":")
    at = lambda i: F.try_element_at(p, F.lit(i)).try_cast("double")
    found = F.when(F.size(p) == 3, at(1) * 3600 + at(2) * 60 + at(3)).when(F.size(p) == 2, at(1) * 60 + at(2))
    return F.coalesce(found, F.lit(0.0))


_STAMP = r"(\d{2}:\d{2}:\d{2}[.,]\d{3})"


def _cues(blocks: Column) -> Column:
    """Blocks of lines -> array of (start, end, content), those with a time line and text."""

    def cue(b: Column) -> Column:
        line = F.regexp_substr(b, F.lit(_STAMP + r"[ \t]*-->[ \t]*" + _STAMP))
        after = F.regexp_replace(b, r"(?s)^.*?-->[^\n]*\n?", "")
        lines = F.filter(F.transform(F.split(after, "\n"), F.trim), lambda x: (x != "") & ~F.startswith(x, F.lit("align:")) & ~F.startswith(x, F.lit("position:")))
        return F.struct(
            seconds(F.regexp_extract(line, _STAMP, 1)).alias("start"),
            seconds(F.regexp_extract(line, _STAMP + r"[ \t]*-->[ \t]*" + _STAMP, 2)).alias("end"),
            light_clean(F.array_join(lines, " ")).alias("content"),
        )

    timed = F.filter(blocks, lambda b: F.regexp_like(b, F.lit(_STAMP + r"[ \t]*-->[ \t]*" + _STAMP)))
    return F.filter(F.transform(timed, cue), lambda c: c["content"] != "")


def vtt_segments(text: Column, keep_last: bool = False) -> Column:
    """Cues of a WebVTT text. As a cue ends at an empty line, one that the text ends in is lost, unless ``keep_last``."""
    body = F.regexp_replace(text, "\r\n?", "\n")
    blocks = F.split(body, r"\n[ \t]*\n")
    if not keep_last:
        last_open = ~F.regexp_like(body, F.lit(r"\n[ \t]*$"))
        blocks = F.when(last_open, F.slice(blocks, F.lit(1), F.greatest(F.size(blocks) - 1, F.lit(0)))).otherwise(blocks)
    return _cues(blocks)


def srt_segments(text: Column) -> Column:
    return _cues(F.split(F.regexp_replace(text, "\r\n?", "\n"), r"\n[ \t]*\n"))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?U)(?<=[.!?])\s+")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[ /]", "-"), r"[^\p{L}\p{N}-]", "")


def heading(markdown: Column) -> Column:
    """The first first-level heading, or a stand-in."""
    found = F.filter(F.split(markdown, "\n"), lambda x: F.startswith(x, F.lit("# ")))
    return F.coalesce(F.trim(F.substring(F.get(found, F.lit(0)), 3, 1_000_000)), F.lit("Untitled Article"))


def graph_key(label: str, name: Column) -> Column:
    return F.concat(F.lit(f"{label}_"), F.regexp_replace(F.lower(name), " ", "_"))


def rescue_json(text: Column) -> Column:
    """From the first brace to the last, if that parses."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def lower_words(text: Column) -> Column:
    return F.array_distinct(F.transform(words(text), F.lower))


def chunk(pieces: Column, limit: int = 512, overlap: int = 50) -> Column:
    """Sentences packed into chunks of at most ``limit`` words, each carrying the last sentences of the one before, up to ``overlap`` words.

    A sentence is never split, so a chunk can be longer than the limit. Words are
    counted once; the fold is over numbers, and texts are put together at the end.
    """
    span = "struct<first:int,last:int>"
    kind = f"struct<done:array<{span}>,first:int,n:int>"
    whole = lambda x: x.cast("int")

    def carried(n: Column, first: Column, i: Column) -> Column:
        """Of sentences first to i - 1 those at the end of up to ``overlap`` words: (where they begin, their words)."""
        begin = F.struct(i.alias("at"), F.lit(0).alias("n"), F.lit(False).alias("full"))

        def back(s: Column, j: Column) -> Column:
            more = s["n"] + F.get(n, j)
            full = s["full"] | (more > overlap)
            return F.struct(F.when(full, s["at"]).otherwise(j).alias("at"), F.when(full, s["n"]).otherwise(more).alias("n"), full.alias("full"))

        return F.aggregate(F.sequence(i - 1, first, F.lit(-1)), begin, back)

    def spans(n: Column) -> Column:
        begin = F.struct(F.array().cast(f"array<{span}>").alias("done"), F.lit(0).alias("first"), F.lit(0).alias("n")).cast(kind)

        def step(s: Column, i: Column) -> Column:
            own = F.get(n, i)
            flushed = let(carried(n, s["first"], i), lambda c: F.struct(F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), (i - 1).alias("last")).cast(span))).alias("done"), c["at"].alias("first"), (c["n"] + own).alias("n")).cast(kind))
            going = F.struct(s["done"].alias("done"), s["first"].alias("first"), (s["n"] + own).alias("n")).cast(kind)
            return F.when((s["n"] + own > limit) & (i > s["first"]), flushed).otherwise(going)

        last = F.size(n) - 1
        done = F.aggregate(F.sequence(F.lit(0), last), begin, step, lambda s: F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), last.alias("last")).cast(span))))
        return F.when(F.size(n) > 0, done).otherwise(F.array().cast(f"array<{span}>"))

    def packed(p: Column) -> Column:
        made = let(F.transform(p, lambda x: whole(word_count(x))), spans)
        return F.transform(made, lambda c: F.array_join(F.slice(p, c["first"] + 1, c["last"] - c["first"] + 1), " "))

    return let(F.filter(pieces, lambda x: F.trim(x) != ""), packed)


def chunk_segments(segments: Column, limit: int = 512) -> Column:
    """Segments (start, end, content) packed into chunks of at most ``limit`` words, none carried over.

    -> array of (text, word_count, start_seconds, end_seconds, segment_count); a
    segment is never split, so a chunk can be longer than the limit.
    """
    one = "struct<content:array<string>,word_count:int,start_seconds:double,end_seconds:double>"
    kind = f"struct<done:array<{one}>,open:{one}>"
    start = F.struct(F.array().cast(f"array<{one}>").alias("done"), F.lit(None).cast(one).alias("open")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        n = word_count(x["content"]).cast("int")
        begin, end = F.coalesce(x["start"], F.lit(0.0)), F.coalesce(x["end"], F.lit(0.0))
        content = F.coalesce(x["content"], F.lit(""))
        fresh = F.struct(F.array(content).alias("content"), n.alias("word_count"), begin.alias("start_seconds"), end.alias("end_seconds"))
        grown = F.struct(F.concat(s["open"]["content"], F.array(content)).alias("content"), (s["open"]["word_count"] + n).alias("word_count"), s["open"]["start_seconds"].alias("start_seconds"), end.alias("end_seconds"))
        full = F.struct(F.concat(s["done"], F.array(s["open"])).alias("done"), fresh.alias("open")).cast(kind)
        return (
            F.when(s["open"].isNull(), F.struct(s["done"].alias("done"), fresh.alias("open")).cast(kind))
            .when(s["open"]["word_count"] + n > limit, full)
            .otherwise(F.struct(s["done"].alias("done"), grown.alias("open")).cast(kind))
        )

    def finish(s: Column) -> Column:
        every = F.when(s["open"].isNotNull(), F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
        return F.transform(every, lambda c: F.struct(F.array_join(c["content"], " ").alias("text"), c["word_count"].alias("word_count"), c["start_seconds"].alias("start_seconds"), c["end_seconds"].alias("end_seconds"), F.size(c["content"]).alias("segment_count")))

    return F.aggregate(segments, start, step, finish)


#: English function words that an article in another language should not have.
FUNCTION_WORDS = ("the", "is", "are", "was", "were", "has", "have", "been", "will", "would", "could", "should", "may", "might")


def function_words(text: Column) -> Column:
    """How often English function words occur, in any case."""
    return F.regexp_count(text, F.lit(r"(?i)(?U)\b(" + "|".join(FUNCTION_WORDS) + r")\b"))


def sentence_ends(text: Column) -> Column:
    """Runs of sentence terminators, one at least."""
    return F.greatest(F.regexp_count(text, F.lit(r"[.!?]+")), F.lit(1))


def citations(text: Column) -> Column:
    """Bracketed pieces within a line."""
    return F.regexp_count(text, F.lit(r"\[[^\n]*?\]"))


def music_label(text: Column) -> Column:
    low = F.lower(text)
    return F.contains(low, F.lit("[music]")) | F.contains(low, F.lit("(music)"))


def render(template: str, values: dict[str, Column]) -> Column:
    """A template with {{ name }} places; a null value is an empty text, an unknown name an error."""
    parts: list[Column] = []
    at = 0
    for found in re.finditer(r"\{\{\s*(\w+)\s*\}\}", template):
        parts += [F.lit(template[at : found.start()]), F.coalesce(values[found[1]].cast("string"), F.lit(""))]
        at = found.end()
    return F.concat(*parts, F.lit(template[at:]))


#: How long texts may become by their use.
LIMITS = {"description": 5000, "summary": 500, "error": 500, "transcript": 15000, "knowledge": 5000}


def truncate(text: Column, use: str) -> Column:
    return F.substring(text, 1, LIMITS[use])


def seo(title: Column, excerpt: Column, keywords: Column) -> dict[str, Column]:
    """Title of 60 characters, description of 160 (the title's where there is no excerpt), slug, five keywords."""
    return {
        "meta_title": F.substring(title, 1, 60),
        "meta_description": F.substring(F.coalesce(F.nullif(excerpt, F.lit("")), title), 1, 160),
        "slug": slug(title),
        "focus_keywords": F.slice(F.coalesce(keywords, F.array().cast("array<string>")), 1, 5),
    }


def channel_url(handle: Column) -> Column:
    """The page of a channel's videos: of a full URL, a handle with or without @, or a channel's id (UC and 22 more characters).

    A full URL of a handle gets its videos' page unless it names one already; other URLs stay as they are.
    """
    h = F.regexp_replace(handle, r"^\s+|\s+$", "")
    site = F.lit("https://www.youtube.com/")
    bare = ~F.contains(h, F.lit("/videos")) & ~F.contains(h, F.lit("/shorts")) & F.contains(h, F.lit("/@"))
    full = F.when(bare, F.concat(F.regexp_replace(h, "/+$", ""), F.lit("/videos"))).otherwise(h)
    return (
        F.when(F.startswith(h, F.lit("http://")) | F.startswith(h, F.lit("https://")), full)
        .when(F.startswith(h, F.lit("@")), F.concat(site, h, F.lit("/videos")))
        .when(F.startswith(h, F.lit("UC")) & (F.length(h) == 24), F.concat(site, F.lit("channel/"), h, F.lit("/videos")))
        .otherwise(F.concat(site, F.lit("@"), h, F.lit("/videos")))
    )


def embedding_text(title: Column, summary: Column, narrative: Column, context: Column) -> Column:
    """A story's text to embed: title, summary and narrative under their names, and the cultural context (JSON) where there is one, with blank lines between. Nulls are empty."""
    part = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit("")))
    held = F.when(context.isNotNull() & ~context.isin("", "{}", "[]", "null"), F.concat(F.lit("Cultural Context: "), context))
    return F.concat_ws("\n\n", part("Title", title), part("Summary", summary), part("Narrative", narrative), held)
