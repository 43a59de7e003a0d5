"""Fill-in-the-middle: texts cut at two units and their middle moved to the end.

Units (code points here) and the markers that forbid a cut are recognised by
automata. A text of up to CHUNK bytes is one chunk and is scanned where its row
is read. Longer ones are dealt out as chunks: each emits its state-transition
function with the units it counts from every state, the functions are composed
in order, which says in which state and at which count each chunk is entered,
and the chunks in which cuts lie find the bytes. The other columns and the text
itself never pass through Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.automata import Automaton, code_points, literals, running, scans
from skein.llm.common import cut, packed, quoted, ship, table

#: Markers before prefix, suffix and middle; of 100 texts, how many are moved, and of 100 moved ones how many with the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MOVED, SUFFIX_FIRST = 90, 20
#: Bytes of a chunk.
CHUNK = 1 << 16

_CUTS = "struct<n:bigint,found:boolean,from:bigint,to:bigint,prefix_chars:bigint,middle_chars:bigint>"
_ARROW = pa.struct([("n", pa.int64()), ("found", pa.bool_()), ("from", pa.int64()), ("to", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])


def _draw(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """After how many of n units prefix and middle end."""
    a, b = first % (n + 1), second % (n + 1)
    return np.minimum(a, b), np.maximum(a, b)


def _whole(unit: Automaton, marks: Automaton):
    """Texts of one chunk, with their two random numbers -> their cuts."""

    def cuts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        out = []
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        first, second = first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False)
        for at, many, (units, found) in scans(texts, unit, marks):
            rows = slice(at, at + many)
            zero = np.zeros(many, np.int64)
            n, seen = units.functions()[1][:, 0], found.functions()[1][:, 0] > 0
            a, b = _draw(first[rows], second[rows], n)
            ends = [np.where(c == n, size[rows], units.find(zero, c)) for c in (a, b)]
            out.append(pa.StructArray.from_arrays([pa.array(x) for x in (n, seen, *ends, a, b - a)], fields=list(_ARROW)))
        return pa.concat_arrays(out) if out else pa.array([], _ARROW)

    return cuts


def _summaries(unit: Automaton, marks: Automaton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, many, both in scans(batch.column("bytes"), unit, marks):
                own = batch.slice(at, many)
                functions = [x for s in both for x in s.functions()]
                lists = [pa.array(list(f), pa.list_(pa.int64())) for f in functions]
                yield pa.RecordBatch.from_arrays([own.column(c) for c in ("_row", "_k", "_size", "_h1", "_h2")] + lists, ["_row", "_k", "_size", "_h1", "_h2", "to", "units", "mark_to", "marks"])

    return run


def _resolve(group: pa.Table) -> pa.Table:
    """All functions of one text, at most 2 GB / CHUNK -> the state and the count with which each chunk is entered, and the cuts."""
    group = group.sort_by("_k")
    first = np.zeros(group.num_rows, np.int64)

    def table_of(name: str) -> np.ndarray:
        return np.array(group.column(name).to_pylist(), np.int64)

    to, units = running(table_of("to"), table_of("units"), first)
    seen = running(table_of("mark_to"), table_of("marks"), first)[1][-1, 0] > 0
    n = units[-1, 0]
    a, b = _draw(*(group.column(c)[0].as_py() * np.ones(1, np.int64) for c in ("_h1", "_h2")), np.array([n]))
    before = np.append(0, units[:-1, 0])
    many = group.num_rows
    return pa.table({
        "_row": group.column("_row"), "_k": group.column("_k"), "entry": np.append(0, to[:-1, 0]), "a": a - before, "b": b - before,
        "n": np.full(many, n), "found": np.full(many, seen), "prefix_chars": np.full(many, a[0]), "middle_chars": np.full(many, (b - a)[0]),
    })


def _select(unit: Automaton, chunk: int):
    """Chunks with their entry state and the units wanted from there on -> the bytes of the text at which these begin, in the chunk that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, many, (units,) in scans(batch.column("bytes"), unit):
                own = batch.slice(at, many)
                entry, k = own.column("entry").to_numpy(), own.column("_k").to_numpy()
                found = [units.find(entry, own.column(c).to_numpy()) for c in ("a", "b")]
                yield pa.RecordBatch.from_arrays([own.column("_row"), *(pa.array(np.where(f >= 0, f + k * chunk, -1)) for f in found)], ["_row", "from", "to"])

    return run


def cuts_of(docs: DataFrame, text: str, first: Column, second: Column, unit: Automaton, marks: Automaton, chunk: int = CHUNK) -> DataFrame:
    """(_rest: the row, _cut: n, found, from, to, prefix_chars, middle_chars) of every row; from and to are bytes."""
    ship(docs.sparkSession)
    rows = docs.select(packed(docs).alias("_rest"), F.coalesce(docs[quoted(text)].cast("binary"), F.lit(b"")).alias("_text"), first.alias("_h1"), second.alias("_h2"))
    size = F.octet_length("_text")
    whole = F.arrow_udf(_whole(unit, marks), _CUTS)
    short = rows.filter(size <= chunk).select("_rest", whole("_text", "_h1", "_h2").alias("_cut"))

    # the longer ones: stored once as chunks, the row itself with the first
    dealt = rows.filter(size > chunk).withColumn("_row", F.monotonically_increasing_id()).withColumn("_size", size.cast("long"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_size") - 1) / chunk))).alias("_k"))
    piece = F.substring("_text", (F.col("_k") * chunk + 1).cast("int"), F.lit(chunk))
    stored = cut(dealt.select("_row", "_k", "_size", "_h1", "_h2", piece.alias("bytes"), F.when(F.col("_k") == 0, F.col("_rest")).alias("_rest")), "chunks")
    pieces = stored.select("_row", "_k", "_size", "_h1", "_h2", "bytes").repartition("_row", "_k")
    lists = ", ".join(f"{c} array<bigint>" for c in ("to", "units", "mark_to", "marks"))
    summaries = pieces.mapInArrow(_summaries(unit, marks), f"_row long, _k long, _size long, _h1 long, _h2 long, {lists}")
    solved = cut(summaries.groupBy("_row").applyInArrow(_resolve, "_row long, _k long, entry long, a long, b long, n long, found boolean, prefix_chars long, middle_chars long"), "entries")
    found = stored.select("_row", "_k", "bytes").join(solved.select("_row", "_k", "entry", "a", "b"), ["_row", "_k"]).mapInArrow(_select(unit, chunk), "_row long, from long, to long")
    ends = found.groupBy("_row").agg(F.max("from").alias("from"), F.max("to").alias("to"))
    facts = solved.filter("_k = 0").select("_row", "n", "found", "prefix_chars", "middle_chars").join(ends, "_row")
    long = stored.filter("_k = 0").select("_row", "_rest", "_size").join(facts, "_row")
    end = {c: F.when(F.col(c) < 0, F.col("_size")).otherwise(F.col(c)).alias(c) for c in ("from", "to")}
    return short.unionByName(long.select("_rest", F.struct("n", "found", end["from"], end["to"], "prefix_chars", "middle_chars").alias("_cut")))


def numbers(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers that depend on seed and key alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text, from what was made of it and its form alone."""

    def parts(one: str, two: str) -> list[Column]:
        body = F.substring(output, F.lit(len(one) + 1), F.length(output))
        a = F.substring_index(body, two, 1)
        rest = F.substring(body, F.length(a) + len(two) + 1, F.length(body))
        b = F.substring_index(rest, MIDDLE, 1)
        return [a, b, F.substring(rest, F.length(b) + len(MIDDLE) + 1, F.length(rest))]

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix2, prefix2, middle2 = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 1, unit: Automaton | None = None, chunk: int = CHUNK) -> DataFrame:
    """The columns of docs with n (units), form (plain, psm, spm), prefix_chars and middle_chars (units; null if plain) and output.

    Columns of docs with these names are replaced, all others are kept whatever
    their names. A null text is empty; empty texts and those that hold a marker
    stay plain. Cuts depend on the seed and the key alone: a null key is one
    more key, rows of equal key and text give equal rows. Texts of any length
    are cut the same way. An empty table gives an empty result.
    """
    marks = literals((PREFIX, SUFFIX, MIDDLE))
    h1, h2, h3, h4 = numbers(docs[quoted(key)], seed)
    found = cuts_of(docs, text, h1, h2, unit or code_points(), marks, chunk)
    rest = F.col("_rest")
    whole = F.coalesce(rest[text].cast("string"), F.lit(""))
    raw = whole.cast("binary")
    _, _, h3, h4 = numbers(rest[key], seed)
    plain = (F.col("_cut.n") == 0) | F.col("_cut.found") | (h3 % 100 >= MOVED)
    form = F.when(plain, "plain").when(h4 % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    start, end = F.col("_cut.from").cast("int"), F.col("_cut.to").cast("int")
    prefix = F.substring(raw, F.lit(1), start).cast("string")
    middle = F.substring(raw, start + 1, end - start).cast("string")
    suffix = F.substring(raw, end + 1, F.octet_length(raw)).cast("string")
    out = F.when(plain, whole).when(form == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    new = {
        "n": F.col("_cut.n"), "form": form, "prefix_chars": F.when(~plain, F.col("_cut.prefix_chars")), "middle_chars": F.when(~plain, F.col("_cut.middle_chars")), "output": out,
    }
    kept = [rest[c].alias(c) for c in docs.columns if c not in new]
    return found.select(*kept, *[c.alias(name) for name, c in new.items()])


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = transform(docs)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (
  SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM t
),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
