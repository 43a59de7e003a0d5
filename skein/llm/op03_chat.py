"""Chat formatting: cumulative snapshots collapse to their longest conversation.

A logger that stores a conversation after every turn leaves prefixes of it. Each
turn gets the hash of all turns up to it (two exclusive-ors of 64-bit turn hashes
that hold the turn's place, so a prefix hash is a running aggregate that can't
overflow, and long conversations are aggregated in blocks). A conversation whose last prefix hash is an earlier prefix
hash of another one is a snapshot; an anti-join on (turns, hash) leaves the
maximal ones, of equal ones that with the least id. Only these are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.common import cut, table

#: Turns that one sorted run of a conversation holds.
BLOCK = 256
ROLE, END = "<|{}|>\n", "<|end|>\n"


def rendered(role: Column, text: Column) -> Column:
    """One turn in the template; a null role is ``unknown``, a null text empty."""
    head, tail = ROLE.split("{}")
    return F.concat(F.lit(head), F.coalesce(role, F.lit("unknown")), F.lit(tail), F.coalesce(text, F.lit("")), F.lit(END))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, block, place from 1, turns of the conversation, h1, h2: hash up to the turn); texts are left behind as hashes."""
    named = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    df = turns.select("conv_id", "turn", "role", *[F.xxhash64(F.lit(k), *named).alias(f"k{k}") for k in (1, 2)])
    df = df.withColumn("block", F.floor(F.col("turn") / BLOCK))
    df = df.withColumn("_r", F.row_number().over(W.partitionBy("conv_id", "block").orderBy(*TURN_ORDER)))
    sizes = df.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"),
        F.sum("n").over(W.partitionBy("conv_id")).alias("turns"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("block").eqNullSafe(F.col("_b"))
    df = df.join(sizes, same).withColumn("place", F.col("_base") + F.col("_r")).drop("_c", "_b", "_base", "_r")
    for k in (1, 2):
        df = df.withColumn(f"t{k}", F.xxhash64(F.lit(k), "place", "k1", "k2"))
    sums = df.groupBy("conv_id", "block").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    sums = sums.select(
        F.col("conv_id").alias("_c"), F.col("block").alias("_b"),
        *[F.coalesce(F.bit_xor(f"s{k}").over(before), F.lit(0)).alias(f"_s{k}") for k in (1, 2)],
    )
    upto = W.partitionBy("conv_id", "block").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumns({f"h{k}": F.bit_xor(f"t{k}").over(upto) for k in (1, 2)}).join(sums, same)
    return df.select("conv_id", "block", "place", "turns", *[F.col(f"h{k}").bitwiseXOR(F.col(f"_s{k}")).alias(f"h{k}") for k in (1, 2)])


#: Order of turns; the hashes part turns that are equal but for the text.
TURN_ORDER = ("turn", "role", "k1", "k2")


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, copies, text) of every maximal conversation; copies: conversations equal to it.

    Turns are ordered by turn and role, nulls first, equal ones by a hash of the
    text; a null conv_id is one conversation of its own. Repeated rows are turns
    of their own. Null roles and texts equal only nulls. Very long texts are
    whole. An empty table gives an empty result. Other columns are left out.
    """
    df = cut(prefixes(turns), "prefixes")
    name = ["place", "h1", "h2"]
    whole = df.filter("place = turns").groupBy(*name).agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id")).alias("keep"), F.count("*").alias("copies"))
    earlier = df.filter("place < turns").select(*name).distinct()
    kept = whole.join(earlier, name, "left_anti").select(F.col("keep.conv_id").alias("_keep"), F.col("place").alias("turns"), "copies")
    named = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    lines = turns.select("conv_id", "turn", "role", *[F.xxhash64(F.lit(k), *named).alias(f"k{k}") for k in (1, 2)], rendered(F.col("role"), F.col("text")).alias("text"))
    lines = lines.join(cut(kept, "maximal"), F.col("conv_id").eqNullSafe(F.col("_keep"))).drop("_keep").withColumn("block", F.floor(F.col("turn") / BLOCK))
    # blocks first: a long conversation is put in order in parts
    blocks = lines.groupBy("conv_id", "block", "turns", "copies").agg(F.sort_array(F.collect_list(F.struct(*TURN_ORDER, "text"))).alias("all"))
    blocks = blocks.select("conv_id", "turns", "copies", "block", F.array_join("all.text", "").alias("text"))
    chats = blocks.groupBy("conv_id", "turns", "copies").agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("all"))
    return chats.select("conv_id", "turns", "copies", F.array_join("all.text", "").alias("text"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM conversations),
c AS (SELECT conv_id, count(*) AS turns, list({'role': role, 'text': text} ORDER BY place) AS l FROM t GROUP BY conv_id),
k AS (SELECT l, turns, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY l, turns),
x AS (SELECT DISTINCT list_slice(l, 1, i) AS l FROM (SELECT l, unnest(range(1, turns)) AS i FROM k))
SELECT conv_id, turns, copies,
       array_to_string(list_transform(l, lambda m: '<|' || coalesce(m.role, 'unknown') || '|>' || chr(10) || coalesce(m.text, '') || '<|end|>' || chr(10)), '') AS text
FROM k ANTI JOIN x USING (l)
"""
