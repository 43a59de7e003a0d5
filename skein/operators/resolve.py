"""Entity resolution: aliases to canonical names, merging of duplicates, registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators.joins import small_join
from skein.storage import stored


#: Canonical names with their aliases, in the order in which they are tried.
KNOWN_ALIASES = {
    "kuntilanak": ("pontianak", "kunti", "hantu perempuan"),
    "genderuwo": ("gendruwo", "genderuwo", "hantu bodoh"),
    "pocong": ("hantu pocong", "mayat terbungkus"),
    "tuyul": ("tuyul", "hantu anak kecil"),
    "wewe": ("wewe gombel", "gandarwa"),
    "leak": ("leyak", "leak bali"),
    "babi ngepet": ("babi ngepet", "celeng"),
    "jelangkung": ("jelangkung", "boneka arwah"),
}
#: Regions as they are written.
REGIONS = ("Jawa", "Jawa Timur", "Jawa Tengah", "Jawa Barat", "Kalimantan", "Kalimantan Barat", "Sumatera", "Sumatera Utara", "Sulawesi", "Bali")


def alias_table(spark: SparkSession, known: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(alias, canonical, place) of a dictionary; a canonical name is an alias of its own."""
    rows = [(a, name, place) for place, (name, aliases) in enumerate((known or KNOWN_ALIASES).items()) for a in dict.fromkeys((name, *aliases))]
    return spark.createDataFrame(rows, "alias string, canonical string, place int")


def region(name: Column) -> Column:
    """A known region as it is written, whatever the case and the space around it; any other as it came."""
    table = F.create_map(*[F.lit(x) for r in REGIONS for x in (r.lower(), r)])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(name))), name)


def backfill(canonical: Column, name: Column, aliases: Column, known: dict[str, tuple[str, ...]] | None = None) -> Column:
    """An entity's aliases with the known ones of its canonical name added, but for the entity's own name in lower case."""
    table = F.create_map(*[x for n, a in (known or KNOWN_ALIASES).items() for x in (F.lit(n), F.array(*[F.lit(v) for v in a]))])
    none = F.array().cast("array<string>")
    own = F.coalesce(aliases, none)
    more = F.filter(F.coalesce(F.try_element_at(table, canonical), none), lambda a: a != F.lower(name))
    return F.concat(own, F.array_except(more, own))


def alias_map(resolved: DataFrame, known: DataFrame, doc: str, name: str = "name") -> DataFrame:
    """(doc, canonical, names): the observed lower-case names of known entities, none for unknown ones; blank names have no row."""
    low = F.lower(F.trim(F.col(name)))
    names = resolved.filter(F.length(F.coalesce(F.col(name), F.lit(""))) > 0).withColumn("_low", low)
    table = known.groupBy(F.lower("alias").alias("_low")).agg(F.lit(True).alias("_known"))
    marked = small_join(names, table, "_low", "left")
    return marked.groupBy(doc, "canonical").agg(F.sort_array(F.collect_set(F.when(F.col("_known"), F.col("_low")))).alias("names"))


def merge_log(entities: DataFrame, doc: str, position: str, key: str) -> DataFrame:
    """(doc, target, source): one row for each entity that went into the first one of its canonical name."""
    first = F.min_by(key, position).over(W.partitionBy(doc, "canonical"))
    start = F.min(position).over(W.partitionBy(doc, "canonical"))
    return entities.withColumns({"_target": first, "_start": start}).filter(F.col(position) > F.col("_start")).select(doc, F.col("_target").alias("target"), F.col(key).alias("source"))


def rewrite_references(claims: DataFrame, log: DataFrame, doc: str, ids: str) -> DataFrame:
    """Claims whose references to merged entities point at their targets, in place and order; other references, and null lists, stay.

    References meet the log one by one, by document and id; no document's merges
    are gathered. Of several targets of an id the smallest counts.
    """
    rows = stored(claims.withColumn("_row", F.monotonically_increasing_id()), "claims")
    to = log.groupBy(F.col(doc).alias("_doc"), F.col("source").alias("_id")).agg(F.min("target").alias("_target"))
    each = rows.select("_row", F.col(doc).alias("_doc"), F.posexplode(ids).alias("_place", "_id"))
    met = each.join(to, ["_doc", "_id"], "left").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_place", F.coalesce("_target", "_id").alias("_new")))).alias("_all"))
    out = rows.join(met, "_row", "left").withColumn(ids, F.when(F.col("_all").isNull(), F.col(ids)).otherwise(F.transform("_all", lambda x: x["_new"])))
    return out.drop("_row", "_all")


def canonical(names: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """Add ``canonical``: of the alias dictionary (alias, canonical, place), the first place winning; else the name in lower case without the space around it."""
    first = aliases.groupBy(F.lower("alias").alias("_key")).agg(F.min_by("canonical", "place").alias("_found"))
    out = small_join(names.withColumn("_key", F.lower(F.trim(F.col(name)))), first, "_key", "left")
    return out.withColumn("canonical", F.coalesce("_found", "_key")).drop("_key", "_found")


def merge(entities: DataFrame, doc: str, position: str) -> DataFrame:
    """One entity for each document and canonical name: the first one's fields, all evidence and names in order, the largest confidence.

    entities: doc, position, canonical, name, confidence, evidence (array).
    """
    rows = entities.groupBy(doc, "canonical").agg(F.array_sort(F.collect_list(F.struct(position, "name", "evidence"))).alias("all"), F.max("confidence").alias("confidence"), F.count("*").alias("merged"))
    first = F.get("all", F.lit(0))
    return rows.select(
        doc, "canonical", first[position].alias(position), first["name"].alias("name"), "confidence", "merged",
        F.array_distinct(F.flatten("all.evidence")).alias("evidence"), F.array_except(F.array_distinct("all.name"), F.array(first["name"])).alias("aliases"),
    )


def registry(entities: DataFrame, doc: str, seen: str) -> DataFrame:
    """Canonical names with the number of documents and when they were first seen."""
    return entities.groupBy("canonical").agg(F.count_distinct(doc).alias("stories"), F.min(seen).alias("first_seen"))


def find_or_create(existing: DataFrame, found: DataFrame, key: list[str], *order) -> DataFrame:
    """Rows to add: keys that don't exist, one row each."""
    new = found.join(existing.select(*key), key, "left_anti")
    return new.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")
