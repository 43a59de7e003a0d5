"""Sources and sinks: payload projections, subtitle choice, upserts, exports, extractors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.scalars import record_hash
from skein.functions.text import token_estimate, words
from skein.operators.joins import small_join
from skein.storage import scratch as scratch

#: Columns of a video with the payload's field, type and default of each.
VIDEO = {
    "video_id": ("id", "string", ""),
    "title": ("title", "string", ""),
    "description": ("description", "string", ""),
    "duration_seconds": ("duration", "long", 0),
    "upload_date": ("upload_date", "string", ""),
    "view_count": ("view_count", "long", 0),
    "like_count": ("like_count", "long", 0),
    "comment_count": ("comment_count", "long", 0),
    "channel_id": ("channel_id", "string", ""),
    "channel_name": ("channel", "string", ""),
    "thumbnail_url": ("thumbnail", "string", ""),
    "webpage_url": ("webpage_url", "string", ""),
    "channel_url": ("channel_url", "string", ""),
    "uploader": ("uploader", "string", ""),
    "extractor": ("extractor", "string", "youtube"),
}
#: The same for a channel.
CHANNEL = {
    "channel_id": ("channel_id", "string", ""),
    "name": ("channel", "string", ""),
    "description": ("description", "string", ""),
    "subscriber_count": ("subscriber_count", "long", 0),
    "video_count": ("video_count", "long", 0),
    "channel_url": ("channel_url", "string", ""),
    "avatar_url": ("avatar", "string", ""),
    "banner_url": ("banner_url", "string", ""),
}


def project(payload: Column, fields: dict[str, tuple] | None = None) -> list[Column]:
    """Columns of a variant with defaults; absent and null are alike here."""
    return [F.coalesce(F.try_variant_get(payload, f"$.{name}", kind), F.lit(default).cast(kind)).alias(out) for out, (name, kind, default) in (fields or VIDEO).items()]


def has_subtitles(manual: Column, automatic: Column) -> Column:
    """Any caption, manual or automatic, by language map."""
    n = lambda m: F.coalesce(F.size(F.map_keys(m)), F.lit(0))
    return (n(manual) > 0) | (n(automatic) > 0)


def video(payload: Column) -> list[Column]:
    """All columns of a video: the plain fields, its lists, and whether it has captions."""
    captions = lambda name: F.try_variant_get(payload, f"$.{name}", "map<string,variant>")
    lists = [F.coalesce(F.try_variant_get(payload, f"$.{n}", "array<string>"), F.array().cast("array<string>")).alias(n) for n in ("tags", "categories")]
    return [*project(payload), *lists, has_subtitles(captions("subtitles"), captions("automatic_captions")).alias("has_subtitles")]


def playlist(df: DataFrame, entries: str) -> DataFrame:
    """One row for each entry, with its place; null entries are dropped."""
    return df.select("*", F.posexplode(entries).alias("place", "entry")).filter(F.col("entry").isNotNull()).drop(entries)


def pick_subtitle(tracks: DataFrame, key: str, languages: list[str], formats: tuple[str, ...] = ("vtt", "srt")) -> DataFrame:
    """tracks (key, language, format, automatic): the first by language, then format; languages not asked for come last, as automatic ones."""
    lang = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("language"))
    fmt = F.array_position(F.array(*[F.lit(x) for x in formats]), F.col("format"))
    known = tracks.filter(fmt > 0).withColumns({"_l": F.when(lang > 0, lang).otherwise(len(languages) + 1), "_f": fmt})
    best = known.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("_l", "_f", "language"))).filter("_r = 1")
    return best.withColumn("automatic", F.col("automatic") | (F.col("_l") > len(languages))).drop("_l", "_f", "_r")


def catalogue(captions: Column) -> Column:
    """Language -> list of formats."""
    return F.transform_values(captions, lambda _, v: F.transform(v, lambda x: x["ext"]))


def version(df: DataFrame, key: str, *payload: str) -> DataFrame:
    """Immutable payload versions by content hash."""
    return df.select(key, record_hash(*payload).alias("payload_hash"), F.to_json(F.struct(*sorted(payload))).alias("payload")).distinct()


def upsert(existing: DataFrame, new: DataFrame, key: str, order: str, *ties: str) -> DataFrame:
    """The last row of each key by ``order``, of old and new ones; of equally late rows an old one stays, then the least by ``ties``."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = W.partitionBy(key).orderBy(F.col(order).desc(), "_new", *ties)
    return both.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r", "_new")


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files under a folder, in any store that Spark writes to."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(found).getLength()


def export(df: DataFrame, path: str, kind: str = "parquet") -> dict:
    """Write and report (status, url, size, records) of what is in place, read back; a write that fails is reported with its error."""
    spark = df.sparkSession
    try:
        df.write.mode("overwrite").format(kind).save(path)
    except Exception as e:
        return {"status": "failed", "url": None, "size": 0, "records": 0, "error": str(e)[:500]}
    records = spark.read.format(kind).schema(df.schema).load(path).count()
    return {"status": "completed", "url": path, "size": stored_bytes(spark, path), "records": records, "error": None}


def crawl_sink(results: DataFrame, path: str, by: str) -> DataFrame:
    """Crawl results as JSON files in a folder for each value of ``by``; -> what is in place, read back with the same columns."""
    results.write.mode("overwrite").partitionBy(by).json(path)
    return results.sparkSession.read.schema(results.schema).json(path)


def graph_upsert(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> dict[str, DataFrame]:
    """Merge nodes (label, id) and edges (type, src, dst) into a graph: the graph after, and what was created.

    Repeated new rows are one; a row that is there stays as it is.
    """
    fresh_nodes = new_nodes.dropDuplicates(["label", "id"]).join(nodes.select("label", "id"), ["label", "id"], "left_anti")
    fresh_edges = new_edges.dropDuplicates(["type", "src", "dst"]).join(edges.select("type", "src", "dst"), ["type", "src", "dst"], "left_anti")
    return {
        "nodes": nodes.unionByName(fresh_nodes, allowMissingColumns=True), "edges": edges.unionByName(fresh_edges, allowMissingColumns=True),
        "new_nodes": fresh_nodes, "new_edges": fresh_edges,
    }


STORY = ("title", "summary", "story_type", "primary_culture", "region", "time_period", "confidence", "source_video_id", "source_transcript_id", "extraction_model", "extraction_version")


def story_tables(stories: DataFrame) -> dict[str, DataFrame]:
    """Canonical stories as five tables: stories, validation_results, entities, claims, relationships.

    Ids are hashes of the story and the row's place, so a story that comes again
    gives the same rows. ``canonical_data`` keeps each object as JSON.
    """

    def child(name: str, columns: dict[str, str]) -> DataFrame:
        rows = stories.select("story_id", F.posexplode(name).alias("place", "x"))
        made = [F.col(f"x.{field}").alias(out) for out, field in columns.items()]
        return rows.select(F.sha2(F.concat_ws("/", F.lit(name), "story_id", "place"), 256).alias("id"), "story_id", *made, F.to_json("x").alias("canonical_data"))

    none = F.lit("[]")
    return {
        "stories": stories.select("story_id", *STORY, F.lit(True).alias("is_validated"), "quality_score", F.coalesce("ready_for_graph", F.lit(False)).alias("ready_for_graph"), F.to_json(F.struct(*STORY, "entities", "claims", "relationships")).alias("canonical_data")),
        "validation_results": stories.select(
            F.sha2(F.concat_ws("/", F.lit("validation"), "story_id", "extraction_version"), 256).alias("id"), "story_id", F.col("extraction_version").alias("story_version"), "quality_score",
            F.coalesce("ready_for_graph", F.lit(False)).alias("ready_for_graph"), F.coalesce(F.to_json("errors"), none).alias("validation_errors"), F.coalesce(F.to_json("warnings"), none).alias("validation_warnings"),
        ),
        "entities": child("entities", {"name": "name", "type": "type", "role": "role", "confidence": "confidence"}),
        "claims": child("claims", {"text": "text", "claim_type": "claim_type", "confidence": "confidence"}),
        "relationships": child("relationships", {"source_entity_id": "source", "target_entity_id": "target", "relationship_type": "relationship_type", "confidence": "confidence"}),
    }


def extract(df: DataFrame, text: str, extractor: Callable[[pd.Series], pd.Series], schema: str) -> DataFrame:
    """Run an extractor (texts -> items) over Arrow batches and estimate its usage; the interface behind which a model call stands.

    Adds ``items`` and ``input_tokens``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(items=extractor(batch[text]))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, items {schema}").withColumn("input_tokens", token_estimate(F.col(text)))


def lexicon(df: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """The offline extractor: (row, term, kind) for each word of the lexicon (term, kind) in a text; a join, no Python."""
    words = df.select("*", F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))).alias("term"))
    return small_join(words, terms, "term")


def hash_embedding(df: DataFrame, text: str, keys: list[str], dim: int = 64, kind: str = "float") -> DataFrame:
    """(keys, vector, dimension, model): signed word hashes summed into ``dim`` places and scaled to length 1.

    The offline embedding: native, stable, linear in the words. A row's words
    are counted by place before they meet. Texts without words have a zero vector.
    """
    each = df.select(*keys, F.explode(words(F.lower(text))).alias("_w"))
    hashed = F.conv(F.substring(F.md5(F.col("_w")), 1, 8), 16, 10).cast("long")
    sums = each.withColumn("_h", hashed).groupBy(*keys, F.pmod("_h", F.lit(dim)).cast("int").alias("_i")).agg(F.sum(F.when(F.floor(F.col("_h") / dim) % 2 == 0, 1.0).otherwise(-1.0)).alias("_v"))
    maps = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_v"))).alias("_m"), F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("_norm"))
    joined = df.select(*keys).join(maps, keys, "left")
    place = lambda i: F.coalesce(F.try_divide(F.try_element_at("_m", i), F.col("_norm")), F.lit(0.0)).cast(kind)
    return joined.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), place).alias("vector"), F.lit(dim).alias("dimension"), F.lit(f"hash-{dim}").alias("model"))
