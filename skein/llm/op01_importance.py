"""Quality classifier: importance resampling of documents towards a target.

Two generative models over hashed n-grams (words and word pairs, in a fixed
number of buckets): one of target text, one of all raw text. A document's log
importance weight is the mean log ratio of its n-grams, so that the models, not
length, decide, in units that make the weights' spread a few times that of the
noise. Gumbel top-k samples without replacement: weights plus seeded Gumbel
noise, the k largest kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import cut, fields, packed, quoted, ship, small_join, table, unit
from skein.llm.words import chunks, mix64, word_hashes

BUCKETS = 1 << 16
#: Labelled rows that the target model is fitted on at most, those of least hash.
FIT_ROWS = 20_000
#: Spread of the weights against that of the noise, whose standard deviation is pi / sqrt(6): far more, and the sample is the top-k; far less, and it is chance.
SPREAD = 2.0
SEED = 1


def _grams(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every word and word pair, text by text; number for each text)."""
    words, counts = word_hashes(raw, offsets)
    doc = np.repeat(np.arange(len(counts)), counts)
    pairs = mix64(words[:-1] * np.uint64(3) + words[1:]) if len(words) > 1 else words[:0]
    inside = doc[1:] == doc[:-1] if len(words) > 1 else np.zeros(0, bool)
    grams = np.concatenate([words, pairs[inside]])
    owner = np.concatenate([doc, doc[1:][inside] if len(words) > 1 else doc[:0]])
    order = np.argsort(owner, kind="stable")
    return (grams[order] % np.uint64(buckets)).astype(np.int64), np.bincount(owner, minlength=len(counts))


def gram_counts(docs: DataFrame, text: str = "text", weight: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): n-gram counts over all documents, and over those with ``weight`` true."""

    def run(batches):
        raw_sum, target_sum = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            chosen = np.array(batch.column(1).fill_null(False).to_pylist(), bool)
            for first, raw, offsets in chunks(batch.column(0)):
                grams, counts = _grams(raw, offsets, buckets)
                raw_sum += np.bincount(grams, minlength=buckets)
                target_sum += np.bincount(grams[np.repeat(chosen[first : first + len(counts)], counts)], minlength=buckets)
        held = np.flatnonzero(raw_sum)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(raw_sum[held]), pa.array(target_sum[held])], names=["bucket", "raw", "target"])

    ship(docs.sparkSession)
    flagged = docs.select(F.col(text).alias("text"), (F.col(weight) if weight else F.lit(False)).alias("chosen"))
    parts = flagged.mapInArrow(run, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log P(bucket | target) - log P(bucket | raw), with one count added to each; as many numbers as buckets."""
    raw, target = np.ones(buckets), np.ones(buckets)
    for row in counts.collect():  # one row a bucket at most
        raw[row["bucket"]] += row["raw"]
        target[row["bucket"]] += row["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weigh(docs: DataFrame, ratios: np.ndarray, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text in ``_row``, with n_grams, log_ratio and mean (null without words).

    log_ratio is the log of P(text | target) / P(text | raw), a sum over its
    n-grams, so it grows with length and a long text would always win or lose
    against the noise, whatever it says. mean is that of its n-grams: the models
    decide, and the noise weighs alike for short and long texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS doubles
    buckets = len(ratios)
    others = docs.select(packed(docs, text).alias("_row"), F.col(quoted(text)).alias("text"))
    kind = fields(others.schema["_row"].dataType, "n_grams long, log_ratio double, mean double")

    def run(batches):
        table_ = shared.value
        for batch in batches:
            for first, raw, offsets in chunks(batch.column(1)):
                grams, counts = _grams(raw, offsets, buckets)
                sums = np.bincount(np.repeat(np.arange(len(counts)), counts), table_[grams], minlength=len(counts)).astype(np.float64)
                mean = pa.array(sums / np.maximum(counts, 1), mask=counts == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(counts)), pa.array(counts.astype(np.int64)), pa.array(sums), mean], names=["_row", "n_grams", "log_ratio", "mean"])

    return others.mapInArrow(run, kind)


def scale_of(weighed: DataFrame, spread: float = SPREAD) -> float:
    """By what the means are multiplied, so that their standard deviation over all texts is ``spread`` times that of the noise; 1 where they don't differ."""
    deviation = weighed.agg(F.stddev_pop("mean")).first()[0]
    return spread * math.pi / math.sqrt(6) / deviation if deviation else 1.0


def top_k(rows: DataFrame, value: str, k: int, tie: str) -> DataFrame:
    """Add ``kept``: whether the row is among the k largest values, ties by ``tie`` ascending, nulls last.

    The k-th value is found by counting: each round cuts the range that holds it
    into 1024 steps, a few numbers to the driver, no sort of all rows.
    """
    low, high = rows.agg(F.min(value), F.max(value)).first()
    if low is None or k <= 0:
        return rows.withColumn("kept", F.lit(False))
    above = 0  # rows over the range
    for _ in range(8):
        step = (high - low) / 1024
        if step <= 0:
            break
        at = F.least(F.lit(1023), F.floor((F.col(value) - low) / step)).cast("int")
        count = dict(rows.filter((F.col(value) >= low) & (F.col(value) <= high)).groupBy(at.alias("at")).agg(F.count("*")).collect())
        for b in range(1023, -1, -1):
            if above + count.get(b, 0) >= k or b == 0:
                break
            above += count.get(b, 0)
        if count.get(b, 0) <= 1:
            low, high = low + b * step, low + (b + 1) * step if b < 1023 else high
            break
        low, high = low + b * step, low + (b + 1) * step if b < 1023 else high
    # the few rows around the k-th value are ordered themselves
    near = rows.filter((F.col(value) >= low - 1e-9) & (F.col(value) <= high + 1e-9))
    over = rows.filter(F.col(value) > high + 1e-9).count()
    edge = near.orderBy(F.col(value).desc(), F.col(tie).asc_nulls_last()).limit(max(0, k - over)).select(value, tie).tail(1)
    if not edge:
        return rows.withColumn("kept", F.col(value) > F.lit(high + 1e-9))
    last = edge[0]
    tied = (F.col(value) == F.lit(last[0])) & (F.lit(last[1] is None) | F.coalesce(F.col(tie) <= F.lit(last[1]), F.lit(False)))
    return rows.withColumn("kept", (F.col(value) > F.lit(last[0])) | tied)


def resample(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", keep: float | None = None, fit_rows: int = FIT_ROWS, seed: int = SEED, scale: float | None = None) -> DataFrame:
    """``_row`` (all columns but the text), n_grams, log_ratio, log_weight, gumbel, kept.

    Target text: documents labelled good and not toxic, at most ``fit_rows`` of
    them by least hash. Raw text: all documents. ``keep`` is the share to keep;
    left out, it is the share of good ones among the labelled. The weights' scale
    comes from all of them, unless it is given. Null, empty and
    wordless texts weigh least. Repeated rows share their noise and are kept or
    not alike, but for the last place. Without labels nothing is known: the
    ratio is flat and noise decides. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    share = labels.agg(F.avg(F.coalesce(good, F.lit(False)).cast("int"))).first()[0]
    fit = labels.filter(good).select(F.col("doc_id").alias("_id")).distinct().orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(fit_rows).withColumn("_target", F.lit(True))
    fit = cut(fit, "target")
    marked = small_join(docs.select(F.col(quoted(key)).alias("_key"), F.col(quoted(text)).alias("text")), fit, F.col("_key") == F.col("_id"), "left", rows=fit_rows)
    ratios = log_ratios(gram_counts(marked, "text", "_target"))
    name = F.col("_row")[key]
    weighed = cut(weigh(docs, ratios, text), "weighed")
    scale = scale_of(weighed) if scale is None else scale
    noise = -F.log(-F.log(unit(name, seed=seed)))
    weighed = weighed.withColumn("log_weight", F.coalesce(F.col("mean") * scale, F.lit(-1e9))).drop("mean")
    weighed = weighed.withColumn("gumbel", F.col("log_weight") + noise).withColumn("_tie", name)
    n = weighed.count()
    k = round(n * (share if keep is None and share is not None else 1.0 if keep is None else keep))
    return top_k(weighed, "gumbel", k, "_tie").drop("_tie")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = resample(docs, table(spark, sf_dir, "labels"))
    return out.select(F.col("_row.doc_id").alias("doc_id"), "n_grams", F.round("log_ratio", 6).alias("log_ratio"), F.round("log_weight", 6).alias("log_weight"), F.round("gumbel", 6).alias("gumbel"), "kept")
