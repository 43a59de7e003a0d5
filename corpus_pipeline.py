"""From raw documents to packed sequences: five stages, each one operator over all that the one before kept.

Quality rules reject documents; of each group of near duplicates one stays;
passages that still repeat go; sources are mixed to their target weights (a
document may be taken more than once, or in part); what is left is packed. Each
stage's result is written as Parquet and read again, so a lost executor costs a
task and not the stages before.

In every stage extra columns pass through whatever their names, and an empty
table gives an empty result. What a stage stored for itself is deleted when the
next one starts, as its result is written by then.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import op02_ngram_join, op05_suffix_dedup, op06_packing, op08_quality_rules, op09_mixing
from skein.llm.common import Scope, delete, scope, shared_dir, table

#: Bytes of a repeated passage: 99 of 100 runs of fifty words of prose are longer. The operator's own default is for whole paragraphs.
PASSAGE_BYTES = 225
#: Bytes of a minimizer's k-gram for that length.
PASSAGE_GRAM = 64

_last: list[Scope] = []


def _stage(function: Callable) -> Callable:
    """Drop what the stage before stored for itself, and keep this one's tables together."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _last:
            _last.pop().drop()
        with scope(spark, function.__name__) as own:
            _last.append(own)
            return function(spark, docs, sf_dir)

    return run_stage


def _counted(docs: DataFrame, before: DataFrame) -> DataFrame:
    """``n_chars`` follows the text, in its own type, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType)) if "n_chars" in before.columns else docs


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the voting rules keep.

    Null, empty and wordless texts fail the base rules and go. Repeated rows are
    judged alike. Very long texts are measured whole.
    """
    return op08_quality_rules.keep(docs)


@_stage
def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that with the smallest doc_id.

    Texts without words have no partner and stay. Of repeated rows one stays; a
    null doc_id counts as the largest.
    """
    return op02_ngram_join.keep_one(docs)


@_stage
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of ``PASSAGE_BYTES`` that start elsewhere too, the first occurrence included.

    No row goes: a text may become empty, and null becomes empty. Repeated rows
    are copies of each other and lose texts that are long enough.
    """
    return _counted(op05_suffix_dedup.strip_repeats(docs, length=PASSAGE_BYTES, gram=PASSAGE_GRAM), docs)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources' documents in their target shares, a row for each copy.

    Null sources are one source, the last. Texts without words are taken with
    their source's passes. Repeated rows are documents of their own.
    """
    return _counted(op09_mixing.mixed_documents(docs), docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens.

    Null and empty texts have their end id alone. Copies that mixing made are
    dealt to places of their own.
    """
    pieces = op06_packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_dedup", suffix_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Estimation, components and tokenisation are beyond SQL; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result goes when the next one's is stored."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    while _last:
        _last.pop().drop()
    return docs
