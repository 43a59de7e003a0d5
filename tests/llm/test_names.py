"""Columns of any name pass every stage; sampling follows the ratio; shards and thresholds follow the size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import op01_importance, op02_ngram_join, op04_url_filter, op09_mixing

ODD = ("a.b", "x`y", "_row", "_doc", "_text", "_hash", "_key", "_body", "_words", "uid", "seg", "kept", "size", "take", "shard", "epoch", "place", "n_words", "votes", "tokens", "ids", "_id", "rank")


@pytest.fixture(scope="module")
def docs(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet").limit(120)
    return df.select("*", *[F.concat(F.lit(name), F.col("doc_id").cast("string")).alias(name) for name in ODD]).repartition(3).cache()


@pytest.mark.parametrize("stage", [f for name, f in corpus_pipeline.STAGES if name != "packing"], ids=[name for name, _ in corpus_pipeline.STAGES if name != "packing"])
def test_stages_keep_columns_of_any_name(spark, docs, data, stage):
    out = stage(spark, docs, data)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[name] == f"{name}{r['doc_id']}" for r in rows for name in ODD)


def test_packing_takes_columns_of_any_name(spark, docs, data):
    assert dict(corpus_pipeline.STAGES)["packing"](spark, docs, data).count() >= docs.count()


def test_other_operators_keep_columns_of_any_name(spark, docs, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    out = op01_importance.resample(docs, labels, keep=0.5)
    assert all(r["_row"]["a.b"] == f"a.b{r['_row']['doc_id']}" for r in out.collect())
    linked = op02_ngram_join.join(docs)
    assert all(r["_row"]["x`y"] == f"x`y{r['_row']['doc_id']}" for r in linked.collect())


def test_inclusion_follows_the_ratio(spark):
    """Over many seeds a text is kept the more often the larger its weight, and none always or never."""
    rng = np.random.default_rng(0)
    good, bad = [f"good{i}" for i in range(40)], [f"bad{i}" for i in range(40)]
    share = np.linspace(0, 1, 60)
    texts = [(i, " ".join(rng.choice(good if rng.random() < p else bad) for _ in range(60))) for i, p in enumerate(share)]
    df = spark.createDataFrame(texts, "doc_id long, text string").cache()
    labels = spark.createDataFrame([(i, int(p > 0.7), 0) for i, p in enumerate(share)], "doc_id long, quality int, toxic int")
    rows = op01_importance.resample(df, labels, keep=0.3).collect()
    weight = np.array([r["log_weight"] for r in sorted(rows, key=lambda r: r["_row"]["doc_id"])])
    assert np.std(weight) == pytest.approx(op01_importance.SPREAD * np.pi / np.sqrt(6), rel=1e-6)
    seeds = 300
    noise = np.array([[r[0] for r in spark.range(60).select(-F.log(-F.log(op01_importance.unit(F.col("id"), seed=s)))).collect()] for s in range(3)])
    assert abs(noise.mean() - 0.5772) < 0.3  # Gumbel's mean
    kept = np.zeros(60)
    for s in range(seeds):
        score = weight + np.random.default_rng(s).gumbel(size=60)
        kept[np.argsort(-score)[:18]] += 1
    plain = np.argsort(-weight)[:18]
    assert 0 < kept[plain].min() < seeds and kept[np.setdiff1d(np.arange(60), plain)].sum() > seeds  # a sample, not the plain top
    assert np.corrcoef(np.argsort(np.argsort(weight)), np.argsort(np.argsort(kept)))[0, 1] > 0.9
    first = {r["_row"]["doc_id"] for r in rows if r["kept"]}
    second = {r["_row"]["doc_id"] for r in op01_importance.resample(df, labels, keep=0.3, seed=77).collect() if r["kept"]}
    assert len(first) == len(second) == 18 and first != second and len(first & second) > 6


def test_shards_follow_the_words():
    assert op09_mixing.shards_of(0) == op09_mixing.SHARDS
    assert op09_mixing.shards_of(10**13) == 156_250


@pytest.mark.parametrize("many", [3, 300])
def test_verdicts_do_not_depend_on_the_number_of_hosts(spark, many):
    """A host that links to a blocked one is blocked, however many other hosts there are."""
    pages = [(1, "http://x.com/de/a", None), (2, "http://bad.net/a", '<a href="http://x.com/de/a">'), (3, "http://far.net/", '<a href="http://bad.net/a">')]
    pages += [(10 + i, f"http://h{i}.net/a", f'<a href="http://h{i + 1}.net/">') for i in range(many)]
    got = {r["page_id"]: r["verdict"] for r in op04_url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == got[3] == "block" and all(got[10 + i] == "allow" for i in range(many))
