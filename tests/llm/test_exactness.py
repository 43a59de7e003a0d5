"""Models and edge cases of the training-data operators against plain versions."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import common, op01_importance, op02_ngram_join, op05_suffix_dedup, op06_packing, op08_quality_rules, op10_warc
from skein.llm.words import mix64, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_overlaps_of_sparse_rows():
    draw = np.random.default_rng(4)
    pool = mix64(np.arange(400, dtype=np.uint64))
    rows = [draw.choice(pool, int(n), replace=False) for n in draw.integers(0, 300, 30)]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(30), np.arange(30)))
    true = np.array([len(set(rows[i].tolist()) & set(rows[j].tolist())) for i, j in zip(a, b)])
    for off in (0, 1):
        need = true + off
        assert (op02_ngram_join.overlaps(rows, a, b, need) == (off == 0)).all()
    assert len(op02_ngram_join.overlaps([], a[:0], b[:0], true[:0])) == 0


def test_ngram_join_at_the_threshold(spark):
    """A pair with overlap of exactly 80 of 100 shingles links, one with a shingle less doesn't."""
    words = [f"w{i}" for i in range(94)]  # 90 shingles
    first = words + [f"a{i}" for i in range(4)]
    inside = " ".join(words[:84] + [f"b{i}" for i in range(10)])  # 80 shared, 10 others
    texts = [" ".join(words), inside, " ".join(first), " ".join(words[:83] + [f"c{i}" for i in range(11)])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    linked = {(i, j) for i in range(4) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert (1, 0) in linked and (3, 0) not in linked
    got = {r["doc_id"]: r["component_id"] for r in op02_ngram_join.join(df).select("_row.doc_id", "component_id").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3}


def test_ngram_join_in_parts(spark, monkeypatch):
    """Long lists in parts, salted hubs and the last round block by block lose no link."""
    import random

    for name, value in {"PART": 16, "BLOCK_ROWS": 8, "HUB_PAIRS": 5, "SHORT": 4, "ROUNDS": 2}.items():
        monkeypatch.setattr(op02_ngram_join, name, value)
    chance = random.Random(5)
    centres = [[f"{c}{i}" for i in range(120)] for c in "xyz"]
    shared = [f"s{i}" for i in range(40)]
    texts = []
    for k in range(150):
        copy = shared + centres[k % 3] if k % 5 else centres[k % 3] + shared
        copy = list(copy)
        for i in chance.sample(range(len(copy)), chance.choice([0, 1, 2, 3])):
            copy[i] = f"q{chance.randrange(10**9)}"
        texts.append(" ".join(copy))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    comp = list(range(len(sets)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = sorted((root(i), root(j)))
                comp[y] = x
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in op02_ngram_join.join(df).select("_row.doc_id", "component_id").collect()}
    assert got == {i: root(i) for i in range(len(sets))}


def test_keep_one_with_clashing_names(spark):
    rows = [(1, "a b c d e f", 5, "x", 7), (2, "a b c d e f", 6, "y", 8), (3, None, 9, "z", 1), (3, None, 9, "z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _h int, _key string, k long")
    kept = op02_ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[0], rows[2]], key=repr)


def test_suffix_dedup_of_the_text_alone(spark):
    draw = np.random.default_rng(9)
    text = "".join(chr(97 + x) for x in draw.integers(0, 26, 700))
    df = spark.createDataFrame([(text,), ("x" + text[:450],), (None,)], "text string")
    got = sorted(r["text"] for r in op05_suffix_dedup.strip_repeats(df).collect())
    assert got == sorted(["", "x", text[450:]])


def test_repeated_windows_of_a_very_long_text(spark):
    """A million words: places and hashes don't share bits."""
    draw = np.random.default_rng(6)
    w = [f"w{x}" for x in draw.integers(0, 3000, 1_000_000)]
    count = Counter(zip(w, w[1:], w[2:]))
    seen = set()
    for i in range(len(w) - 2):
        if count[w[i], w[i + 1], w[i + 2]] > 1:
            seen |= {i, i + 1, i + 2}
    df = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
    assert op08_quality_rules.measures(df).first()["n_repeat_words"] == len(seen)


@pytest.mark.parametrize("spare", [0, 40, 52, 60])
def test_repeated_windows_whose_short_hashes_clash(spark, spare):
    draw = np.random.default_rng(spare)
    texts = [" ".join(f"w{x}" for x in draw.integers(0, k, 400)) for k in (2, 5, 8, 20, 1000)] + ["a b c", "a b c d", "", "a a a a a"]
    want = []
    for t in texts:
        w = t.split()
        count = Counter(zip(w, w[1:], w[2:]))
        want.append(len({j for i in range(len(w) - 2) if count[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in op08_quality_rules.measures(df, spare_bits=spare).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_expectation_maximisation(spark):
    """The model and the posterior are those of a plain version of the same steps."""
    draw = np.random.default_rng(8)
    n, rules = 400, op08_quality_rules.RULES
    good = draw.random(n) < 0.7
    votes = [[int(draw.choice([-1, 0, 1], p=(0.05, 0.2, 0.75) if g else (0.5, 0.2, 0.3))) for _ in rules] for g in good]
    model = {"prior": op08_quality_rules.PRIOR}
    for i in range(len(rules)):
        for y, start in op08_quality_rules.START.items():
            model |= {(i, y, v): start[v + 1] for v in (-1, 0, 1)}

    def posterior(m, row):
        odds = math.log(m["prior"] / (1 - m["prior"])) + sum(math.log(m[i, 1, v] / m[i, 0, v]) for i, v in enumerate(row))
        return 1 / (1 + math.exp(-odds))

    for _ in range(op08_quality_rules.ROUNDS):
        p = [posterior(model, row) for row in votes]
        new = {"prior": min(0.999, max(0.001, sum(p) / n))}
        for i in range(len(rules)):
            for v in (-1, 0, 1):
                new[i, 1, v] = (sum(q for q, row in zip(p, votes) if row[i] == v) + 1) / (sum(p) + 3)
                new[i, 0, v] = (sum(1 - q for q, row in zip(p, votes) if row[i] == v) + 1) / (n - sum(p) + 3)
        moved = max(abs(new[k] - model[k]) for k in model)
        model = new
        if moved < 1e-4:
            break
    df = spark.createDataFrame([(i, v) for i, v in enumerate(votes)], "id long, votes array<int>")
    got = op08_quality_rules.fit(df.select("votes"))
    assert got.keys() == model.keys() and all(abs(got[k] - model[k]) < 1e-9 for k in model)
    scored = {r["id"]: r["p"] for r in df.select("id", op08_quality_rules.posterior(got, len(rules)).alias("p")).collect()}
    assert all(abs(scored[i] - posterior(model, row)) < 1e-9 for i, row in enumerate(votes))
    assert np.mean([(scored[i] > 0.5) == g for i, g in enumerate(good)]) > 0.95


def test_importance_weights(spark):
    """log_ratio and log_weight are those of plain models over hashed words and pairs."""
    texts = {1: "the cat sat on the mat", 2: "The dog sat", 3: "zz yy xx zz yy", 4: None, 5: " \n", 6: "cat"}
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")

    def grams(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        w = word_hashes(raw, np.array([0, len(raw)]))[0]
        pairs = mix64(w[:-1] * np.uint64(3) + w[1:]) if len(w) > 1 else w[:0]
        return (np.concatenate([w, pairs]) % np.uint64(op01_importance.BUCKETS)).astype(int).tolist()

    raw = Counter(g for t in texts.values() for g in grams(t))
    target = Counter(g for k in (1, 2) for g in grams(texts[k]))
    n = op01_importance.BUCKETS

    def ratio(g):
        return math.log((target[g] + 1) / (sum(target.values()) + n)) - math.log((raw[g] + 1) / (sum(raw.values()) + n))

    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in op01_importance.resample(df, labels, keep=0.5, scale=200.0).select("_row.doc_id", "n_grams", "log_ratio", "log_weight", "gumbel").collect():
        own = grams(texts[r["doc_id"]])
        assert r["n_grams"] == len(own)
        assert r["log_ratio"] == pytest.approx(sum(map(ratio, own)))
        assert r["log_weight"] == pytest.approx(200.0 * sum(map(ratio, own)) / len(own) if own else -1e9)
        assert r["gumbel"] != r["log_weight"]


def test_packing_keeps_copies_apart(spark):
    rows = [(i, f"text number {i} of some words", "s") for i in range(60) for _ in range(3)]
    pieces = op06_packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), group_tokens=300).select("doc_id", F.shiftright("sequence_id", 32).alias("g")).distinct().groupBy("doc_id").count()
    assert pieces.filter("count > 1").count() > 30


def test_packing_to_given_targets(spark):
    rows = [(i, "some words of a text " * 40, "ab"[i % 2]) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = op06_packing.pack(df, group_tokens=10**9, targets={"a": 3.0, "b": 1.0}).collect()
    windows = {}
    for p in pieces:
        windows.setdefault(p["sequence_id"], Counter())[p["source"]] += p["length"]
    # the first group owes nothing yet; later ones also make good what the sources could not give before
    g = min(s >> 32 for s in windows)
    own = [windows[s] for s in sorted(windows) if s >> 32 == g]
    first = own[: max(1, len(own) // 4)]
    share = sum(w["a"] for w in first) / sum(sum(w.values()) for w in first)
    assert abs(share - 0.75) < 0.1
    tokens = {p["doc_id"]: p["doc_tokens"] for p in pieces}
    assert sum(p["length"] for p in pieces) == sum(tokens.values())


def test_warc_shards_by_exact_quantiles(spark, tmp_path):
    """An outlying id, a hot id and rows without id don't put the rest into one shard; the bytes don't depend on partitions."""
    rows = [(i, f"u{i}", f"page {i} " * 20) for i in range(200)] + [(10**15, "far", "far " * 40)] + [(7, "hot", f"hot {i} " * 20) for i in range(100)] + [(None, f"n{i}", f"none {i} " * 20) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = op10_warc.write_warc(df, f"file://{tmp_path}/a", shard_bytes=2000).collect()
    op10_warc.write_warc(df.repartition(3, "html"), f"file://{tmp_path}/b", shard_bytes=2000)
    sizes = Counter()
    for f in files:
        sizes[f["shard"]] += f["records"]
        assert (tmp_path / "a" / f["name"]).read_bytes() == (tmp_path / "b" / f["name"]).read_bytes()
    assert len(sizes) > 20 and max(sizes.values()) < 40
    back = op10_warc.read_warc(spark, f"file://{tmp_path}/a")
    assert Counter((r["page_id"], r["url"], bytes(r["payload"]).decode()) for r in back.collect()) == Counter(rows)


def test_scope_drops_its_own_tables_alone(spark):
    df = spark.range(10)
    with common.scope(spark, "one") as one:
        inside = common.cut(df)
        table = common.clustered(df.withColumn("v", F.lit(1)), "id", "t")
    outside = common.cut(df)
    assert inside.count() == table.count() == outside.count() == 10
    one.drop()
    assert outside.count() == 10
    with pytest.raises(Exception):
        spark.read.parquet(one.folder)


def test_sum_before(spark):
    rows = [(i, "ab"[i % 2], i + 1) for i in range(50)]
    df = spark.createDataFrame(rows, "g long, s string, n long")
    got = {r["g"]: r["x"] for r in common.sum_before(df, "n", "g", "x", chunk=7).collect()}
    assert got == {g: sum(n for h, _, n in rows if h < g) for g, _, _ in rows}
    got = {r["g"]: r["x"] for r in common.sum_before(df, "n", "g", "x", by="s", chunk=7).collect()}
    assert got == {g: sum(n for h, t, n in rows if h < g and t == s) for g, s, _ in rows}


def test_packing_asks_once(monkeypatch):
    """Ids of words are those of whole texts, also when little is remembered; the model is asked once for a word, whatever its case and what follows it."""
    from skein.llm import op06_packing as op

    encoder = op._Known(op.vocabulary_path(), 1)
    model, asked = encoder.model, []

    class Counted:
        def tokenize(self, word):
            asked.append(word)
            return model.tokenize(word)

    encoder.model = Counted()
    texts = ["Stemmed, stemmed. STEMMED*** (stemmed) stemmed;", None, "", "  stemmed\r\n", "Éß, éß İx a\x0bb it's 'stemmed' $$$ x-1 Ⱥb", "the stemmed!"]
    want = [np.array([*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], encoder.kind).tobytes() for t in texts]
    assert encoder.encode(pa.array(["left out", *texts])[1:]) == want
    assert asked.count("stemmed") == 1
    monkeypatch.setattr(op, "REMEMBERED", 2)
    assert encoder.encode(pa.array(texts)) == want
    assert [b.num_rows for b in op._slices(pa.record_batch([pa.array(["a", "b", "c"])] * 3, names=["a", "b", "c"]))] == [3]
    monkeypatch.setattr(op, "SLICE", 2)
    cut = list(op._slices(pa.record_batch([pa.array([None, "a", "bcd", "", "e", "f", "g"])] * 3, names=["a", "b", "c"])))
    assert [b.column(2).to_pylist() for b in cut] == [[None, "a"], ["bcd"], ["", "e", "f"], ["g"]]


def test_blocks_passed_over_lose_nothing(monkeypatch):
    """The index in parts and small blocks against all scores; some blocks are passed over."""
    from skein.llm import op07_topk_search as op

    monkeypatch.setattr(op, "WIDTH", 4)
    draw = np.random.default_rng(12)
    pool = np.sort(mix64(np.arange(3000, dtype=np.uint64)))
    kinds = [pool[a : a + 900] for a in (0, 900, 1800)]  # three languages
    terms, counts = [], []
    for i in range(240):
        own = np.unique(draw.choice(kinds[i % 3], 60))
        terms.append(own)
        counts.append(draw.integers(1, 9, len(own)).astype(np.int32))
    terms[7], counts[7] = terms[0], counts[0]  # a tie
    docs, lengths = np.arange(240) * 10, np.array([c.sum() for c in counts])
    mean = lengths.mean()
    queries = list(range(0, 240, 11))
    flat = np.concatenate([terms[q] for q in queries])
    edges = np.concatenate([[0], np.cumsum([len(terms[q]) for q in queries])])
    weights = draw.random(len(flat)) + 0.1
    best = [(np.zeros(0), np.zeros(0, np.int64))] * len(queries)
    added = []
    for a in range(0, 240, 60):
        part = op.PartIndex(docs[a : a + 60], lengths[a : a + 60], terms[a : a + 60], counts[a : a + 60], mean)
        part.search(edges, flat, weights, 5, best)
        added.append(len(part.dense))
    for i, q in enumerate(queries):
        own = dict(zip(terms[q].tolist(), weights[edges[i] : edges[i + 1]]))
        scores = [sum(own[t] * w for t, w in zip(terms[d].tolist(), op._weights(counts[d].astype(float), np.full(len(counts[d]), float(lengths[d])), mean)) if t in own) for d in range(240)]
        order = sorted((d for d in range(240) if scores[d] > 0), key=lambda d: (-round(scores[d], 9), docs[d]))[:5]
        assert best[i][1].tolist() == [docs[d] for d in order]
        assert np.allclose(best[i][0], [scores[d] for d in order])
