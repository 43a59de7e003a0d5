"""The training-data operators against plain versions on small fixtures with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import op01_importance, op02_ngram_join, op03_chat, op04_url_filter, op05_suffix_dedup, op06_packing, op07_topk_search, op08_quality_rules, op09_mixing, op10_warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(word):
    return re.sub("[A-Z]", lambda m: m[0].lower(), word)


@pytest.fixture(scope="module")
def rows(spark, data):
    """Documents with nulls, empty and long texts, ties, repeated rows and copies planted among real ones."""
    found = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()]
    base = found[0][1]
    words = base.split(" ")
    near = " ".join(w if i % 97 else w + "x" for i, w in enumerate(words))
    odd = [
        (1000, None, "en", "src1", 0), (1001, "", "en", None, 0), (1002, "   \n\t", None, "src1", 5), (1003, "one two", "en", "src2", 7),
        (1004, "ONE  two", "en", "src2", 8), (1005, base, "en", "src3", 1), (1005, base, "en", "src3", 1), (1006, near, "en", "src4", 1),
        (1007, "word " * 30_000, "en", "src0", 1), (1008, "éß 中 " * 90, "fr", "src0", 1), (None, "a b c d e f", "en", "src0", 1),
        (1009, "x" * 900, "en", "src5", 1), (1010, base[:700] + "tail", "en", "src5", 1), (1011, "<|endoftext|> don't İIΣ ́a", "en", "src5", 1),
    ]
    return found + odd


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumn("rank", F.lit(1)).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def test_ngram_join(rows, docs, empty):
    sets = []
    for key, text, *_ in rows:
        w = [lower(x) for x in WORD.findall(text or "")]
        sets.append((key, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(sets):
        least.setdefault(root(i), []).append(key)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    expected = Counter((key, len(s), least[root(i)]) for i, (key, s) in enumerate(sets))
    got = op02_ngram_join.join(docs).select("_row.doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == expected
    assert op02_ngram_join.join(empty).count() == 0
    kept = op02_ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.filter("doc_id = 1005").count() + kept.filter("doc_id = 0").count() == 1


def test_ngram_join_large_group(spark):
    """A group of copies that differ from a centre, beyond the length that gives all pairs, with bystanders."""
    import random

    chance = random.Random(3)
    centre = [f"w{i}" for i in range(200)]
    texts = [" ".join(centre)]
    for _ in range(60):
        copy = list(centre)
        for i in chance.sample(range(200), chance.choice([1, 2, 3, 4, 5])):
            copy[i] = f"z{chance.randrange(10**9)}"
        texts.append(" ".join(copy))
    for _ in range(20):
        texts.append(" ".join(centre[:40] + [f"q{chance.randrange(10**9)}" for _ in range(160)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for t in texts]
    comp = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for i in range(len(sets)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    got = {r["doc_id"]: r["component_id"] for r in op02_ngram_join.join(df).select("_row.doc_id", "component_id").collect()}
    assert got == dict(enumerate(comp))


def repeats(texts, length):
    bodies = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        end = 0
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                for j in range(max(i, end), i + length):
                    gone[j] = 1
                end = i + length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_suffix_dedup(rows, docs, empty):
    small = [r for r in rows if len(r[1] or "") < 20_000]
    got = op05_suffix_dedup.dedup(docs.filter("text is null or length(text) < 20000")).select("_row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert Counter(map(tuple, got.collect())) == Counter((r[0], *x) for r, x in zip(small, repeats([r[1] for r in small], 400)))
    assert op05_suffix_dedup.dedup(empty).count() == 0
    assert op05_suffix_dedup.strip_repeats(docs).columns == docs.columns


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.choice(list(b"aab"), size=int(n))) for n in rng.integers(20, 60, 40)] + [b"a" * 50, b"ab" * 25]
    groups = np.arange(42) // 7
    array, common, seg, begin = op05_suffix_dedup.suffix_array(texts, groups, 12)
    t = b"".join(texts)
    keys = [(groups[seg[p]], t[p : p + 12]) for p in array]
    assert keys == sorted(keys)
    assert len(array) == sum(len(x) - 11 for x in texts)
    for i in range(1, len(array)):
        a, b = keys[i - 1], keys[i]
        same = next((k for k in range(12) if a[1][k] != b[1][k]), 12) if a[0] == b[0] else 0
        assert common[i] == same


def test_packing(rows, docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(op06_packing.vocabulary_path())
    pieces = op06_packing.pack(docs, group_tokens=5000).collect()
    by = {}
    for p in pieces:
        by.setdefault(p["doc_id"], []).append(p)
    for key, text in {r[0]: r[1] for r in rows}.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted((p["start"], bytes(p["ids"]), p["doc_tokens"]) for p in by[key])
        copies = sum(r[0] == key for r in rows)
        assert sum(len(x[1]) for x in own) == copies * ids.nbytes
        assert all(x[1] == ids[x[0] : x[0] + len(x[1]) // 4].tobytes() and x[2] == len(ids) for x in own)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    assert op06_packing.pack(empty).count() == 0


def test_fill_meets_shares():
    lengths = {"a": 70_000, "b": 20_000, "c": 10_000}
    shares = {s: n / 100_000 for s, n in lengths.items()}
    served = Counter()
    for w, s, n in op06_packing.fill(lengths, {}, shares):
        served[s] += n
        if w == 20:
            break
    total = sum(served.values())
    assert all(abs(served[s] / total - shares[s]) < 0.05 for s in shares)


def test_suffix_dedup_of_crowded_minimizers(spark, monkeypatch):
    """A line shorter than the length in very many texts: all its segments differ, no task sorts them together, and none is lost."""
    op, length, crowd = op05_suffix_dedup, 60, 8
    draw = np.random.default_rng(3)

    def noise(n):
        return "".join(chr(97 + x) for x in draw.integers(0, 26, n))

    line, tail = noise(45), noise(30)
    texts = [noise(40 + i % 7) + line + noise(50) for i in range(60)] + [noise(30) + line + tail + noise(20 + i) for i in range(5)]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    want = {}
    for k, t in enumerate(texts):
        gone = {j for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1 for j in range(i, i + length)}
        want[k] = "".join(c for j, c in enumerate(t) if j not in gone)
    assert sum(len(t) for t in texts[60:]) - sum(len(want[k]) for k in range(60, 65)) >= 5 * 75
    plain = op._mark

    def held(size):
        def run(batches):
            batches = list(batches)
            groups = Counter((h, salt) for b in batches for h, salt in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            assert max(groups.values(), default=0) <= crowd
            return plain(size)(iter(batches))

        return run

    monkeypatch.setattr(op, "_mark", held)
    monkeypatch.setattr(op, "CROWD", crowd, raising=False)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: bytes(r[1]).decode() for r in op.dedup(docs, length=length, gram=20).select("_row.doc_id", "kept").collect()}
    assert got == want


def test_search(rows, docs, empty):
    texts = {r[0]: r[1] for r in rows if r[0] is not None and r[0] != 1005}
    own = docs.filter("doc_id is not null and doc_id <> 1005")
    terms = {k: Counter(lower(w) for w in WORD.findall(t or "")) for k, t in texts.items()}
    size = {k: sum(c.values()) for k, c in terms.items()}
    mean = sum(size.values()) / len(size)
    df = Counter(w for c in terms.values() for w in c)
    idf = {w: math.log(1 + (len(terms) - n + 0.5) / (n + 0.5)) for w, n in df.items()}

    def part(k, w):
        tf = terms[k][w]
        return tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size[k] / mean)) * idf[w] if tf else 0.0

    got = {}
    for r in op07_topk_search.search(own, F.col("doc") % 10 == 0, query_terms=10_000).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["doc"], r["score"]))
    for q in (k for k in texts if k % 10 == 0 and size[k]):
        best = sorted((-sum(part(k, w) for w in terms[q]), k) for k in texts)[:10]
        best = [(s, k) for s, k in best if s < 0]
        assert np.allclose([x[2] for x in sorted(got[q])], [-s for s, _ in best])
    assert op07_topk_search.search(empty, F.col("doc") % 10 == 0).count() == 0


def test_search_whole_queries(spark, monkeypatch):
    """With the defaults of op7 every distinct term of a query counts, in several passes too, and equal scores rank by id."""
    draw = np.random.default_rng(7)
    texts = {i: " ".join(f"w{x}" for x in np.minimum(draw.zipf(1.2, 40 + 6 * (i % 50)), 3000)) for i in range(300)}
    texts |= {300 + i: texts[0] for i in range(15)} | {320: "w1", 321: "only here"}
    terms = {k: Counter(t.split()) for k, t in texts.items()}
    # a repeated row is a document of its own, but as a query one
    rows = [*texts.items(), (0, texts[0])]
    held = [(k, terms[k]) for k, _ in rows]
    size = {k: sum(c.values()) for k, c in terms.items()}
    mean = sum(size[k] for k, _ in rows) / len(rows)
    df = Counter(w for _, c in held for w in c)
    idf = {w: math.log(1 + (len(rows) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    asked = [k for k in texts if k % 20 == 0]
    assert max(len(terms[k]) for k in asked) > 64
    monkeypatch.setattr(op07_topk_search, "TERM_BLOCK", 300, raising=False)
    got = {}
    for r in op07_topk_search.search(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc") % 20 == 0).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["doc"], r["score"]))
    assert sorted(got) == asked
    for q in asked:
        scored = [(round(-sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[k] / mean)) for w in sorted(terms[q]) if w in c), 9), k) for k, c in held]
        best = sorted(x for x in scored if x[0] < 0)[:10]
        assert [x[0] for x in sorted(got[q])] == list(range(1, len(best) + 1))
        assert np.allclose([x[2] for x in sorted(got[q])], [-s for s, _ in best])
        assert [x[1] for x in sorted(got[q])] == [k for _, k in best]


def test_search_few_documents(spark):
    """Where so few documents are indexed that all their terms are dense, no posting adds to the sums."""
    texts = {0: "a b c", 1: "a b", 2: "c d d", 3: "e", 4: None}
    found = op07_topk_search.search(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), F.col("doc") % 2 == 0).collect()
    terms = {k: Counter((t or "").split()) for k, t in texts.items()}
    size = {k: sum(c.values()) for k, c in terms.items()}
    mean = sum(size.values()) / len(size)
    df = Counter(w for c in terms.values() for w in c)
    idf = {w: math.log(1 + (len(terms) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    want = {}
    for q in (0, 2):
        scored = [(-sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[k] / mean)) for w in terms[q] if w in c), k) for k, c in terms.items()]
        want |= {(q, i): (k, -x) for i, (x, k) in enumerate(sorted(x for x in scored if x[0] < 0), 1)}
    got = {(r["query"], r["rank"]): (r["doc"], r["score"]) for r in found}
    assert {k: d for k, (d, _) in got.items()} == {k: d for k, (d, _) in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_quality_rules(rows, docs, empty):
    scored = op08_quality_rules.measures(docs).collect()
    by = {(r["doc_id"], r["text"]): r for r in scored}
    for key, text, *_ in rows:
        w = WORD.findall(text or "")
        count = Counter(zip(w, w[1:], w[2:]))
        seen = set()
        for i in range(len(w) - 2):
            if count[w[i], w[i + 1], w[i + 2]] > 1:
                seen |= {i, i + 1, i + 2}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        r = by[key, text]
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(seen))
    kept = op08_quality_rules.keep(docs)
    assert kept.columns == docs.columns
    assert kept.filter("text is null or doc_id in (1001, 1002, 1003, 1007)").count() == 0
    assert op08_quality_rules.keep(empty).count() == 0


def test_quality_rules_reject_junk(spark, data):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = op08_quality_rules.keep(docs).select("doc_id").withColumn("kept", F.lit(True))
    rates = {r[0]: r[1] for r in docs.join(labels, "doc_id").join(kept, "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(False)).cast("int"))).collect()}
    assert rates[0] < 0.1 and rates[1] > 0.9


def test_mixing(rows, docs, empty):
    sized = docs.select("doc_id", "source", op09_mixing.word_count(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("uid")).cache()
    mixed, plan = op09_mixing.mix(sized, block_words=500)
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    target = {s: 3 * sizes[s] if s in capped else level * weight[s] for s in names}
    got = {r["source"]: r["target"] for r in plan.collect()}
    assert all(abs(got[s] - target[s]) < 1e-6 for s in names)
    taken = mixed.select("_row.uid", "_row.size", "_row.source", "take", "shard", "epoch").collect()
    by_source, by_row = Counter(), Counter()
    for r in taken:
        by_source[r["source"]] += r["take"]
        by_row[r["uid"], r["size"]] += r["take"]
    assert all(abs(by_source[s] - target[s]) <= 1 for s in names)
    assert all(n <= 3 * size for (_, size), n in by_row.items())
    assert len({(r["uid"], r["epoch"]) for r in taken}) == len(taken)
    again = op09_mixing.mix(sized, block_words=500)[0].select("_row.uid", "_row.size", "_row.source", "take", "shard", "epoch").collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, taken))
    out = op09_mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert op09_mixing.mix(empty.select("doc_id", "source", F.lit(1).alias("size")))[0].count() == 0


def test_splitting_tree(spark):
    blocks = spark.createDataFrame([("a", 100), ("b", 37), (None, 5)], "source string, blocks long")
    got = op09_mixing.splitting_tree(blocks, 5).collect()
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append((r["first"], r["last"], r["shard"]))
    for source, n in (("a", 100), ("b", 37), (None, 5)):
        at = 0
        for first, last, _ in sorted(by[source]):
            assert first == at
            at = last
        assert at == n
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["last"] - r["first"]
    assert max(sizes.values()) - min(sizes.values()) <= 2


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", None), (4, 0, "user", "hi"), (4, 1, "assistant", "yo"), (4, 2, "user", None), (5, 0, None, ""), (6, 0, "user", "hi"), (6, 300, "user", "far"), (7, None, "user", "x" * 50_000), (None, 0, "user", "lost")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(0))
    got = {r["conv_id"]: (r["turns"], r["copies"], r["text"]) for r in op03_chat.format_chats(df).collect()}
    assert set(got) == {3, 5, 6, 7, None}
    assert got[3] == (3, 2, "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n<|user|>\n<|end|>\n")
    assert got[5] == (1, 1, "<|unknown|>\n<|end|>\n")
    assert got[6][2] == "<|user|>\nhi<|end|>\n<|user|>\nfar<|end|>\n"
    assert op03_chat.format_chats(df.filter("false")).count() == 0


def test_url_filter(spark):
    pages = [(1, "http://a.org/x", '<a href="http://b.net/">'), (2, "http://b.net/y", "<A HREF=//c.net/q>"), (3, "http://c.net/", None), (4, "http://d.com/de/1", "x"), (5, "http://e.net", '<a href="http://d.com/de/">'), (6, None, ""), (7, "nourl", "z"), (8, "HTTP://Sub.Example.ORG/en/1a?x#y", "q"), (8, "HTTP://Sub.Example.ORG/en/1a?x#y", "q"), (9, "http://xorg/", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in op04_url_filter.judge(df).collect()}
    assert got[1] == ("a.org", "/x", "org/", "allow")
    assert got[2][2:] == (None, "allow") and got[3][2:] == (None, "allow")
    assert got[4][2:] == ("com/de/", "block")
    assert got[5] == ("e.net", "", None, "block")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("sub.example.org", "/en/1a", "example.org/en/1", "block")
    assert got[9][2] is None
    assert op04_url_filter.judge(df.filter("false")).count() == 0


def test_page_rank(spark):
    edges = [("a", "b", 1), ("a", "c", 3), ("b", "c", 1), ("c", "a", 2), ("c", "d", 1)]
    seeds = {"a": 0.25, "b": 0.75}
    rank = {h: seeds.get(h, 0.0) for h in "abcd"}
    out = Counter()
    for s, _, w in edges:
        out[s] += w
    for _ in range(op04_url_filter.ITERATIONS):
        going = sum(rank[h] for h in out)
        new = {h: (1 - 0.85 * going) * seeds.get(h, 0.0) for h in rank}
        for s, t, w in edges:
            new[t] += 0.85 * rank[s] * w / out[s]
        rank = new
    got = op04_url_filter.page_rank(spark.createDataFrame(edges, "src string, dst string, weight long"), spark.createDataFrame(list(seeds.items()), "host string, seed double"))
    assert {r["host"]: pytest.approx(r["rank"]) for r in got.collect()} == rank


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/x", "A" * 200), (2, None, "A" * 200), (2, None, "A" * 200), (3, "u\r\nWARC-Type: x%", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "n", "A" * 200), (7, "u", "é" * 60), (8, "u", "é" * 60), (0, "q", "B" * 150), (0, "q", "B" * 150), (9, "u", "z\r\n\r\n" * 50_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    files = op10_warc.write_warc(df, f"file://{tmp_path}/a", roll_bytes=600).collect()
    op10_warc.write_warc(df.repartition(5), f"file://{tmp_path}/b", roll_bytes=600)
    assert len(files) > 3 and sum(f["records"] for f in files) == len(pages)
    for f in files:
        data = (tmp_path / "a" / f["name"]).read_bytes()
        assert data == (tmp_path / "b" / f["name"]).read_bytes()
        assert len(data) == f["bytes"] and hashlib.sha256(data).hexdigest() == f["sha256"]
        assert zlib.decompressobj(31).decompress(data).startswith(b"WARC/1.1\r\n")
    got = Counter((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in op10_warc.read_warc(spark, f"file://{tmp_path}/a").collect())
    expected = Counter()
    for key, url, html in pages:
        body = (html or "").encode()
        same = sorted(k for k, _, h in pages if k is not None and (h or "").encode() == body)
        seen = sum(n for (k, u, *_), n in expected.items() if (k, u) == (key, url))
        again = len(body) >= 100 and key is not None and (key != same[0] or seen)
        expected[key, url, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", same[0] if again else None] += 1
    assert got == expected
    (tmp_path / "a" / "part-999999-000000.warc.gz").write_bytes(b"junk")  # not in the manifest: not read
    assert op10_warc.read_warc(spark, f"file://{tmp_path}/a").count() == len(pages)
    (tmp_path / "a" / files[0]["name"]).write_bytes(b"cut")
    with pytest.raises(Exception, match="manifest"):
        op10_warc.read_warc(spark, f"file://{tmp_path}/a").count()
    op10_warc.write_warc(df.filter("false"), f"file://{tmp_path}/c")
    assert op10_warc.read_warc(spark, f"file://{tmp_path}/c").count() == 0


def test_importance(spark, docs, empty, rows):
    labels = spark.createDataFrame([(r[0], int(i % 3 > 0), int(i % 7 == 0)) for i, r in enumerate(rows[:60])], "doc_id long, quality int, toxic int")
    out = op01_importance.resample(docs, labels, keep=0.4).select("_row.doc_id", "gumbel", "log_weight", "kept").collect()
    assert len(out) == len(rows)
    k = round(0.4 * len(rows))
    ranked = sorted(out, key=lambda r: (-r["gumbel"], r["doc_id"] is None, r["doc_id"] or 0))
    assert {r["doc_id"] for r in ranked[:k]} == {r["doc_id"] for r in out if r["kept"]}
    assert all(r["log_weight"] == -1e9 for r in out if r["doc_id"] in (1000, 1001, 1002))
    assert op01_importance.resample(empty, labels).count() == 0


def test_importance_held_out(spark):
    """Labels that the model has not seen: good texts outrank junk."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    seen = labels.filter("doc_id % 2 = 0")
    out = op01_importance.resample(docs, seen).select("_row.doc_id", "log_weight").join(labels.filter("doc_id % 2 = 1 and toxic = 0"), "doc_id").toPandas()
    ranks = out["log_weight"].rank()
    good = out["quality"] == 1
    auc = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.9
