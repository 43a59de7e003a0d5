"""Fill-in-the-middle against plain string slicing, with chunks of few bytes so that every text is a giant one."""

import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import op13_fill_in_middle as op
from skein.llm.automata import code_points, literals, scans

ODD = [
    (1, None), (2, ""), (3, "a"), (4, "é中😀x" * 50), (5, "no <P> here"), (6, "<<P"), (7, "a<S>"), (8, "<M" + ">"), (9, "< P>"), (10, "x" * 70_000 + "中"), (10, "x" * 70_000 + "中"),
    (11, "y" * 200_000 + "<M>"), (None, "null key"), (12, "😀" * 40_000), (13, "<" * 33 + "P" + ">"), (14, "\x00\n\t é"),
]
ODD += [(i, f"text {i} é " * (i % 23)) for i in range(100, 260)]


def plain(key, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return key, n, "plain", None, None, text
    form = "spm" if h4 % 100 < 20 else "psm"
    p, m, s = text[:a], text[a:b], text[b:]
    return key, n, form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("chunk", [16, 4096, 1 << 16])
def test_cuts(spark, chunk):
    rows = ODD if chunk > 16 else [r for r in ODD if len(r[1] or "") < 300]
    docs = spark.createDataFrame([(k, t, i, -i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, `a.b` long, n long").repartition(3)
    out = op.transform(docs, chunk=chunk)
    assert sorted(out.columns) == sorted(["doc_id", "text", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"])
    got = out.withColumn("back", op.restored(F.col("output"), F.col("form"))).collect()
    assert all(r["back"] == (r["text"] or "") for r in got)
    got = sorted(((r["a.b"], *(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output"))) for r in got), key=lambda r: r[0])
    assert got == [(i, *plain(k, t)) for i, (k, t) in enumerate(rows)]
    assert {r[3] for r in got} == {"plain", "psm", "spm"}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, form string")
    assert op.transform(docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="a<PSM>é中😀\n", max_size=40), min_size=1, max_size=6), st.integers(0, 60))
def test_scan(texts, target):
    for first, many, (points, marks) in scans(pa.array([t.encode() for t in texts]), code_points(), literals(("<P>", "<S>", "<M>"))):
        assert first == 0 and many == len(texts)
        assert points.functions()[1][:, 0].tolist() == [len(t) for t in texts]
        assert (marks.functions()[1][:, 0] > 0).tolist() == [any(m in t for m in ("<P>", "<S>", "<M>")) for t in texts]
        found = points.find(np.zeros(many, np.int64), np.full(many, target))
        assert found.tolist() == [len(t[:target].encode()) if target < len(t) else -1 for t in texts]


def test_entered_inside_a_code_point():
    """A chunk that begins with the rest of a code point counts nothing for it, from the state it is entered in."""
    raw = "a😀é".encode()
    for i in range(len(raw) + 1):
        ((_, _, (a,)),) = scans(pa.array([raw[:i]]), code_points())
        ((_, _, (b,)),) = scans(pa.array([raw[i:]]), code_points())
        left, count = a.functions()
        then, more = b.functions()
        assert count[0, 0] + more[0, left[0, 0]] == 3 and then[0, left[0, 0]] == 0


def test_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    df = op.op13_fill_in_middle(spark, data)
    twin = con.execute(op.ORACLE)
    names = [c[0] for c in twin.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(twin.fetchall())
