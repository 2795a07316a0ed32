import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turfspark.llm import fim


def brute(doc_id, text):
    """The rule of the query, by code points."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    prefix, middle, suffix = text[:a], text[a:z], text[z:]
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", a, z - a, sha(f"<S>{suffix}<P>{prefix}<M>{middle}"), sha(text))
    return (doc_id, n, "psm", a, z - a, sha(f"<P>{prefix}<S>{suffix}<M>{middle}"), sha(text))


ALPHABET = st.sampled_from("ab <>PSMé߿ࠀ日\U00010000\U0010ffff\x00\n")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=12), max_size=6))
def test_index_moves_over_both_ways(texts):
    data, ends = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    index = fim.Exceptions(data)
    whole = "".join(texts)
    chars = np.arange(len(whole) + 1)
    begins = np.cumsum([0, *(len(c.encode()) for c in whole)])
    assert index.to_bytes(chars).tolist() == begins.tolist()
    assert index.to_chars(begins).tolist() == chars.tolist()
    assert np.diff(index.to_chars(ends)).tolist() == [len(t) for t in texts]
    assert len(index.bytes) == sum(ord(c) > 127 for c in whole)
    assert fim.marked(data, ends).tolist() == [any(s in t for s in ("<P>", "<S>", "<M>")) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(ALPHABET, max_size=12), st.integers(0, 50), st.integers(0, 50), st.integers(0, 99), st.integers(0, 99)), max_size=6))
def test_examples_restore(rows):
    columns = [pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3, 4))]
    found = fim.examples(pa.RecordBatch.from_arrays(columns, ["text", "h1", "h2", "h3", "h4"]))
    for (text, *_), n, form, a, m, out in zip(rows, *(x.to_pylist() for x in found), strict=True):
        assert n == len(text) and fim.restore(out.encode(), form).decode() == text
        if form != "plain":
            p, middle, s = (x.decode() for x in fim.parts(out.encode(), form))
            assert (p, middle, s) == (text[:a], text[a : a + m], text[a + m :])


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(tuple(r) for r in fim.round_trip(docs).collect())
    want = sorted(brute(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert got == want
    assert set(Counter(r[2] for r in want)) == {"plain", "psm", "spm"}


def test_edge_cases(spark):
    long = "wörds 日本 \U0001f600 and plain ones, " * 60_000  # over one slice
    texts = [None, "", "a", "é", "\U0001f600", "a <P> b", "<M>", "<P", "P>", "<", "<S", "<<S", "x<", "\x00", long, "S>", "<S>", long]
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts * 3)] + [(None, "no id", "x", 1, 2), (None, None, "x", 1, 2), (-7, "négative", "x", 1, 2)] + [(5, "again", "x", 1, 2)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int, h1 int")
    key = lambda r: (r[0] is not None, r[0] or 0, r[5])
    assert sorted((tuple(r) for r in fim.round_trip(docs).collect()), key=key) == sorted((brute(r[0], r[1]) for r in rows), key=key)
    assert fim.round_trip(docs.limit(0)).count() == 0


def test_own_shares_and_text_ids(spark):
    docs = spark.createDataFrame([(f"k{i}", "some text") for i in range(200)], "key string, body string")
    forms = lambda **k: Counter(r.form for r in fim.transform(docs, "key", "body", **k).collect())
    assert forms(cut_share=0) == {"plain": 200} and forms(cut_share=100, spm_share=100) == {"spm": 200}
    mixed = forms(seed="2")
    assert mixed != forms(seed="3") and mixed["psm"] > mixed["spm"] > 0


def test_scan_only(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert "Exchange" not in fim.round_trip(docs)._jdf.queryExecution().toString()


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_damaged_examples_are_errors(form):
    with pytest.raises(ValueError):
        fim.restore(b"<P>a<S>b", form)
