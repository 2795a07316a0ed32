import hashlib

import numpy as np

from turfspark.llm import digest as D


def brute_counts(data):
    out = [0] * 256
    for i in range(len(data)):
        for n, (j, k) in enumerate(D.TRIPLETS):
            if i + k < len(data):
                out[(int(D._T[n, 0, data[i]]) + int(D._T[n, 1, data[i + j]]) + int(D._T[n, 2, data[i + k]])) % 65536 >> 8] += 1
    return out


def test_counts_match_brute_force(monkeypatch):
    monkeypatch.setattr(D, "WINDOW", 16)
    for data in (b"", b"a", b"abc", b"abcd", bytes(range(200)) * 2, b"x" * 16, b"xy" * 17):
        assert D.counts(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tolist() == brute_counts(data)
    both = D.counts(np.frombuffer(b"abcdxyz" * 9, np.uint8), np.array([0, 5, 5, 63]))
    assert both.tolist() == [brute_counts(b"abcdx"), brute_counts(b""), brute_counts((b"abcdxyz" * 9)[5:])]


def test_likeness():
    a, b = (D.digest(x) for x in (b"some words of a text that is long enough " * 9, b"quite other letters, numbers 123 and so on! " * 8))
    assert D.likeness(a, a) == 1 and 0 <= D.likeness(a, b) < 0.7 and D.likeness(a, b) == D.likeness(b, a)
    assert D.likeness(D.digest(b""), a) < 0.5


def test_edited_pairs_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(None, "no id é"), (10**7, None), (10**7, ""), (10**8, "日本語の文書です")], docs.schema))
    rows = sorted(docs.selectExpr("*", "xxhash64(text) tie").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie))
    want = []
    for r, n in zip(rows, rows[1:] + rows[:1], strict=True):
        t, u = r.text or "", n.text or ""
        e = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
        x, y, z = (D.digest(s.encode()) for s in (t, e, u))
        want.append((r.doc_id, len(t), hashlib.sha256(e.encode()).hexdigest(), x.hex(), y.hex(), D.likeness(x, y), D.likeness(x, z)))
    for size in (30_000, 1 << 40):
        got = D.edited_pairs(docs.withColumns({c: docs.doc_id for c in ("part", "tie", "following")}), size).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert D.edited_pairs(docs.limit(0)).count() == 0
    assert D.edited_pairs(docs.limit(1)).first().near_next == 1


def test_long_and_repeated_texts(spark):
    text = "Some wörds, again and again: 日本 x1\n" * 50_000  # over one slice
    docs = spark.createDataFrame([(1, text), (2, text), (2, text), (3, None)], "doc_id long, text string")
    got = sorted(D.edited_pairs(docs).collect(), key=lambda r: r.doc_id)
    assert {r.fingerprint for r in got[:3]} == {D.digest(text.encode()).hex()} and [r.near_next for r in got[:2]] == [1, 1]
    assert got[0].edited_sha256 == hashlib.sha256(D.edit(text, text).encode()).hexdigest() and got[3].n_chars == 0
