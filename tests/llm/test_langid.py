import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from turfspark.llm import langid as L


def test_posteriors_match_enumeration(monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 2)
    rng = np.random.default_rng(0)
    per_row = np.array([0, 1, 1, 6, 9])
    e, t = rng.normal(size=(9, 3)) * 3, rng.normal(size=(3, 3))
    got = L.posteriors(e, per_row, t)
    for a, b in zip(per_row[:-1], per_row[1:], strict=True):
        want = np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=int(b - a)):
            w = np.exp(t[:, path[0]]).sum() if path else 0
            for k, y in enumerate(path):
                w *= np.exp(e[a + k, y] + (t[path[k - 1], y] if k else 0))
            for k, y in enumerate(path):
                want[k, y] += w
        assert np.allclose(got[a:b], want / np.maximum(want.sum(1, keepdims=True), 1e-300))


def test_code_switched_words_follow_their_language():
    rng = np.random.default_rng(2)
    syllables = {"aa": ["ka", "mo", "ti", "ru"], "bb": ["sch", "ei", "ung", "pf"]}
    word = lambda k: "".join(rng.choice(syllables[k], 3))
    texts = [(" ".join(word(k) for _ in range(60)), k) for k in syllables for _ in range(30)]
    m = L.train(texts, steps=30)
    words = [word("aa") for _ in range(20)] + [word("bb") for _ in range(20)]
    ws, number, per_row = L.tokens(pa.array([" ".join(words)]))
    p = L.posteriors(m.emissions(ws)[number], per_row, m.transitions)
    assert (p.argmax(1) == np.repeat([0, 1], 20)).mean() > 0.9
    assert m.transitions[0, 0] > m.transitions[0, 1]


def test_held_out_accuracy_and_edge_cases(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, "fr"), (-2, " 12 !? ", "de"), (None, "The and", None), (-3, "", None)], docs.schema)
    got = {(r.doc_id, r.held_out): r for r in L.predict(docs.union(odd)).collect()}
    assert len(got) == docs.count() + 4
    by_id = {k[0]: v for k, v in got.items()}
    assert [by_id[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and by_id[-1].score == 0
    want = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id in want]
    assert np.mean([want[r.doc_id] == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = L.keep_identified(docs.limit(60).union(odd).withColumn("_letters", F.lit(7)))
    assert kept.columns == ["doc_id", "text", "lang", "_letters"]
    assert not {-1, -2, -3} & {r.doc_id for r in kept.collect()} and kept.filter("_letters = 7").count() >= 58
    nothing = L.predict(docs.filter("false"))
    assert nothing.count() == 0
    assert {r.lang_pred for r in L.predict(docs.withColumn("lang", docs.lang.cast("string").substr(9, 1)).filter("doc_id < 0")).collect()} == set()


def slow_prediction(m, text):
    """Label and score of one text, word by word, from the definition."""
    import re

    from turfspark.llm._text import mix

    words = re.findall(rb"(?:[a-z]|[\x80-\xff])+", text.lower().encode())
    emit = []
    for w in words:
        raw, total = b"\x01" + w + b"\x02", np.zeros(len(m.languages))
        for n in L.GRAMS:
            for i in range(len(raw) - n + 1):
                g = n
                for c in raw[i : i + n]:
                    g = (g * 257 + c) % 2**64
                total += m.weights[int(mix(np.array([g], np.uint64))[0]) >> (64 - L.BITS)]
        emit.append(total + (m.weights[m.lexicon[w]] if w in m.lexicon else 0))
    k = len(m.languages)
    t = np.exp(m.transitions)
    ahead, v = [], np.full(k, 1 / k)
    for e in emit:
        v = (v @ t) * np.exp(e - e.max())
        v /= v.sum()
        ahead.append(v)
    v, share = np.full(k, 1 / k), np.zeros(k)
    for e, a in zip(emit[::-1], ahead[::-1], strict=True):
        share += a * v / (a * v).sum()
        v = t @ (np.exp(e - e.max()) * v)
        v /= v.sum()
    share /= len(words)
    return m.languages[share.argmax()], share.max()


def test_predictions_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").limit(60)
    model = L.fit(docs)
    got = {r.doc_id: r for r in L.predict(docs.withColumns({"letters": docs.lang, "held_out": docs.lang})).collect()}
    for r in docs.collect():
        if got[r.doc_id].lang_pred != L.UNDETERMINED:
            lang, score = slow_prediction(model, r.text)
            assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-6


def made_up(n, words, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        syllables = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 3)) for _ in range(12)]
        for _ in range(8):
            out.append((" ".join("".join(rng.choice(syllables, 2)) for _ in range(words)), f"l{k:02d}"))
    return [(i, t, lang) for i, (t, lang) in enumerate(out)]


def test_seventy_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(L, "STEPS", 16)
    monkeypatch.setattr(L, "MORE", 12)
    monkeypatch.setattr(L, "SEQUENCES", 400)
    docs = spark.createDataFrame(made_up(70, 40), "doc_id long, text string, lang string")
    got = L.predict(docs).join(docs, "doc_id").filter("held_out").collect()
    assert len({r.lang for r in got}) > 60 and np.mean([r.lang == r.lang_pred for r in got]) > 0.95


def test_a_language_of_long_texts_and_repeated_ids_is_learned(spark):
    rows = made_up(2, 30) + [(1000 + i, t * 60, "long") for i, (_, t, _) in enumerate(made_up(1, 150, 5))] + [(7, "zzz yyy xxx", "same")] * 50
    assert all(len(t) > 60_000 for _, t, lang in rows if lang == "long")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = L.training_rows(docs).collect()
    assert {r.lang for r in sample} >= {"l00", "l01", "long"} and max(len(r.text) for r in sample) == L.WINDOW
    assert sum(r.lang == "same" for r in sample) <= 1
    assert {r.lang_pred for r in L.predict(docs).join(docs.filter("lang = 'long'"), "doc_id").collect()} == {"long"}
    assert len(L.training_rows(docs, rows_in_all=8).groupBy("lang").count().filter("count > 2").collect()) == 0


def test_long_texts_are_gone_through_in_ranges(monkeypatch):
    m = L.train([(t, lang) for _, t, lang in made_up(3, 60)], steps=16)
    texts = pa.array(["", " ".join(t for _, t, _ in made_up(3, 60)), "one", *[t for _, t, _ in made_up(3, 30, 1)]])
    want, n = m.shares(texts)
    for limit in (7, 100):
        monkeypatch.setattr(L, "LONG", limit)
        got, n2 = m.shares(texts)
        assert np.allclose(got, want) and n.tolist() == n2.tolist()


def test_words_are_labelled(spark):
    rows = made_up(2, 60)
    mixed = " ".join(rows[0][1].split()[:20] + rows[8][1].split()[:20])
    docs = spark.createDataFrame([*rows, (5000, mixed.upper(), None), (5001, None, None)], "doc_id long, text string, lang string")
    got = sorted((r for r in L.label_words(docs).filter("doc_id >= 5000").collect()), key=lambda r: r.position)
    assert [r.word for r in got] == mixed.split() and [r.position for r in got] == list(range(40))
    assert np.mean([r.language == w for r, w in zip(got, ["l00"] * 20 + ["l01"] * 20, strict=True)]) > 0.9
    assert L.label_words(docs.filter("false")).count() == 0
