import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from turfspark.llm import quality as Q


def brute(text):
    """The statistics of one text, by characters and words."""
    text = text or ""
    size, punct = max(len(text.encode()), 1), set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    letter = lambda c: c.isascii() and c.isalpha() or not c.isascii()
    capital = lambda c: c < "ࠀ" and c.isupper()
    width = lambda cs: sum(len(c.encode()) for c in cs)
    tokens = [t for t in re.split("[ \t\n\r\x0b\x0c]+", text) if t]
    n = max(len(tokens), 1)
    share = lambda f: sum(map(f, tokens)) / n
    letters, capitals = width(filter(letter, text)), width(filter(capital, text))
    stops = share(lambda t: t[-1] in ".!?")
    lines = [x for x in text.split("\n") if x]
    words = re.findall("[a-z\x80-\U0010ffff]+", pa.compute.utf8_lower(pa.scalar(text)).as_py())
    pairs, m = list(zip(words, words[1:])), max(len(words), 1)  # noqa: B905
    sizes = [len(w.encode()) for w in words]
    every = lambda t, f: all(f(c) for c in t if letter(c))
    out = {
        "words_log": math.log1p(len(words)), "mean_word": sum(sizes) / m, "short_words": sum(x < 4 for x in sizes) / m, "long_words": sum(x > 12 for x in sizes) / m,
        "letters": letters / size, "capitals": capitals / max(letters, 1), "digits": sum(c in "0123456789" for c in text) / size,
        "marks": sum(c in punct for c in text) / size, "rare_marks": sum(c in punct - set("!\"'(),-.:;?") for c in text) / size,
        "commas": share(lambda t: t[-1] == ","), "stops": stops, "sentence_log": math.log1p(len(tokens)) - math.log1p(stops * n),
        "lone_marks": share(lambda t: not any(letter(c) or c in "0123456789" for c in t)),
        "doubled_marks": share(lambda t: len(t) > 1 and t[-1] in punct and t[-2] in punct and any(map(letter, t))),
        "shouted": share(lambda t: width(filter(letter, t)) > 1 and every(t, capital)), "capital_starts": share(lambda t: capital(t[0])),
        "distinct_words": len(set(words)) / m, "vocabulary": len(set(words)) / math.sqrt(m), "top_word": max(Counter(words).values(), default=0) / m,
        "repeated_next": sum(a == b for a, b in pairs) / m, "distinct_pairs": len(set(pairs)) / max(len(words) - 1, 1),
        "lines_log": math.log1p(len(lines)), "distinct_lines": len(set(lines)) / max(len(lines), 1), "line_words": math.log1p(len(tokens) / max(len(lines), 1)),
    }
    return [out[c] for c in Q.STATS]


TEXTS = st.text(st.sampled_from("aAbé É日ß1., \n\t!|*#'"), max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_statistics_equal_brute_force(texts):
    got = Q.statistics(pa.array(texts, pa.string()))
    assert got.shape == (len(texts), len(Q.STATS))
    for row, text in zip(got, texts, strict=True):
        np.testing.assert_allclose(row, brute(text), rtol=1e-12, atol=1e-12)


def test_statistics_of_documents(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    got = Q.statistics(pa.array([*texts, None, ""], pa.string()))
    for row, text in zip(got, [*texts, None, ""], strict=True):
        np.testing.assert_allclose(row, brute(text), rtol=1e-9, atol=1e-12)


TREE = """DecisionTreeRegressionModel: uid=x, depth=2, numNodes=7, numFeatures=24
  If (feature 3 <= 0.5)
   If (feature 3 <= -1.0E-4)
    Predict: 1.0
   Else (feature 3 > -1.0E-4)
    Predict: 2.0
  Else (feature 3 > 0.5)
   If (feature 0 <= 2.0)
    Predict: 3.0
   Else (feature 0 > 2.0)
    Predict: 4.0
"""


def test_paths_of_a_tree():
    inf = np.inf
    rules = Q.paths(TREE)
    assert rules == [
        {3: (-inf, 0.5)}, {3: (-inf, -1e-4)}, {3: (-1e-4, 0.5)},
        {3: (0.5, inf)}, {3: (0.5, inf), 0: (-inf, 2.0)}, {3: (0.5, inf), 0: (2.0, inf)},
    ]
    assert Q.distinct(rules * 2) == [dict(sorted(r.items())) for r in rules]
    x = np.zeros((3, len(Q.STATS)))
    x[:, 3], x[:, 0] = [-1.0, 0.5, 0.6], [0.0, 0.0, 2.5]
    assert Q.holds(rules, x).astype(int).T.tolist() == [[1, 1, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1], [0, 0, 0], [0, 0, 1]]


def test_column_equals_rules_in_plain_python(spark, sf_dir):
    """The fitted model, applied to documents by brute-force statistics and by the compiled expression."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.fit(Q.labelled_rows(docs, labels))
    assert model.weighted and len(model.weighted) < 200 and len(model.rules()) == len(model.weighted)
    got = {r.doc_id: r.score for r in Q.described(docs.select("doc_id", "text"), ["doc_id"]).select("doc_id", model.column().alias("score")).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i in sorted(texts)[:150]:
        x = brute(texts[i])
        z = model.intercept + sum(w for w, rule in model.weighted if all(low < x[k] <= high for k, (low, high) in rule.items()))
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-9
    assert got.keys() == texts.keys()


def test_held_out_documents_are_told_apart(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    wanted = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = Q.score(wanted, labels).join(labels.filter("quality is not null"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    good, bad = ([r.score for r in rows if r.held_out and r.quality == q] for q in (1, 0))
    auc = np.mean([(np.array(bad) < g).mean() + (np.array(bad) == g).mean() / 2 for g in good])
    assert auc > 0.98 and np.mean(np.array(good) >= 0.5) > 0.98 and np.mean(np.array(bad) < 0.5) > 0.95


def test_labels_of_held_out_rows_and_other_columns_are_not_used(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    asked = docs.limit(200)
    held = "crc32(cast(doc_id as string)) % 3 = 1"
    turned = labels.selectExpr("doc_id", f"case when {held} then 1 - quality else quality end quality")
    moved = docs.selectExpr("doc_id", "text", "'x' lang", "'y' source", "-1 n_chars")
    first = {r.doc_id: r.score for r in Q.score(docs, labels).filter("doc_id < 60").collect()}
    assert {r.doc_id: r.score for r in Q.score(moved, turned).filter("doc_id < 60").collect()} == first and asked.count()


def test_edge_cases(spark):
    docs = spark.createDataFrame(
        [(1, None, 1.0), (2, "", 1.0), (None, "some words", 1.0), (3, "a b c " * 300_000, 1.0), (3, "other", 1.0), (3, "other", 1.0), (4, "!!!", 1.0)], "doc_id long, text string, marks double"
    )
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 1), (3, 0)], "doc_id long, quality int")
    rows = Q.score(docs, labels).collect()
    assert len(rows) == 7 and all(r.score == 1.0 and r.predicted == 1 for r in rows)  # one class only
    none = Q.score(docs, labels.limit(0)).collect()
    assert [r.score for r in none] == [0.0] * 7 and {r.held_out for r in none if r.doc_id is None} == {False}
    assert Q.score(docs.limit(0), labels).count() == 0
    two = spark.createDataFrame([(1, 1), (3, 0), (2, 1), (4, 0), (4, None)], "doc_id long, quality int")
    rows = Q.score(docs, two).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
