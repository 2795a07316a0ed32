import numpy as np
import pyarrow as pa

from turfspark.llm import toxicity as T
from turfspark.llm._text import hash_words


def test_features():
    w = np.sort(hash_words([b"moron"]))
    lex = T.Lexicon(w, np.array([2.0]))
    texts = ["You are a MORON!", "m0r*on you", "nothing here", None, "", "a b c d e f moron x y z w v you"]
    x = dict(zip(T.FEATURES, T.features(pa.array(texts), lex).T, strict=True))
    assert x["hit_rate"].tolist()[:3] == [0.25, 0, 0] and x["weight_max"].tolist() == [2, 0, 0, 0, 0, 2]
    assert x["hidden_hits"][1] > 0 and x["hidden_hits"][0] == 0
    assert x["near_you_share"].tolist() == [1, 0, 0, 0, 0, 0]
    assert x["capitals"][0] == 6 / 16 and x["exclaims"][0] == 1 / 16
    assert not np.isnan(np.array(list(x.values()))).any()


def test_held_out_quality_and_edge_cases(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "x y")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").join(labels.select("doc_id"), "doc_id").union(odd)
    labels = labels.select("doc_id", "toxic").union(spark.createDataFrame([(-1, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in T.score(docs, labels).collect()}
    want = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [r for r in got.values() if r.held_out and r.doc_id in want]
    assert np.mean([r.predicted for r in held if want[r.doc_id]]) > 0.85
    assert np.mean([r.predicted for r in held if not want[r.doc_id]]) < 0.02
    assert got[-1].predicted == got[-2].predicted == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", 2.0), (2, None, 1.0)], "doc_id long, text string, _features double")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r.doc_id, r.score, r.predicted) for r in T.score(docs, labels).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}
    kept = T.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 2
    assert T.score(docs.limit(0), labels).count() == 0


def slow_features(text, words, prefixes):
    """All features of one text from their definitions; ``words`` and ``prefixes`` give weights."""
    import math
    import re

    raw, low = (text or ""), (text or "").lower()
    run = rb"(?:[A-Za-z]|[\x80-\xff])+"
    tokens, w = re.findall(rb"[^ \t\n\r\x0b\x0c]+", raw.encode()), re.findall(run, low.encode())
    n = max(len(w), 1)
    hit = [words.get(x, 0) for x in w]
    pre = [max([prefixes.get(x[:k], 0) for k in T.PREFIXES if len(x) > k], default=0) for x in w]
    any_hit = [bool(a or b) for a, b in zip(hit, pre, strict=True)]
    you = [x.decode("utf-8", "replace") in T.SECOND_PERSON for x in w]
    near = sum(h and any(you[max(0, i - T.NEAR) : i + T.NEAR + 1]) for i, h in enumerate(any_hit))
    upper = lambda s: sum(len(c.encode()) for c in s if c.isupper() and len(c.encode()) < 3)
    letters = [sum(65 <= b <= 90 or 97 <= b <= 122 or b > 127 for b in t) for t in tokens]
    punct = set(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    shouted = sum(k > 2 and upper(t.decode()) == k for t, k in zip(tokens, letters, strict=True))
    marked = sum(k > 0 and any(b in punct for b in t[1:-1]) for t, k in zip(tokens, letters, strict=True))
    mixed = sum(k > 0 and any(48 <= b <= 57 for b in t) for t, k in zip(tokens, letters, strict=True))
    leet = dict(zip(b"013457@$!|", b"oieastasil", strict=True))
    plain = bytes(leet.get(b, b) for b in low.encode() if b not in b"*._-~^'`#%&+" or b in leet)
    shown = sum(words.get(x, 0) > 0 for x in re.findall(run, plain))
    hits, size, hidden = sum(x > 0 for x in hit), max(len(raw.encode()), 1), 0
    hidden = max(shown - hits, 0)
    return [
        math.log1p(len(w)), sum(map(len, w)) / n, hits / n, math.log1p(hits), sum(hit) / n, max(hit, default=0), sum(x > 0 for x in pre) / n, max(pre, default=0),
        sum(you) / n, math.log1p(near), near / max(sum(any_hit), 1), upper(raw) / size, shouted / max(len(tokens), 1), sum(b in punct for b in raw.encode()) / size,
        raw.count("!") / size, marked / max(len(tokens), 1), mixed / max(len(tokens), 1), math.log1p(hidden), hidden / max(shown, 1),
    ]


def slow_lexicon(rows):
    """Weights of words and beginnings from (text, label), by the likelihood-ratio test."""
    import math
    import re
    from collections import Counter

    n, pos, total_pos = Counter(), Counter(), sum(y for _, y in rows)
    for t, y in rows:
        w = re.findall(rb"(?:[a-z]|[\x80-\xff])+", (t or "").lower().encode())
        seen = {("w", x) for x in w} | {("p", x[:k]) for x in w for k in T.PREFIXES if len(x) > k}
        for x in seen:
            n[x] += 1
            pos[x] += y
    tested = sum(c >= 3 for c in n.values())
    share, out = total_pos / len(rows), {}
    for x, c in n.items():
        if c < 3:
            continue
        p, q = pos[x], c - pos[x]
        ratio = 2 * ((p * math.log(p / (c * share)) if p else 0) + (q * math.log(q / (c * (1 - share))) if q else 0))
        odds = math.log(((p + 0.5) / (total_pos - p + 0.5)) / ((q + 0.5) / (len(rows) - total_pos - q + 0.5)))
        if ratio > 2 * math.log(max(tested, 2)) + 2 and odds > 1.5:
            out[x] = odds
    return out


ODD = ["ESTÚPIDO eres TÚ", "ÀÉÎ ÑANDÚ ΩΜΕΓΑ", "", None, "m0r*on y0u a.s.s 1d1ot", " \n\t", "日本語 AB", "x" * 30, "you " * 5 + "I'm here!! #1"]


def test_lexicon_and_features_match_brute_force(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").selectExpr("text", "toxic label").collect()
    lexicon = T.learn_lexicon(spark.createDataFrame(rows, "text string, label long"))
    want = slow_lexicon([(r.text, r.label) for r in rows])
    key = lambda x: int(hash_words([x[1]])[0]) ^ (0x5DEECE66D if x[0] == "p" else 0)
    assert dict(zip(lexicon.words.tolist(), lexicon.weights.round(9).tolist(), strict=True)) == {key(x): round(v, 9) for x, v in want.items()} and len(want) > 5
    words, prefixes = ({x: v for (k, x), v in want.items() if k == kind} for kind in "wp")
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ODD
    got = T.features(pa.array(texts, pa.string()), lexicon)
    assert np.allclose(got, [slow_features(t, words, prefixes) for t in texts])


def test_long_repeated_and_clashing_rows(spark):
    text = "You are kind, señor.\n" * 60_000  # over one slice
    docs = spark.createDataFrame([(i, text if i == 1 else f"fine words {i % 3}", 1) for i in range(40)] + [(2, "fine words", 1)] * 30, "doc_id long, text string, features int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)], "doc_id long, toxic int")
    assert T.labelled_rows(docs, labels).groupBy("id").count().filter("count > 1").count() == 0
    got = T.score(docs, labels).collect()
    assert len(got) == 70 and all(0 <= r.score <= 1 for r in got)
    assert T.keep_clean(docs, labels).columns == docs.columns


def walked(text, x):
    """The value of a printed tree for one row, line by line: a branch not taken is skipped by its indentation."""
    lines, at = text.splitlines(), 1
    while not lines[at].strip().startswith("Predict"):
        word, *test = lines[at].strip().replace("(", "").replace(")", "").split()
        assert word == "If"
        if x[int(test[1])] <= float(test[3]):
            at += 1
        else:
            depth = len(lines[at]) - len(lines[at].lstrip())
            at = next(i for i in range(at + 1, len(lines)) if lines[i].strip().startswith("Else") and len(lines[i]) - len(lines[i].lstrip()) == depth) + 1
    return float(lines[at].split()[1])


def test_scores_match_trees_and_steps_in_plain_python(spark):
    """Of the fitted model, over a hundred documents and more; the filter of a stage keeps what scores below its threshold."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = T.fit(T.labelled_rows(docs, labels))
    rows = T.featurise(docs, model.lexicon, ["doc_id"])
    want = {r.doc_id: r.score for r in model.score(rows).collect()}
    found = rows.collect()
    got = model.scorer()(np.array([r.features for r in found]))
    assert len(found) > 100 and all(abs(want[r.doc_id] - g) < 1e-9 for r, g in zip(found, got, strict=True))
    bounds, values = model.calibration.boundaries.toArray().tolist(), model.calibration.predictions.toArray().tolist()
    for r in found[:100]:
        raw = 1 / (1 + np.exp(-2 * sum(w * walked(t.toDebugString, r.features) for t, w in zip(model.trees.trees, model.trees.treeWeights, strict=True))))
        k = sum(b <= raw for b in bounds)  # bounds at or below it
        if k in (0, len(bounds)):
            score = values[min(k, len(values) - 1)]
        else:
            score = values[k - 1] + (values[k] - values[k - 1]) * (raw - bounds[k - 1]) / (bounds[k] - bounds[k - 1])
        assert abs(score - want[r.doc_id]) < 1e-9
    kept = {r.doc_id for r in T.keep_clean(docs, labels).select("doc_id").collect()}
    assert kept == {i for i, s in want.items() if s < 0.5} and 0 < len(kept) < len(want)
