import random

import numpy as np
import pyarrow as pa

import corpus_pipeline as P
from turfspark.llm import shingle_sets as N
from turfspark.llm import simhash as S

from .test_simhash import brute_components


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


def brute(docs):
    """Smallest ids of the components of texts with a Jaccard similarity of 0.8 or more."""
    ids, sets = [i for i, _ in docs], [shingles(t) for _, t in docs]
    roots = {i: i for i in ids}
    for k, a in enumerate(sets):
        for j in range(k):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                x, y = sorted((roots[ids[k]], roots[ids[j]]))
                roots = {i: x if r == y else r for i, r in roots.items()}
    return sorted(set(roots.values()))


def edited(rnd, words, n):
    out = list(words)
    for at in rnd.sample(range(len(out)), n):
        out[at] = f"new{rnd.randrange(10**6)}"
    return out


def corpus():
    rnd = random.Random(3)
    docs = []
    for _ in range(30):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(40, 400))]
        docs.append(base)
        docs += [edited(rnd, base, rnd.randrange(1, max(2, len(base) // 30))) for _ in range(rnd.randrange(5))]
    hot = [f"h{i}" for i in range(150)]  # copies alike to the base, hardly to each other
    docs += [edited(rnd, hot, 5) for _ in range(60)]
    texts = [" ".join(d) for d in docs] + ["", " \n", "One two", "one TWO", "a b c d e", "a b c d f", "A  b c d e"]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_sets_match_brute_force():
    texts = ["a b c d e f", None, "", "a b", "A\x0bb c", "x y z v w " * 9, "é È b c d e"]
    got = N.shingle_sets(pa.array(texts))
    assert [len(s) for s in got] == [len(shingles(t)) if (t or "").split() else 0 for t in texts]
    one, two = N.shingle_sets(pa.array(["p q a b c d e f", "A b c d e f"]))
    assert len(set(one.tolist()) & set(two.tolist())) == 2


def test_keep_one_matches_brute_force(spark):
    docs = corpus()
    want = brute(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in S.keep_one(df).collect()) == want
    assert want != sorted(set(brute_components([i for i, _ in docs], [S.fingerprint(t) for _, t in docs]).values()))


def test_large_keys_are_spread(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    prints = N.keyed(df).cache()
    roots = [S.components(N.links(prints, df, S.components, block_bytes=b)).collect() for b in (N.BLOCK_BYTES, 20_000)]
    assert sorted(map(tuple, roots[0])) == sorted(map(tuple, roots[1])) and roots[0]


def test_stage_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in P.drop_near_duplicates(spark, docs, sf_dir).collect()) == want


def test_only_wanted_sets_leave_their_task(spark):
    """Two texts of 400 are wanted, one of them 100 times: few rows meet the join by set, whatever the number of texts."""
    texts = [f"text {i} of words {i * 7} and {i * 11} more" for i in range(300)] + ["one text that comes often in here"] * 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    prints = N.keyed(docs)
    nodes = prints.filter("id in (5, 350)").select("fp").distinct()
    assert {r.fp for r in nodes.collect()} <= {r.fp for r in N._contents(docs, "text", N._sieve(nodes)).collect()}
    assert N._contents(docs, "text", N._sieve(nodes)).count() < 10
    want = sorted((r.fp, bytes(r.hashes)) for r in N._wanted(nodes, docs, "text").collect())
    full = N._contents(docs, "text", np.full(1 << 10, -1, np.int64).view(np.uint64))
    assert want == sorted((r.fp, bytes(r.hashes)) for r in full.join(nodes, "fp", "left_semi").collect()) and full.count() == 301
    some = np.array([0, -1, 1 << 62, -(1 << 62), 12345], np.int64)
    assert N._sieved(some, N._sieve(spark.createDataFrame([(int(x),) for x in some], "fp long"), 10)).all()
