import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from turfspark.llm import simhash as S


def brute(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def brute_components(ids, fps):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in zip(ids, fps, strict=True):
        for j, b in zip(ids, fps, strict=True):
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_golay_is_perfect_and_keys_meet():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 1 << 23, 500)
    centre, far = S.indices(w)
    for bit in range(23):
        c2, f2 = S.indices(w ^ (1 << bit))
        near = (c2 == centre) | (far == c2[:, None]).any(1)
        assert near.all()
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(2))
        b = a
        for bit in rng.choice(64, int(rng.integers(0, 4)), replace=False):
            b ^= 1 << int(bit)
        k = [set(S.keys(np.array([x], np.uint64))[1].tolist()) for x in (a, b)]
        assert k[0] & k[1]


def test_fingerprint_matches_brute_force():
    texts = [None, "", " \t", "One", "One TWO", "ÀB c\x0bd e", "a b c " * 50, "x y z w"]
    assert [S.fingerprint(t) for t in texts] == brute(texts)


def test_components_match_brute_force(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(60)]
    fps = []
    for b in base:
        fps.append(b)
        for _ in range(rnd.randrange(8)):
            for _ in range(rnd.randrange(1, 4)):
                b ^= 1 << rnd.randrange(64)
            fps.append(b)
    fps += fps[:20]
    rnd.shuffle(fps)
    want = brute_components(range(len(fps)), fps)
    rows = [(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)]
    fp = spark.createDataFrame(rows, "id long, fp long")
    for block in (S.BLOCK, 4):
        edges = S.links(fp.select("fp").distinct(), block)
        e = {tuple(np.array(r, np.int64).view(np.uint64).tolist()) for r in edges.collect()}
        assert all((a ^ b).bit_count() <= 3 for a, b in e)
        roots = {r.node: r.root for r in S.components(edges).collect()}
        got = {}
        for i, f in rows:
            got.setdefault(roots.get(f, f), []).append(i)
        assert {i: min(v) for v in got.values() for i in v} == want


def test_edge_cases(spark):
    docs = spark.createDataFrame(
        [(3, "a b c d", 1), (1, "a b c d", 2), (1, "a b c d", 2), (None, "a b c d", 0), (7, None, 0), (8, "", 0), (None, "lone text here now", 4)],
        "doc_id long, text string, _nth int",
    )
    got = {(r.doc_id, r.fingerprint): r.component_id for r in S.near_duplicates(docs).collect()}
    assert got[7, "0" * 16] == got[8, "0" * 16] == 7
    assert {v for (i, _), v in got.items() if i in (1, 3)} == {1}
    assert S.near_duplicates(docs).count() == 7
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "lone text here now"), (1, "a b c d"), (7, None)]
    assert S.near_duplicates(docs.limit(0)).count() == 0
    assert S.keep_one(docs.limit(0)).count() == 0


def test_a_long_chain_is_one_component(spark):
    """5,000 fingerprints, each two bits from the next and most far from the first: Gray codes in steps of two."""
    gray = [i ^ i >> 1 for i in range(5000)]
    spread = [sum((g >> b & 1) * (1 << 4 * b) for b in range(13)) for g in gray]
    rows = list(enumerate(spread))
    random.Random(2).shuffle(rows)
    edges = spark.createDataFrame([(spread[i], spread[i + 1]) for i in range(4999)], "a long, b long").repartition(4)
    roots = {r.node: r.root for r in S.components(edges).collect()}
    assert set(roots) | {min(spread)} == set(spread) and set(roots.values()) == {min(spread)}
    out = S._classes(spark.createDataFrame(rows, "id long, fp long")).select("component_id").distinct().collect()
    assert [r.component_id for r in out] == [0]


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"w{i * i % 977}" for i in range(70_000))
    assert S.fingerprint(text) == brute([text])[0]


def test_a_hot_fingerprint_is_spread(spark):
    """A third of all rows, without help from adaptive execution."""
    rows = [(i, 7 if i % 3 == 0 else i * 1000) for i in range(3000)]
    fp = spark.createDataFrame(rows, "id long, fp long").repartition(4)
    classes = S._classes(fp, spark.createDataFrame([(1000, 2000)], "a long, b long"))
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = S._of_class(fp, classes, hot_rows=50)
        largest = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert {(r.id, r.component_id) for r in got.collect()} == {(i, 0 if f == 7 else 1 if f == 2000 else i) for i, f in rows}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])
    assert got.count() == 3000 and largest < 1000


def test_of_rows_with_one_id_the_first_by_text_stays(spark):
    long = " ".join(f"word{i}" for i in range(20))
    rows = [(5, long, "x"), (5, "a " + long, "y"), (5, None, "z"), (5, None, "z"), (6, long, "other"), (7, "quite another text of some words", "own"), (8, None, "none")]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _head string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(5, None, "z"), (7, "quite another text of some words", "own")], key=str)


def test_a_row_of_a_repeated_id_stays_where_the_id_names_its_component(spark):
    """The texts of id 5 have a component each: of one it's the smallest id, of the other it isn't."""
    one, two = (" ".join(f"{x}{i}" for i in range(20)) for x in "ab")
    rows = [(3, "z " + one, 0), (5, one, 1), (5, two, 2), (5, two, 3), (9, two + " z", 4), (None, two, 5), (12, None, 6)]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _named int"))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, "z " + one), (5, two), (12, None)]


def test_of_a_component_without_ids_the_first_by_text_stays(spark):
    texts = [" ".join(f"{x}{i}" for i in range(20)) for x in "bcdefghi"]
    rows = [(None, x) for t in texts for x in (t, "a " + t, t + " z")] + [(None, None), (None, ""), (None, " ")]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.text or "" for r in kept.collect()) == sorted(["", *("a " + t for t in texts)])
