import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turfspark.llm import oracles, trie


def brute(rows, rebuild=True):
    """Nodes of the trie, by a dictionary of prefixes."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[conv].append(((turn is not None, turn or 0), tie, (role, text)))
    convs = {c: [t[2] for t in sorted(v)] for c, v in convs.items()}
    built = convs
    if rebuild:
        mod = lambda c: abs(c) % 5 * (1 if c >= 0 else -1)  # noqa: E731  # of the sign of c, as in SQL
        heads = {c: zlib.crc32(str(c).encode()) % 9 for c in convs}
        built = {c: convs.get(c - mod(c), [])[: heads[c]] + v[heads[c] :] for c, v in convs.items()}
    members, children = defaultdict(list), defaultdict(set)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
            if d:
                children[tuple(v[: d - 1])].add(tuple(v[:d]))
    out = []
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += p not in children
        saved[p] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), len(children.get(p, ())), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def some(seed, n=60, longest=12, words=2):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]), r.choice(["aé", "b", ""][:words])) for c in r.sample(range(-40, 200), n) for t in range(r.randint(1, longest))]


def test_query_equals_brute_force(spark):
    conversations = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    want = brute([tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()])
    assert found(trie.prefix_trie(conversations, trie.spliced)) == want and len(want) > 50


@pytest.mark.parametrize("rebuild", [True, False])
def test_deep_and_shared_conversations(spark, rebuild, monkeypatch):
    """Few words, so that prefixes are shared deeply; with ranges of few rows, so that children, conversations, lists and
    ids cross them, and the list is contracted over several rounds."""
    rows = some(1) + [(1000, t, "user", "b") for t in range(300)] + [(1001 + k, t, "user", "b") for k in range(30) for t in range(40 + k % 3)]
    random.Random(2).shuffle(rows)
    monkeypatch.setattr(trie, "SPREAD", 16)
    monkeypatch.setattr(trie, "CHUNK", 24)
    monkeypatch.setattr(trie.grouped_totals, "__defaults__", (50,))
    monkeypatch.setattr(trie.ranged, "__defaults__", (50,))
    monkeypatch.setattr(trie.parts_for, "__defaults__", (50, 40))
    monkeypatch.setattr(trie.ranked, "__defaults__", (50,))
    got = found(trie.prefix_trie(frame(spark, rows), trie.spliced if rebuild else trie.whole))
    assert got == brute(rows, rebuild)


def test_edge_cases(spark):
    rows = [
        (None, 0, "user", "lost"), (5, None, "user", "first"), (5, 2, None, None), (5, 2, "b", "tie"), (5, 2, "a", "tie"), (5, 2, "a", "tie"), (6, 0, "user", "first"),
        (7, 0, "user", "x" * 300_000), (3, -1, None, "é"), (-3, 0, "", "é"), (-3, 0, "", "é"), (11, 0, "user", "y"), (12, 0, "user", "y"),
    ]
    df = frame(spark, rows).withColumns({"c": F.lit(1), "depth": F.lit("x"), "_part": F.lit(2)})
    assert found(trie.prefix_trie(df, trie.spliced)) == brute(rows)
    assert found(trie.prefix_trie(df)) == brute(rows, False)
    assert trie.prefix_trie(df.limit(0), trie.spliced).count() == 0
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sorted(con.sql(oracles.TRIE).fetchall(), key=lambda r: r[:2]) == brute(rows)


def test_list_ranking_of_a_shuffled_list(spark):
    """Neighbours of the list are neighbours of no partition, so that only moves to the follower's partition help."""
    n = 400
    order = np.random.default_rng(3).permutation(n)
    rows = [(int(a), 0, int(b), 0, 1, int(a) % 3, int(a)) for a, b in zip(order[:-1], order[1:], strict=True)] + [(int(order[-1]), 0, None, None, 1, 5, 7)]
    arcs = spark.createDataFrame(rows, "c long, a long, next_c long, next_a long, position long, leaves long, saved long")
    got = {r.c: (r.position, r.leaves, r.saved) for r in trie.ranked(arcs, 30).collect()}
    leaves, saved = np.cumsum(order % 3), np.cumsum(order)
    assert got == {int(c): (i, int(leaves[i] - c % 3), int(saved[i] - c)) for i, c in enumerate(order)}


def test_stretches_of_a_partition():
    batch = lambda *rows: pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], pa.int64()) for i, k in enumerate(trie._LIST)})
    out = list(trie._contract(iter([batch((1, 0, 2, 0, 1, 10, 100)), batch((9, 1, None, None, 1, 40, 400), (2, 0, 7, 7, 1, 20, 200))])))
    rows = {(r["c"], r["a"]): r for b in out for r in b.to_pylist()}
    assert (rows[2, 0]["head_c"], rows[2, 0]["position"], rows[2, 0]["leaves"], rows[2, 0]["whole_saved"]) == (1, 1, 10, 300)
    assert (rows[2, 0]["next_c"], rows[2, 0]["last"], rows[1, 0]["last"], rows[1, 0]["next_c"]) == (7, True, False, None)
    assert rows[9, 1]["last"] and rows[9, 1]["next_c"] is None and list(trie._contract(iter([batch()]))) == []
