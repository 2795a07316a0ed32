from collections import Counter

import pytest

from turfspark.llm import sharding as S


def brute(names, size):
    import hashlib

    prefs = {}
    for n in sorted(names):
        h = hashlib.blake2b(n.encode(), digest_size=16).digest()
        o, s = int.from_bytes(h[:8], "big") % size, int.from_bytes(h[8:], "big") % (size - 1) + 1
        prefs[n] = iter([(o + j * s) % size for j in range(size)])
    table = {}
    while len(table) < size:
        for n, p in prefs.items():
            if len(table) < size:
                table[next(x for x in p if x not in table)] = n
    return table


def test_table():
    names = S.shard_names(7)
    t = S.lookup_table(names, 251)
    assert {s: names[i] for s, i in enumerate(t)} == brute(names, 251)
    n = Counter(t).values()
    assert max(n) - min(n) <= 1
    less = S.lookup_table(names[:-1], 251)
    assert sum(a != b for a, b in zip(t, less, strict=True) if a != 6) < 251 * 0.15
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            S.lookup_table(bad, 251)
    with pytest.raises(ValueError):
        S.lookup_table(["a"], 250)


def test_assign(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 0, 1), (1, "x", 0, 1), (None, "y", 0, 1), (2, None, 9, 1)], "doc_id long, shard string, slot int, _at int")
    got = S.assign(df, ["doc_id"], S.shard_names(5), 101)
    assert sorted(got.columns) == ["_at", "doc_id", "shard", "slot"] and got.count() == 4
    assert got.filter("doc_id = 1").distinct().count() == 1
    names, table = S.shard_names(5), S.lookup_table(S.shard_names(5), 101)
    assert all(names[table[r.slot]] == r.shard for r in got.collect())
    assert S.placements(df.limit(0)).count() == 0
    big = S.placements(spark.range(20000).withColumnRenamed("id", "doc_id"), 8)
    sizes = [r["count"] for r in big.groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.1 * min(sizes)
    stay = big.filter("shard <> 'shard-00007'")
    assert stay.filter("shard <> rehomed").count() < 0.1 * stay.count()
    S.write(df.drop("shard", "slot"), str(tmp_path / "o"), ["doc_id"], names, 2)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 4


def test_slots_match_an_independent_hash(spark):
    """Spark's hash of a long is XXH64 of its eight bytes, seed 42."""
    import struct

    import xxhash

    rows = S.placements(spark.range(-50, 300).withColumnRenamed("id", "doc_id"), 8, 251).collect()
    names, now, later = S.shard_names(8), S.lookup_table(S.shard_names(8), 251), S.lookup_table(S.shard_names(7), 251)
    for r in rows:
        h = xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), 42)
        slot = (h - (1 << 64) if h >> 63 else h) % 251
        assert (r.slot, r.shard, r.rehomed) == (slot, names[now[slot]], names[later[slot]])


def test_one_key_is_dealt_to_several_files(spark, tmp_path):
    df = spark.range(4000).selectExpr("1 key", "id x", "repeat('t', 100) text")
    S.write(df, str(tmp_path / "o"), ["key"], S.shard_names(3), 4)
    back = spark.read.parquet(str(tmp_path / "o"))
    assert back.select("shard").distinct().count() == 1 and back.selectExpr("input_file_name() f").distinct().count() > 1
    assert sorted(r.x for r in back.collect()) == list(range(4000))
