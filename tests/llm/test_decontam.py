import random
import re

from turfspark.llm import decontam as D

WORDS = [f"w{i}" for i in range(60)] + ["Été", "don't", "x-y"]


def brute(docs, items, size=5, t=0.8):
    def words(s):
        return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (s or "").lower())

    out = set()
    for i, it in set(items):
        w = words(it)
        n = min(size, len(w))
        a = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for d, text in docs:
            v = words(text)
            b = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            if a and len(a & b) >= t * len(a) - 1e-9:
                out.add((d, i, len(a & b), len(a)))
    return out


def data(seed=3):
    rnd = random.Random(seed)
    text = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    items = [(i, text(rnd.choice([1, 2, 4, 5, 6, 12, 30, 55]))) for i in range(25)] + [(90, None), (91, ""), (92, " .,")]
    items.append(items[7])
    docs = []
    for d in range(60):
        w = text(rnd.choice([0, 3, 20, 400, 3000])).split(" ")
        if d % 2:
            it = (rnd.choice(items[:25])[1]).upper().split(" ")
            for _ in range(rnd.randrange(3)):
                it[rnd.randrange(len(it))] = "changed"
            at = rnd.randrange(len(w) + 1)
            w[at:at] = it
        docs.append((d, ", ".join(w)))
    return [*docs, (100, None), (101, "")], items


def test_matches_brute_force_in_one_index_and_in_blocks(spark):
    docs, items = data()
    want = brute(docs, items)
    assert len(want) > 40
    dd = spark.createDataFrame([(*d, "n") for d in docs], "doc_id long, text string, item_id string")
    bb = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    for limit in (D.MAX_SHINGLES, 60):
        got = {tuple(r)[:4] for r in D.contained(dd, bb, max_shingles=limit).collect()}
        assert got == want
        kept = D.clean(dd, bb, max_shingles=limit)
        assert kept.columns == dd.columns
        assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {w[0] for w in want}


def test_empty_tables(spark):
    docs, items = data()
    dd, bb = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert D.contained(dd.limit(0), bb).count() == 0
    assert D.contained(dd, bb.filter("false")).count() == 0
    assert D.clean(dd, bb.filter("false")).count() == len(docs)
    assert D.contained(dd.union(dd), bb).count() == 2 * D.contained(dd, bb).count()


def test_an_index_near_its_bound_is_small():
    """What the driver, the broadcast and every worker hold for a quarter of a million shingles."""
    import pickle
    import tracemalloc

    rnd = random.Random(1)
    items = [(i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(100))) for i in range(2600)]
    tracemalloc.start()
    index = D.Index(items)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    shingles = sum(len(i[2]) for i in index.items)
    assert shingles > 249_000 and held < 40 * shingles and len(pickle.dumps(index)) < 30 * shingles


def test_copies_of_an_item_make_no_block_larger(spark):
    bb = spark.range(3000).selectExpr("7 item_id", "'one two three four five six' text")
    items = D._items(bb, "item_id", "text")
    assert [r.words for r in items.collect()] == [6] and len(D._blocks(items, 10)) == 1
    many = spark.range(50).selectExpr("id item_id", "concat('one two three four five ', id) text")
    blocks = D._blocks(D._items(many, "item_id", "text"), 30)
    assert sum(b.count() for b in blocks) == 50 and max(b.count() for b in blocks) <= 5


def test_long_and_clashing_rows(spark):
    text = "Some wörds, again and again: 日本 x1\n" * 60_000  # over one slice
    item = "one small item that hides in it"
    docs = spark.createDataFrame([(1, text + item + " " + text, 1, 2), (2, text, 1, 2), (3, None, 1, 2)], "doc_id long, text string, key int, words int")
    bench = spark.createDataFrame([(5, item, "a")], "item_id long, text string, words string")
    assert [r[:2] for r in map(tuple, D.contained(docs, bench).collect())] == [(1, 5)]
    for limit in (D.MAX_SHINGLES, 3):
        assert sorted(r.doc_id for r in D.clean(docs, bench, max_shingles=limit).collect()) == [2, 3]
