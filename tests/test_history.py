import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from turfspark.operators import history as H
from turfspark.operators import history_state as S


def brute(runners, hist, targets, windows=(5, 9)):
    out = {}
    mean = lambda v: round(sum(v) / len(v), 6) if v else None
    for h, d, g in {(r[1], r[2], r[3]) for r in runners}:
        rows = sorted((x for x in hist if x[0] == h and x[1] < d), key=lambda x: (x[1], x[3]), reverse=True) if d and h is not None else []
        f = {"latest": rows[0][1] if rows else None}
        for k, t in enumerate(targets):
            value = lambda x, k=k: x[4 + k]
            for n in (*windows, None):
                some = rows[:n]
                ok = lambda v: v is not None and v == v
                name = f"{n}R" if n else "allR"
                f[f"{t}_{name}"] = mean([value(x) for x in some if ok(value(x))])
                f[f"{t}_g_{name}"] = mean([value(x) for x in some if g is not None and x[2] == g and ok(value(x))])
        out[h, d, g] = f
    return out


@pytest.mark.parametrize("path", ["fanout", "linear"])
@pytest.mark.parametrize("seed", [1, 2])
def test_paths_match_brute_force(spark, path, seed):
    rnd = random.Random(seed)
    day = lambda: dt.date(2023, 1, 1) + dt.timedelta(rnd.randrange(40))
    value = lambda: rnd.choice([None, float("nan"), 1.0, 2.5, 7.0, 3.25])
    # horse 0 has no history, horse 6 a long one
    hist = [(rnd.choice([1, 2, 3, 4, 5, 6, 6, 6, 6]), day(), rnd.choice(["a", "b", None]), i, value(), value()) for i in range(90)]
    runners = [(i, rnd.randrange(7), day(), rnd.choice(["a", "b", None]), "kept") for i in range(60)]
    runners += [(98, 6, None, "a", "kept"), (99, None, dt.date(2023, 1, 9), "a", "kept")]
    r = spark.createDataFrame(runners, "race_id int, horse_id int, date date, g string, quantity string")
    h = spark.createDataFrame(hist, "horse_id int, date date, g string, R int, t1 double, t2 double")
    got = H.history_features(r, h, ["t1", "t2"], ["g"], path=path)
    assert got.columns[:5] == r.columns
    want = brute(runners, hist, ["t1", "t2"])
    rows = got.collect()
    assert len(rows) == len(runners)
    for x in rows:
        for name, v in want[x.horse_id, x.date, x.g].items():
            assert (round(x[name], 6) if isinstance(x[name], float) else x[name]) == v, (name, x)


def test_no_same_day_or_later_row_counts(spark):
    d = dt.date(2023, 5, 6)
    r = spark.createDataFrame([(1, 1, d)], "race_id int, horse_id int, date date")
    h = spark.createDataFrame([(1, d, 1, 9.0), (1, d + dt.timedelta(1), 1, 9.0), (1, d - dt.timedelta(1), 1, 2.0)], "horse_id int, date date, R int, t double")
    for path in ("fanout", "linear"):
        x = H.history_features(r, h, ["t"], path=path).first()
        assert x.t_5R == x.t_allR == 2.0 and x.latest == d - dt.timedelta(1)


@pytest.mark.parametrize("path", ["fanout", "linear", "auto"])
def test_instants_of_one_day_never_count(spark, path):
    at = lambda d, h: dt.datetime(2023, 5, d, h)
    r = spark.createDataFrame([(1, 1, at(6, 12)), (2, 1, at(6, 7)), (3, 1, at(7, 0))], "race_id int, horse_id int, date timestamp")
    h = spark.createDataFrame([(1, at(6, 8), 1, 9.0), (1, at(5, 23), 1, 2.0), (1, at(7, 5), 1, 4.0)], "horse_id int, date timestamp, R int, t double")
    got = {x.race_id: x for x in H.history_features(r, h, ["t"], path=path).collect()}
    assert [got[i].t_5R for i in (1, 2, 3)] == [2.0, 2.0, 5.5] and [got[i].t_allR for i in (1, 2, 3)] == [2.0, 2.0, 5.5]
    assert got[1].latest == dt.date(2023, 5, 5) and got[1].date == at(6, 12)
    assert {(x.race_id, x.h_t) for x in H.asof_history(r, h, ["t"]).collect()} == {(1, 2.0), (2, 2.0), (3, 2.0), (3, 9.0)}


def test_a_large_entity_takes_the_linear_path(spark):
    r = spark.createDataFrame([(1, 1, dt.date(2030, 1, 1))], "race_id int, horse_id int, date date")
    h = spark.range(H.FANOUT_ROWS + 1).selectExpr("1 horse_id", "date_add(date '2020-01-01', cast(id AS int)) date", "id R", "cast(id AS double) t")
    plan = lambda rows: H.history_features(r, rows, ["t"])._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan(h) and "collect_list" not in plan(h.limit(50))


@pytest.mark.parametrize("kind", ["int", "float", "decimal(10,2)", "double"])
def test_both_paths_give_the_same_types(spark, kind):
    h = spark.createDataFrame([(1, dt.date(2024, 1, i), i, float(i)) for i in (1, 2, 3)], "horse_id int, date date, R int, t double").withColumn("t", F.col("t").cast(kind))
    r = spark.createDataFrame([(1, dt.date(2024, 2, 1))], "horse_id int, date date")
    fanout, linear = (H.history_features(r, h, ["t"], path=p) for p in ("fanout", "linear"))
    assert fanout.schema == linear.schema and fanout.schema["t_5R"].dataType.typeName() == "double"
    assert fanout.collect() == linear.collect() and fanout.first().t_allR == 2.0


def _some(seed, n=150):
    rnd = random.Random(seed)
    day = lambda: dt.date(2023, 1, 1) + dt.timedelta(rnd.randrange(40))
    value = lambda: rnd.choice([None, float("nan"), 1.0, 2.5, 7.0, 3.25])
    rows = [(rnd.choice([1, 2, 3, 4, 6, 6, 6, None]), day(), rnd.choice(["a", "b", None]), i, value(), value()) for i in range(n)]
    return rows + [(1, None, "a", 1, 1.0, 1.0)]


def _same(got, want):
    key = lambda r: (r[0] or -1, str(r[1:3]))
    fix = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert sorted(map(fix, got), key=key) == sorted(map(fix, want), key=key)


def test_state_after_every_merge_gives_the_full_features(spark, tmp_path):
    schema, path = "horse_id int, date date, g string, R int, t1 double, t2 double", str(tmp_path / "state")
    hist = spark.createDataFrame(_some(5), schema).cache()
    cuts = [dt.date(2023, 1, 1) + dt.timedelta(k) for k in (0, 9, 10, 25, 41)]
    none = S.state_of(hist.limit(0), ["t1", "t2"], ["g"])
    S.save(none, path, buckets=4)
    runners = lambda d: spark.createDataFrame([(h, d, g) for h in (1, 2, 3, 4, 5, 6, None) for g in ("a", "b", None)], "horse_id int, date date, g string")
    for begin, end in zip(cuts, cuts[1:], strict=False):
        day = hist.filter(F.col("date") >= begin).filter(F.col("date") < end)
        for _ in range(2):  # a day that comes twice counts once
            S.advance(spark, path, day, ["t1", "t2"], ["g"], buckets=4)
        r = runners(end)
        state = S.load(spark, path, none.schema, r, buckets=4)
        want = H.history_features(r, hist.filter(F.col("date") < end), ["t1", "t2"], ["g"], path="linear")
        got = S.features(r, state, ["t1", "t2"], ["g"])
        assert got.columns == want.columns
        _same(got.collect(), want.collect())
    with pytest.raises(Exception, match="earlier days"):
        S.features(runners(dt.date(2023, 1, 12)), state, ["t1", "t2"], ["g"]).collect()


def test_merging_is_the_same_in_any_order(spark):
    schema = "horse_id int, date date, g string, R int, t1 double, t2 double"
    parts = [S.state_of(spark.createDataFrame(_some(s, 60), schema), ["t1", "t2"], ["g"]) for s in (7, 8, 9)]
    rows = lambda df: [(r.horse_id, r.kind or "", r.category or "", r.n_t1, r.n_t2, round(r.s_t1 or 0, 6), r.last) for r in df.orderBy("horse_id", "kind", "category").collect()]
    a = rows(S.merge([S.merge([parts[0], parts[1]]), parts[2]]))
    assert a == rows(S.merge([parts[2], S.merge([parts[1], parts[0]])])) == rows(S.merge(parts))
    whole = S.state_of(spark.createDataFrame(_some(7, 60) + _some(8, 60) + _some(9, 60), schema), ["t1", "t2"], ["g"])
    assert [r[:6] for r in a] == [r[:6] for r in rows(whole)]
    assert all(len(r[6]) <= 9 for r in a if r[6] is not None)


def test_a_day_reads_only_the_buckets_of_its_entities(spark, tmp_path):
    path = str(tmp_path / "state")
    hist = spark.range(2000).selectExpr("cast(id as int) horse_id", "date'2023-01-01' date", "1 R", "1.0d t")
    S.save(S.state_of(hist, ["t"]), path, buckets=32)
    state = S.load(spark, path, S.state_of(hist, ["t"]).schema, hist.filter("horse_id in (3, 4)"), buckets=32)
    assert len(state.inputFiles()) == 32 and state.count() == 2
    assert "PartitionFilters: [bucket" in state._jdf.queryExecution().toString().replace("isnotnull(bucket", "x")
    before = {f: Path(f).stat().st_mtime_ns for f in map(str, Path(path).glob("bucket=*/*.parquet"))}
    S.advance(spark, path, hist.filter("horse_id in (3, 4)").withColumn("date", F.lit(dt.date(2023, 1, 2))), ["t"], buckets=32)
    after = {f: Path(f).stat().st_mtime_ns for f in map(str, Path(path).glob("bucket=*/*.parquet"))}
    assert sum(before.get(f) == t for f, t in after.items()) >= 30 and spark.read.parquet(path).count() == 2000


@pytest.mark.parametrize("spread", [1, 4, 16])
def test_a_hot_entity_is_joined_by_periods(spark, spread):
    rnd = random.Random(spread)
    day = lambda: rnd.choice([None, *[dt.date(2023, 1, 1) + dt.timedelta(rnd.randrange(30)) for _ in range(20)]])
    who = lambda: rnd.choice([7, 7, 7, None, *range(20)])
    runners = [(i, who(), day()) for i in range(300)] + [(1000, 7, dt.date(2024, 1, 1))] * 2
    hist = [(who(), day(), i) for i in range(400)] + [(7, dt.date(2023, 1, 5), 1000 + i) for i in range(200)]  # a hot day too
    r, h = spark.createDataFrame(runners, "race_id int, horse_id int, date date"), spark.createDataFrame(hist, "horse_id int, date date, t int")
    got = H.asof_history(r, h, ["t"], spread=spread)
    assert got.columns == ["race_id", "horse_id", "date", "h_date", "h_t"]
    want = [(i, e, d, hd, t) for i, e, d in runners for he, hd, t in hist if None not in (e, d, hd) and he == e and hd < d]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_pairs_of_a_hot_entity_spread_over_many_keys(spark):
    n, spread = 2000, 16
    rows = spark.range(n).selectExpr("cast(1 as int) as horse_id", "date_add(date'2020-01-01', cast(id % 700 as int)) as date", "id as t")
    keyed = rows.selectExpr("horse_id as _e", "unix_date(date) * 1048576L + pmod(xxhash64(t), 1048576L) as _at", "date", "t")
    r, h = H._spread_sides(keyed, keyed, "horse_id", spread)
    cells = r.groupBy("_i", "_j").count().join(h.groupBy("_i", "_j").agg(F.count("*").alias("m")), ["_i", "_j"]).collect()
    pairs = sorted(c["count"] * c["m"] for c in cells)
    assert len(cells) == spread * (spread + 1) // 2
    assert pairs[-1] < 2 * pairs[len(pairs) // 2] and abs(h.count() - n * (spread + 1) / 2) < n / 10


def test_asof_history_of_empty_tables(spark):
    r = spark.createDataFrame([(1, 1, dt.date(2023, 1, 1))], "race_id int, horse_id int, date date")
    h = spark.createDataFrame([], "horse_id int, date date, t int")
    assert H.asof_history(r, h, ["t"]).count() == 0 == H.asof_history(r.limit(0), r.select("horse_id", "date"), []).count()


def test_partitions_follow_the_rows(spark):
    h = spark.range(4000).selectExpr("cast(id % 300 as int) horse_id", "date_add(date'2020-01-01', cast(id % 700 as int)) date", "id R", "cast(id as double) t")
    r = h.select("horse_id", "date").distinct()
    few, many = (H.history_features(r, h, ["t"], path="linear", part_rows=n) for n in (1_000_000, 100))
    assert few.rdd.getNumPartitions() <= 16 and many.rdd.getNumPartitions() >= 40
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan
    assert sorted(few.collect()) == sorted(many.collect())


def test_many_rows_of_small_entities_are_not_joined(spark, monkeypatch):
    monkeypatch.setattr(H, "FANOUT_PAIRS", 1000)
    h = spark.range(400).selectExpr("cast(id % 20 as int) horse_id", "date_add(date'2020-01-01', cast(id % 70 as int)) date", "id R", "cast(id as double) t")
    got = H.history_features(h.select("horse_id", "date"), h, ["t"])
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("windows", [(5, 9), ()])
def test_a_hot_entity_is_reduced_by_day(spark, monkeypatch, windows):
    h = spark.createDataFrame([x for x in _some(11, 400) if x[0] != 4], "horse_id int, date date, g string, R int, t1 double, t2 double")
    r = h.select("horse_id", "date", "g")
    whole = H.history_features(r, h, ["t1", "t2"], ["g"], windows, path="linear")
    monkeypatch.setattr(H, "HOT_ROWS", 1)
    reduced = H.history_features(r, h, ["t1", "t2"], ["g"], windows, path="linear")
    key = lambda x: str(x[:3])
    fix = lambda x: tuple(round(v, 9) if isinstance(v, float) else v for v in x)
    assert sorted(map(fix, whole.collect()), key=key) == sorted(map(fix, reduced.collect()), key=key)
    assert reduced.schema == whole.schema
