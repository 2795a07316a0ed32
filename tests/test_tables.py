import datetime as dt

import pytest
from pyspark.sql import functions as F

from turfspark.functions.ordering import grouped_totals, numbered, ranged, running_totals
from turfspark.operators import features, ml, policies, splitting
from turfspark.sources import page_files, pages, tables
from turfspark.streaming import raceday

HTML = """<table><tr><th>着順</th><th>馬名</th></tr><tr><td>1</td><td><a href="/horse/2019101234/">A &amp; B</a><table><tr><td>in</td></tr></table></td></tr></table>
<table><tr><th>複勝</th><td>3<br />7</td><td>1,200<br>340</td></tr></table><table><tr><td>open"""


def test_page_tables(spark):
    df = spark.createDataFrame([(1, HTML), (2, None), (3, "<p>no table")], "page_id long, html string")
    rows = pages.pages_to_tables(df)
    got = [tuple(r) for r in rows.orderBy("page_id", "table_no", "row_no").collect()]
    assert got == [(1, 0, 0, ["着順", "馬名"]), (1, 0, 1, ["1", "A & B"]), (1, 1, 0, ["in"]), (1, 2, 0, ["複勝", "3br7", "1,200br340"]), (1, 3, 0, ["open"])]
    assert [tuple(r) for r in pages.main_table(rows, ["position", "horse"]).collect()] == [(1, "1", "A & B")]
    assert [tuple(r) for r in pages.create_return_rows(rows).collect()] == [("1", "複勝", "3br7", "1,200br340")]
    assert [tuple(r) for r in pages.extract_links(df, pages.LINKS["horse"]).collect()] == [(1, 0, "2019101234")]


def test_files(spark, tmp_path):
    (tmp_path / "2024").mkdir()
    (tmp_path / "2024" / "202401010101.bin").write_bytes("<p>é</p>".encode())
    assert [tuple(r) for r in tables.read_pages(spark, str(tmp_path)).collect()] == [("202401010101", "<p>é</p>", "utf-8", False)]
    (tmp_path / "s.txt").write_text("14:15,202410020109\n09:50,202410020101\n")
    assert {r.race_id for r in tables.read_schedule(spark, str(tmp_path / "s.txt")).collect()} == {"202410020109", "202410020101"}
    df = spark.createDataFrame([("00666", 1)], "jockey_id string, `0` int")
    tables.write_csv(df, str(tmp_path / "csv"))
    assert tables.read_csv_typed(spark, str(tmp_path / "csv")).first().jockey_id == "00666"
    tables.write_table(df, str(tmp_path / "t"))
    assert tables.read_table(spark, str(tmp_path / "t"), names=["rank"]).columns == ["jockey_id", "rank"]


def test_upsert_is_idempotent_and_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "p")
    old = spark.createDataFrame([("1", "a", 2023), ("1", "b", 2023), ("2", "c", 2023), ("3", "d", 2024)], "race_id string, v string, year int")
    new = spark.createDataFrame([("1", "x", 2023), ("4", "y", 2023)], "race_id string, v string, year int")
    want = {("1", "x", 2023), ("2", "c", 2023), ("3", "d", 2024), ("4", "y", 2023)}
    once = tables.upsert_by_key(old, new)
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in tables.upsert_by_key(once, new).collect()}
    old.write.partitionBy("year").parquet(path)
    tables.upsert_partitions(spark, path, new)
    assert {(r.race_id, r.v, r.year) for r in spark.read.parquet(path).collect()} == want


def test_master_dates(spark):
    old, now = dt.datetime(2024, 1, 1), "2024-02-21 10:00:00"
    master = tables.touch_master(spark.createDataFrame([("a", old), ("b", old)], "id string, updated_at timestamp"), spark.createDataFrame([("b",), ("c",), ("c",)], "id string"), now)
    assert {r.id: r.updated_at.day for r in master.collect()} == {"a": 1, "b": 21, "c": 21}
    assert {r.id for r in tables.ids_updated_on(master, "2024-02-21").collect()} == {"b", "c"}


def test_numbering(spark):
    df = spark.createDataFrame([(v, i) for i, v in enumerate([5.0, 1.0, None, 5.0, 2.0, 1.0] * 40)], "v double, i int")
    got = [r.n for r in numbered(df, ["v", "i"], "n", 10, 8).orderBy(F.asc_nulls_first("v"), "i").collect()]
    assert got == list(range(10, 250))
    rows = running_totals(df, ["v", "i"], {"s": F.col("i")}, 8).orderBy(F.asc_nulls_first("v"), "i").collect()
    total = 0
    for r in rows:
        assert r.s == total
        total += r.i


def test_label_master(spark):
    df = spark.createDataFrame([(3, "b"), (1, "c"), (2, None), (4, "a"), (5, "c")], "o int, k string")
    rows, master = features.label_encode_master(df, "k", ["o"])
    assert {r.k: r.k_code for r in rows.collect()} == {"c": 0, "b": 1, "a": 2, None: None} and rows.count() == 5
    known = spark.createDataFrame([("a", 7), ("z", 3)], "id string, encoded_id long")
    rows, master = features.label_encode_master(df, "k", ["o"], known)
    assert {r.id: r.encoded_id for r in master.collect()} == {"a": 7, "z": 3, "c": 8, "b": 9}
    again, same = features.label_encode_master(df, "k", ["o"], master)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, master.collect()))


def test_one_hot_and_peds(spark):
    df = spark.createDataFrame([(1, "晴", "t"), (2, "謎", "t"), (3, None, "t")], "i int, weather string, time string")
    out = features.one_hot_fixed(df).orderBy("i")
    assert out.columns[:2] == ["i", "time"] and len(out.columns) == 8
    assert [r["weather__晴"] for r in out.collect()] == [1, 0, 0]
    peds = spark.createDataFrame([(1, "b", None), (2, "a", "x"), (3, "b", "x")], "horse_id int, peds_0 string, peds_1 string")
    assert {r.horse_id: (r.peds_0, r.peds_1) for r in features.clean_peds(peds, ["peds_0", "peds_1"]).collect()} == {1: (1, 0), 2: (0, 1), 3: (1, 1)}


def test_splits_keep_races_whole_and_in_order(spark):
    day = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(i, day + dt.timedelta(i // 3), u) for i in range(15) for u in range(2)] + [(99, None, 0)], "race_id int, date date, u int")
    rows = splitting.split_by_time(df).collect()
    fold = {r.race_id: r.fold for r in rows}
    assert len(rows) == 30 and len(fold) == 15
    assert [fold[i] for i in range(15)] == ["train"] * 7 + ["valid"] * 3 + ["test"] * 5  # round(10.5) is 10
    three = {r.race_id: r.fold for r in splitting.split_three_way(df, 0.21, 0.15).collect()}
    assert [three[i] for i in range(15)] == ["train"] * 10 + ["valid"] * 3 + ["test"] * 2


def test_active_races(spark):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    df = spark.createDataFrame([("01", "d", 5, at(9, 50)), ("02", "d", 5, at(10, 20)), ("03", "d", 5, at(12, 0)), ("01", "d", 6, at(10, 45))], "race_id string, date string, place_id int, post_time timestamp")
    now = lambda t: {(r.place_id, r.race_id) for r in raceday.active_races(df, t).collect()}
    assert now("2024-01-01 10:00:00") == {(5, "02"), (6, "01")}
    assert now("2024-01-01 08:00:00") == set()
    assert now("2024-01-01 11:00:00") == {(5, "03"), (6, "01")} - {(6, "01")}


def test_stream_scores_new_cards_once(spark, tmp_path):
    cards = str(tmp_path / "cards")
    rows = [("r1", "1", "1", "牡3", 55.0, "2.5", "1", "480(0)", 7, 1600, "良", "2024-02-03"), ("r1", "1", "2", "牝3", 55.0, "2.5", "1", "--", 8, 1600, "良", "2024-02-03"), ("r1", "2", "3", "牝3", 55.0, "2.5", "1", "470(0)", 9, 1600, "良", "2024-02-03")]
    schema = "race_id string, wakuban string, umaban string, sex_age string, carried double, odds string, popularity string, weight_text string, horse_id long, course_len int, ground_state string, date string"
    spark.createDataFrame(rows, schema).write.parquet(cards)
    history = spark.createDataFrame([(7, dt.date(2024, 1, 1), 1, 2.0), (9, dt.date(2024, 1, 2), 1, 4.0), (9, dt.date(2024, 2, 3), 1, 99.0)], "horse_id long, date date, R int, t double")
    batch = lambda b: raceday.day_of_scoring(b, history, lambda d: d.withColumn("score", F.col("t_allR")), ["t"])
    for _ in range(2):
        q = raceday.score_stream(spark.readStream.schema(schema).parquet(cards), batch, str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("score_rank").collect()
    assert [(r.umaban, r.score, r.score_rank) for r in out] == [(3, 1.0, 1), (1, -1.0, 2)]


def test_pages_are_files_named_by_their_key(spark, tmp_path):
    df = spark.createDataFrame([(12, "<p>é</p>"), (13, None), (14, "x\ny"), (14, "x"), (14, None), (15, "")], "page_id long, html string").repartition(2)
    to = str(tmp_path / "a folder" / "pages")
    assert tables.write_pages(df, to) == 4 == tables.write_pages(df, to)
    got = sorted(map(tuple, tables.read_pages(spark, to).select("page_id", "html").collect()))
    assert got == [("12", "<p>é</p>"), ("13", ""), ("14", "x\ny"), ("15", "")]
    with pytest.raises(Exception, match="no key"):
        tables.write_pages(df.union(spark.createDataFrame([(None, "x")], df.schema)), to)


JP = "<html><head>{}</head><td>馬番 着順 ｱｲｳ</td></html>"
SAVED = {
    "bom8": (b"\xef\xbb\xbf" + JP.encode(), "utf-8", False), "bom16": (b"\xff\xfe" + JP.encode("utf-16-le"), "utf-16-le", False),
    "euc": (JP.format("<meta charset='EUC-JP'>").encode("euc_jp"), "euc_jp", False),
    "sjis": (JP.format('<META http-equiv="Content-Type" content="text/html; charset=Shift_JIS">').encode("cp932"), "cp932", False),
    "tried_euc": (JP.replace("ｱｲｳ", "").encode("euc_jp"), "euc_jp", False), "tried_sjis": (JP.encode("cp932"), "cp932", False),
    "latin": (JP.replace("馬番 着順 ｱｲｳ", "é").format('<meta charset="iso-8859-1">').encode("latin1"), "cp1252", False),
    "unknown": (JP.format("<meta charset=none-such>").encode(), "utf-8", False), "wide": (JP.format("<meta charset=utf-16>").encode(), "utf-8", False),
    "bad": (b"<meta charset=utf-8>ok \xff\xfe end", "utf-8", True), "worse": (b"a \xff\x81", "utf-8", True), "empty": (b"", "utf-8", False),
    "two.dots": (b"x", "utf-8", False),
}


def saved(folder, names=None):
    for name in names or SAVED:
        to = folder / ("deep" if len(name) % 2 else ".") / f"{name}.bin"
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_bytes(SAVED[name][0])


def test_pages_of_several_charsets(spark, tmp_path):
    saved(tmp_path)
    (tmp_path / "other.txt").write_text("not a page")
    rows = {r.page_id: r for r in tables.read_pages(spark, str(tmp_path)).collect()}
    assert {k: (r.charset, r.damaged) for k, r in rows.items()} == {k: v[1:] for k, v in SAVED.items()}
    assert all("馬番" in rows[k].html for k in ("bom8", "bom16", "euc", "sjis", "tried_euc", "tried_sjis", "unknown"))
    assert rows["bad"].html.startswith("<meta charset=utf-8>ok ") and rows["bad"].html.endswith(" end") and rows["latin"].html.count("é") == 1
    assert rows["empty"].html == "" and rows["bom8"].html[0] == "<"
    told = {r.page_id: r for r in tables.read_pages(spark, str(tmp_path), charset="EUC-JP").collect()}
    assert told["tried_euc"].charset == "euc_jp" and not told["tried_euc"].damaged and told["tried_sjis"].damaged
    (tmp_path / "none").mkdir()
    assert tables.read_pages(spark, str(tmp_path / "none")).count() == 0


def test_small_pages_share_partitions(spark):
    files = [(f"f{i}", 10) for i in range(100)] + [("big", 1 << 30), ("next", 0)]
    parts = page_files.packed(files, 1 << 20)
    assert [len(p.paths) for p in parts] == [16] * 6 + [4, 1, 1] and sum((p.paths for p in parts), []) == [f for f, _ in files]


def test_pages_as_a_stream(spark, tmp_path):
    folder, out = tmp_path / "pages", str(tmp_path / "out")
    names = list(SAVED)
    for some in (names[:5], names[5:]):
        saved(folder, some)
        stream = tables.stream_pages(spark, str(folder), settle_seconds=0)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(60)
        got = sorted(r.page_id for r in spark.read.parquet(out).collect())
        assert got == sorted(names[: names.index(some[-1]) + 1])
    assert {r.page_id: (r.charset, r.damaged) for r in spark.read.parquet(out).collect()} == {k: v[1:] for k, v in SAVED.items()}


def test_cells_that_span_rows_and_columns():
    grid = lambda html: [(t, r, "|".join(c)) for t, r, c in pages.table_rows(html)]
    assert grid("<table><tr><td rowspan=2>a<td>b</tr><tr><td>c</table>") == [(0, 0, "a|b"), (0, 1, "a|c")]
    head = "<thead><tr><th colspan=2>h<th rowspan=5>i</tr><tr><th>j<th>k</tr></thead>"
    body = "<tbody><tr><td rowspan='0'>x<td colspan=' 2 '>y</tr><tr><td>z</tr><tr></tr></tbody><tfoot><tr><td>f</tr></tfoot>"
    assert grid(f"<table>{head}{body}</table>") == [(0, 0, "h|h|i"), (0, 1, "j|k|i"), (0, 2, "x|y|y"), (0, 3, "x|z"), (0, 4, "x"), (0, 5, "f")]
    inner = "<table><tr><td rowspan=2>1</td><td>2</td></tr><tr><td>3</td></tr></table>"
    nested = f"<table><tr><td rowspan=2>a{inner}b</td><td>c</td></tr><tr><td>d</td></tr></table>"
    assert grid(nested) == [(0, 0, "ab|c"), (0, 1, "ab|d"), (1, 0, "1|2"), (1, 1, "1|3")]
    # a cell beside one that hangs down; gaps are empty; odd spans count as 1
    assert grid("<table><tr><td>a<td>b<td rowspan=2>c<tr><td>d<tr><td colspan=x>e<td rowspan=-3>f</table>") == [(0, 0, "a|b|c"), (0, 1, "d||c"), (0, 2, "e|f")]
    assert grid("<table><tr><td>a<td rowspan=2 colspan=2>b<td>c<tr><td>d<td>e</table>") == [(0, 0, "a|b|b|c"), (0, 1, "d|b|b|e")]
    assert len(pages.table_rows("<table><tr><td colspan=99999>a</table>")[0][2]) == 1000


def test_a_key_that_changes_its_partition_is_moved(spark, tmp_path):
    path, schema = str(tmp_path / "p"), "race_id string, v string, year int"
    spark.createDataFrame([("1", "a", 2022), ("2", "c", 2023), ("3", "d", 2024), ("5", "e", None)], schema).write.partitionBy("year").parquet(path)
    tables.upsert_partitions(spark, path, spark.createDataFrame([("1", "x", 2023), ("3", "y", 2025), ("5", "z", 2024)], schema))
    assert {(r.race_id, r.v, r.year) for r in spark.read.parquet(path).collect()} == {("1", "x", 2023), ("2", "c", 2023), ("3", "y", 2025), ("5", "z", 2024)}


def test_one_value_of_the_leading_key_is_numbered_by_several_tasks(spark):
    df = spark.range(3000).selectExpr("if(id < 2700, 0, id % 7 - 3) d", "id i")
    parts = {(r["_part"], r.d) for r in ranged(df, ["d", "i"], 300).select("_part", "d").distinct().collect()}
    assert sum(d == 0 for _, d in parts) > 5
    got = numbered(df, ["d", "i"], "n", 0, 300).orderBy("d", "i").collect()
    assert [r.n for r in got] == list(range(3000))
    rows, master = features.label_encode_masters(df.selectExpr("d", "i", "cast(i AS string) k", "cast(i % 5 AS string) m"), ["k", "m"], ["d", "i"], part_rows=300)
    assert {r.i: r.k_code for r in rows.collect()} == {r.i: r.n for r in got}
    assert master["m"].count() == 5 and {r.encoded_id for r in master["m"].collect()} == set(range(5))


def test_masters_go_on_where_they_ended(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "c", "y")], "o int, k string, m string")
    old = {"k": spark.createDataFrame([("b", 7)], "id string, encoded_id long"), "m": None}
    rows, masters = features.label_encode_masters(df, ["k", "m"], ["o"], old)
    assert {r.o: (r.k_code, r.m_code) for r in rows.collect()} == {1: (8, 0), 2: (7, None), 3: (9, 1)}
    again, same = features.label_encode_masters(df, ["k", "m"], ["o"], masters)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert {c: sorted(map(tuple, m.collect())) for c, m in same.items()} == {"k": [("a", 8), ("b", 7), ("c", 9)], "m": [("x", 0), ("y", 1)]}
    assert features.label_encode_masters(df.limit(0), ["k", "m"], ["o"])[0].count() == 0


def test_a_model_is_loaded_with_its_masters(spark, tmp_path):
    rows = spark.range(200).selectExpr("id", "cast(id % 10 AS double) a", "cast(id % 7 AS double) b", "cast(id % 10 > 5 AS int) rank", "cast(id % 3 AS string) k")
    rows, masters = features.label_encode_masters(rows, ["k"], ["id"])
    x = ["a", "b", "k_code"]
    model = ml.train_classifier(rows, x, trees=2, depth=2)
    ml.save(model, masters, x, str(tmp_path / "m"))
    model2, masters2, x2 = ml.load(spark, str(tmp_path / "m"))
    fresh = features.label_encode_masters(rows.drop("k_code"), ["k"], ["id"], masters2)[0]
    want = {r.id: r.score for r in ml.score_runners(model, rows, x).collect()}
    assert x2 == x and {r.id: r.score for r in ml.score_runners(model2, fresh, x2).collect()} == want


def test_thresholds_come_from_the_scores(spark):
    s = spark.createDataFrame([(1.0,), (3.0,), (None,)], "score double")
    assert [r.threshold for r in policies.thresholds_of(s, 4).orderBy("i").collect()] == [1.0, 1.5, 2.0, 2.5]
    assert policies.thresholds_of(s.filter("score > 9"), 4).count() == 0


def test_sums_within_groups_that_cross_ranges(spark):
    """Also with null groups and orders, and groups that fill many ranges."""
    rows = [(None if i % 7 == 0 else 5 if i % 3 else i, None if i % 11 == 0 else i * 37 % 101, i) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, o int, v long").repartition(7)
    got = {r.v: (r.n, r.s) for r in grouped_totals(df, ["g"], ["o", "v"], {"n": F.lit(1), "s": F.col("v")}, part_rows=20).collect()}
    seen = {}
    for g, _, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        n, s = seen.get(g, (0, 0))
        assert got[v] == (n, s)
        seen[g] = (n + 1, s + v)
    assert len(got) == 300 and grouped_totals(df.limit(0), ["g"], ["o"], {"n": F.lit(1)}).count() == 0


def test_a_hot_id_and_rows_without_one_are_spread(spark, monkeypatch):
    """A third of all rows has one id and a third none; the same codes as by broadcast, and no task with a third of the rows."""
    df = spark.range(9000).selectExpr("id o", "case id % 3 when 0 then 'hot' when 1 then null else cast(id % 500 as string) end k", "cast(id % 7 as string) m")
    want = {r.o: (r.k, r.k_code, r.m_code) for r in features.label_encode_masters(df, ["k", "m"], ["o"])[0].collect()}
    monkeypatch.setattr(features, "BROADCAST_IDS", 20)
    monkeypatch.setattr(features, "HOT_ROWS", 100)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = features.label_encode_masters(df, ["k", "m"], ["o"])[0]
        assert {r.o: (r.k, r.k_code, r.m_code) for r in rows.collect()} == want
        spark.conf.set("spark.sql.shuffle.partitions", "30")
        sizes = [r["count"] for r in features.label_encode_masters(df, ["k"], ["o"])[0].groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 9000 and max(sizes) < 1000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert want[0][1] == 0 and want[1][1] is None


def test_stepwise_search_finds_the_best_of_the_grid(spark):
    """A planted rule of three features needs deep trees, whose noise small leaves learn by heart; few of the grid's fits."""
    rows = spark.range(3000).selectExpr("id", *[f"cast(pmod(xxhash64(id, {i}), 1000) AS double) / 1000 AS x{i}" for i in range(4)], "pmod(xxhash64(id, 9), 100) < 20 AS flipped")
    rows = rows.selectExpr("*", "cast(((x0 > 0.5) = (x1 > 0.5) AND x2 > 0.3) != flipped AS int) AS rank", "if(id % 10 = 0, null, x3) AS x4")
    train, valid = rows.filter("id < 2000"), rows.filter("id >= 2000")
    x = ["x0", "x1", "x2", "x4"]
    steps = (("size", ({"maxDepth": 1}, {"maxDepth": 2}, {"maxDepth": 4})), ("leaves", ({"minInstancesPerNode": 1}, {"minInstancesPerNode": 20}, {"minInstancesPerNode": 900})))
    model, table = ml.tune(train, valid, x, steps=steps, trees=8)
    fits = table.orderBy("fit").collect()
    area = lambda m: ml.auc(ml.score_runners(m, valid, x), "score", "rank").first().auc
    best = [r for r in fits if r.taken][-1]
    assert best.setting["maxDepth"] == "4" and best.setting["minInstancesPerNode"] != "900" and abs(area(model) - best.auc) < 1e-9
    assert best.auc == max(r.auc for r in fits if r.trees == 8) and best.auc > area(ml.train_classifier(train, x, trees=8, depth=1)) + 0.1
    assert [r.step for r in fits] == ["start", "size", "size", "size", "leaves", "leaves", "leaves"] and [r.trees for r in fits] == [8, 4, 4, 8, 4, 4, 8]
    assert all(1 <= r.kept <= r.trees for r in fits)


def test_a_search_without_validation_rows_stays_at_the_start(spark):
    rows = spark.range(60).selectExpr("cast(id % 10 AS double) a", "cast(id % 10 > 5 AS int) rank")
    steps = (("size", ({"maxDepth": 1}, {"maxDepth": 2})),)
    for valid in (rows.limit(0), rows.filter("rank = 1")):
        model, table = ml.tune(rows, valid, ["a"], steps=steps, trees=2)
        assert [(r.auc, r.taken) for r in table.orderBy("fit").collect()] == [(None, True), (None, False), (None, False)]
        assert ml.score_runners(model, rows, ["a"]).count() == 60


def test_more_trees_than_help_are_not_kept(spark):
    rows = spark.range(400).selectExpr("cast(pmod(xxhash64(id), 50) AS double) a", "cast(pmod(xxhash64(id, 1), 2) AS int) rank", "id")
    table = ml.tune(rows.filter("id < 200"), rows.filter("id >= 200"), ["a"], steps=(("size", ({"maxDepth": 5},)),), trees=30)[1]
    assert table.first().kept < 30


def test_equal_rows_are_learned_once_with_the_same_result(spark, monkeypatch):
    """Every fit but the one on a part of the rows gets the different rows only; least numbers of rows on a side, one of
    them exactly that of a value's rows and some beyond all rows, settle as they do row by row."""
    rows = spark.range(3000).selectExpr("id", "cast(if(id % 11 = 0, null, id % 5) AS double) a", "if(id % 100 < 7, -1, cast(pmod(xxhash64(id), 4) AS int)) b", "pmod(xxhash64(id, 9), 100) < 20 AS flipped")
    rows = rows.selectExpr("*", "cast((a > 2 AND b < 2 OR b = -1) != flipped AS int) AS r").selectExpr("*", "coalesce(r, 0) AS rank")
    train, valid = rows.filter("id < 2000"), rows.filter("id >= 2000")
    leaves = tuple({"minInstancesPerNode": n} for n in (1, 140, 141, 1000, 1001))
    steps = (("size", ({"maxDepth": 2}, {"maxDepth": 3})), ("leaves", leaves), ("rows", ({"subsamplingRate": 1.0}, {"subsamplingRate": 0.7})))
    assert train.filter("b = -1").count() == 140
    seen, plain = [], ml.GBTClassifier._fit

    def spy(self, data):
        seen.append((self.getSubsamplingRate(), data.count()))
        return plain(self, data)

    monkeypatch.setattr(ml.GBTClassifier, "_fit", spy)
    found = []
    for least in (ml.DIFFERENT_ROWS, -1):
        monkeypatch.setattr(ml, "DIFFERENT_ROWS", least)
        model, table = ml.tune(train, valid, ["a", "b"], steps=steps, trees=4)
        scores = {(r.a, r.b): r.score for r in ml.score_runners(model, rows.select("a", "b").distinct(), ["a", "b"]).collect()}
        single = ml.train_classifier(train, ["a", "b"], trees=4)
        found.append((table.orderBy("fit").collect(), scores, ml.score_runners(single, train, ["a", "b"]).orderBy("id").collect()))
    (fits, scores, ones), (fits_of_rows, scores_of_rows, ones_of_rows) = found
    drop = lambda r: [r[c] for c in ("fit", "step", "setting", "trees", "kept", "taken")]
    assert [drop(r) for r in fits] == [drop(r) for r in fits_of_rows] and len({round(r.auc, 6) for r in fits}) > 4
    assert all(abs(a.auc - b.auc) < 1e-9 for a, b in zip(fits, fits_of_rows, strict=True))
    assert all(abs(scores[k] - v) < 1e-9 for k, v in scores_of_rows.items()) and all(abs(a.score - b.score) < 1e-9 for a, b in zip(ones, ones_of_rows, strict=True))
    half = len(seen) // 2
    assert all((n <= 120) == (rate == 1.0) for rate, n in seen[:half]) and all(n >= 2000 for _, n in seen[half:])


def test_a_rewritten_partition_is_gathered(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    new = spark.range(400).select(F.col("id").alias("race_id"), (F.col("id") % 3).cast("int").alias("year")).repartition(8, "race_id")
    new.limit(0).write.partitionBy("year").parquet(path)
    upsert = dict(key="race_id", partition="year", staging=f"file://{tmp_path}/staging", schema=new.schema)
    tables.upsert_partitions(spark, path, new, **upsert)
    assert spark.read.schema(new.schema).parquet(path).count() == 400
    assert [len(list((tmp_path / "staging" / f"year={y}").glob("*.parquet"))) for y in range(3)] == [1, 1, 1]
