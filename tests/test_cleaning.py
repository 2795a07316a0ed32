import datetime as dt

from pyspark.sql import functions as F

from turfspark import schemas
from turfspark.functions import header, parsing
from turfspark.operators import cleaning


def one(spark, column, *values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_texts(spark):
    assert one(spark, parsing.weight("v"), "480(+4)", "466(0)", "計不", "--", None, "500(-12)") == [480, 466, None, None, None, 500]
    assert one(spark, parsing.weight_change("v"), "480(+4)", "466(0)", "計不", "500(-12)") == [4, 0, None, -12]
    assert one(spark, parsing.age("v"), "牡3", "セ10", "", None) == [3, 10, None, None]
    assert one(spark, parsing.sex("v"), "牡3", "セ10", "") == ["牡", "セ", None]
    assert one(spark, parsing.race_seconds("v"), "1:34.5", "1.34.5", "1:34:5", "", None, "94.5") == [94.5, 94.5, 94.5, None, None, None]
    assert one(spark, parsing.first_corner("v"), "10-9-7", "3", None, "") == [10, 3, None, None]
    assert one(spark, parsing.final_corner("v"), "10-9-7", "3", None) == [7, 3, None]
    assert one(spark, parsing.place_code("v"), "1東京3", "12阪神3", "6謎13", None, "札幌(地)") == ["05", "09", "99", "99", "58"]
    assert one(spark, parsing.race_type("v"), "芝1600", "ダ1150", "障3000", "謎1") == ["芝", "ダート", "障害", None]
    assert one(spark, parsing.hundreds("v"), "芝1600", "ダ1150", "1650", None) == [16, 11, 16, None]
    assert one(spark, parsing.japanese_date("v"), "2024年2月3日", "2024年13月3日", None) == [dt.date(2024, 2, 3), None, None]
    assert one(spark, parsing.post_timestamp("v", F.lit("09:50:00")), "2023-05-06 00:00:00", "x") == [dt.datetime(2023, 5, 6, 9, 50), None]
    assert one(spark, parsing.zero_padded("v", 5), "666", "1234567", None) == ["00666", "1234567", None]


def test_conform_types_pads_and_never_cuts(spark):
    df = spark.createDataFrame([(None, 666.0, float("nan")), (2.0, 1234567.0, 3.0)], "days double, jockey_id double, R double")
    rows = cleaning.conform_types(df, [("days", "int", 0), ("jockey_id", "string", 5), ("R", "int", 0), ("none", "int", 0)]).collect()
    assert [tuple(r) for r in rows] == [(0, "00666", 0), (2, "1234567", 3)]


def test_flags_are_taken_out_in_order(spark):
    df = spark.createDataFrame([("(国際)(特指)ハンデ",), ("3歳牝(混)[指]",), (None,)], "condition string")
    rows = header.condition_flags(df, rest="rest").collect()
    assert (rows[0].kokusai, rows[0].shitei, rows[0].tokushi, rows[0].toku, rows[0].handi) == (1, 1, 0, 1, 1)
    assert (rows[1].hinba, rows[1].kongo, rows[1].shitei) == (1, 1, 1) and rows[2].barei == 0


def test_header(spark):
    df = spark.createDataFrame(
        [
            ("1", "芝右 外2400m / 天候 : 曇 / 芝 : 良 / 発走 : 15:35", "2020年1月19日 1回京都7日目 4歳以上オープン特別 (国際)(特指)(ハンデ)"),
            ("2", "障芝 ダート3000m / 天候 : 晴 / 障芝 : 良  ダート : 稍重 / 発走 : 11:30", "2024年2月3日 2回東京1日目 障害4歳以上未勝利 (混)(定量)"),
            ("3", "ダ左1600m / 天候 : 謎 / ダート : 凍 / 発走 : 9:50", "2024年2月3日 1回中山12日目 3歳未勝利 牝[指](馬齢)"),
        ],
        "race_id string, text1 string, text2 string",
    )
    a, b, c = header.parse_race_header(df).orderBy("race_id").collect()
    assert (a.course_len, a.weather, a.race_type, a.time, a.date, a.times, a.days) == (2400, "曇", "芝", "15:35", dt.date(2020, 1, 19), 1, 7)
    assert (a.place, a.place_id, a.around, a.ground_state1, a.ground_state2, a.age, a.sex, a.race_class) == ("京都", "08", "右", "良", "良", "4+", None, "オープン特別")
    assert (b.around, b.ground_state1, b.ground_state2, b.days, b.shogai) == ("直線", "良", "稍重", 1, 1)
    assert (c.around, c.ground_state1, c.days, c.times, c.age, c.sex, c.barei) == ("左", None, 12, 1, "3", "牝", 1)
    wrong = cleaning.vocab_check(header.parse_race_header(df), {"weather": ("晴", "曇")}).collect()
    assert [tuple(r) for r in wrong] == [("3", "weather", "謎")]


def test_class_label(spark):
    assert one(spark, header.race_class(F.col("v")), "3歳500万下", "1000万下", "３勝クラス", "1600万下", "なし", "新馬") == ["1勝クラス", "2勝クラス", "3勝クラス", "3勝クラス", None, "新馬"]


def test_results(spark):
    rows = [
        ("r", "1", "1", "1", "a", "牡3", "55.0", "j", "", "", "2.5", "1", "480(+4)", "t", 1, "00666", "1", "2"),
        ("r", "中止", "1", "2", "b", "牝4", "55.0", "j", "", "", "---", "", "計不", "t", 2, "00667", "1", "2"),
        ("r", "4", "2", "3", "c", "セ10", "55.0", "j", "", "", "9.1", "3", "466(0)", "t", 3, "00668", "1", "2"),
    ]
    out = cleaning.clean_results(spark.createDataFrame(rows, schemas.RESULTS_RAW)).orderBy("umaban").collect()
    assert [(r.umaban, r.position, r.rank, r.n_horses, r.sex, r.age, r.weight, r.weight_change, r.jockey_id) for r in out] == [
        (1, 1, 1, 2, "牡", 3, 480, 4, "00666"), (3, 4, 0, 2, "セ", 10, 466, 0, "00668"),
    ]


def test_history(spark):
    nan = float("nan")
    rows = [
        (1, "2023/05/06", "1東京3", "晴", 9, "x", 10, nan, 1, 2.5, nan, "1", "j", 55.0, "ダ1150", "良", "1:09.5", -0.2, "10-9-7", "", 34.5, "", nan),
        (1, "2023/05/07", "謎", "晴", 9, "x", 10, 1.0, 1, 2.5, 3.0, "除外", "j", 55.0, "ダ1150", "良", "", None, None, "", 34.5, "", None),
        (1, "2023/05/08", "謎", "晴", 9, "x", 10, 1.0, 1, 2.5, 3.0, "5", "j", 55.0, "謎", "良", "", None, None, "", 34.5, "", 7.0),
    ]
    a, b = cleaning.clean_history(spark.createDataFrame(rows, schemas.HISTORY_RAW)).orderBy("date").collect()
    assert (a.place_code, a.race_type, a.course_len, a.time, a.margin, a.prize, a.first_to_final, a.final_to_rank, a.wakuban) == ("05", "ダート", 11, 69.5, 0.0, 0.0, 3, 6, None)
    assert (b.place_code, b.race_type, b.course_len, b.margin, b.prize, b.rank, b.first_corner) == ("99", None, None, None, 7.0, 0, None)


def test_card(spark):
    rows = [("202405010101", w, "1", str(i), "牡3", 55.0, "---", "1", 1, "芝", "良", "2024年2月3日", 1650) for i, w in enumerate(["480(+4)", "--", "0(0)"])]
    df = spark.createDataFrame(rows, "race_id string, weight_text string, wakuban string, umaban string, sex_age string, carried double, odds string, popularity string, horse_id long, race_type string, ground_state string, date string, course_len int")
    out = cleaning.clean_race_card(df).orderBy("umaban").collect()
    assert [(r.umaban, r.weight, r.n_horses, r.place_id, r.ground_state1, r.ground_state2, r.course_len, r.odds) for r in out] == [(0, 480, 2, 5, "良", "良", 16, None), (2, 0, 2, 5, "良", "良", 16, None)]
    assert {r.weight_text for r in cleaning.default_weights(df).collect()} == {"0(0)"}
