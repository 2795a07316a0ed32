"""Schemas of the stored tables, English names, and the names that the raw tables use."""

RESULTS = {
    "着順": "position", "枠番": "wakuban", "馬番": "umaban", "馬名": "horse", "性齢": "sex_age", "斤量": "carried", "騎手": "jockey", "タイム": "time_text",
    "着差": "margin_text", "単勝": "odds", "人気": "popularity", "馬体重": "weight_text", "調教師": "trainer",
}
HISTORY = {
    "日付": "date_text", "開催": "place_text", "天気": "weather", "レース名": "race_name", "頭数": "n_horses", "枠番": "wakuban", "馬番": "umaban",
    "オッズ": "odds", "人気": "popularity", "着順": "position", "騎手": "jockey", "斤量": "carried", "距離": "course_text", "馬場": "ground_state",
    "タイム": "time_text", "着差": "margin", "通過": "corner_text", "ペース": "pace", "上り": "last_3f", "馬体重": "weight_text", "賞金": "prize",
}
HORSE_INFO = {"生年月日": "birthday_text"}

RESULTS_RAW = (
    "race_id string, position string, wakuban string, umaban string, horse string, sex_age string, carried string, jockey string, time_text string, "
    "margin_text string, odds string, popularity string, weight_text string, trainer string, horse_id long, jockey_id string, trainer_id string, owner_id string"
)
HISTORY_RAW = (
    "horse_id long, date_text string, place_text string, weather string, R int, race_name string, n_horses int, wakuban double, umaban int, odds double, "
    "popularity double, position string, jockey string, carried double, course_text string, ground_state string, time_text string, margin double, "
    "corner_text string, pace string, last_3f double, weight_text string, prize double"
)
HORSE_INFO_RAW = "horse_id long, birthday_text string, trainer_id string, owner_id string, breeder_id string"
RETURNS_RAW = "race_id string, kind string, win string, payout string"
SCHEDULE = "time string, race_id string"
#: Ids that must stay text: their leading zeros matter.
TEXT_IDS = {"race_id": "string", "jockey_id": "string", "trainer_id": "string", "owner_id": "string", "breeder_id": "string", "place_id": "string"}
#: (column, type, width): floats that should be whole, ids that should have leading zeros.
CONFORM_RESULTS = [
    *((c, "int", 0) for c in ("days", "times", "teiryo", "barei", "bettei", "kokusai", "shitei", "tokushi", "toku", "handi", "minarai", "wakate", "shogai", "chiho", "gai", "kongo", "hinba")),
    ("trainer_id", "string", 5), ("jockey_id", "string", 5), ("owner_id", "string", 6),
]
CONFORM_HISTORY = [("R", "int", 0), ("wakuban", "int", 0), ("popularity", "int", 0), ("place_code", "string", 2)]
