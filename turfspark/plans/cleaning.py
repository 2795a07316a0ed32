"""Queries over cleaning: raw texts are built from the given columns, then parsed."""

from pyspark.sql import functions as F

from ..functions import header, parsing
from ..operators import cleaning
from ..vocab import CLASSES, CONDITIONS, GROUND, PLACES, SEXES, WEATHER
from .mapping import RUN, query, races, runners, table


def _of(values, index: str):
    """One of a list of texts by a number."""
    return F.get(F.array(*map(F.lit, values)), F.expr(index).cast("int"))


def _raw(spark, sf):
    q = F.col("l_quantity").cast("int")
    sign = F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey"),
        F.when(F.col("l_returnflag") == "N", "中止").otherwise(F.col("l_linenumber").cast("string")).alias("position"),
        F.concat(F.when(F.col("l_linestatus") == "O", "牡").otherwise("セ"), (q % 9).cast("string")).alias("sex_age"),
        F.when(F.col("l_linenumber") == 7, "計不").otherwise(F.concat((q + 400).cast("string"), F.lit("("), sign, F.col("l_linenumber").cast("string"), F.lit(")"))).alias("weight_text"),
        F.when(q % 5 > 0, F.concat_ws("-", (q % 17 + 1).cast("string"), (q % 13 + 1).cast("string"), (q % 11 + 1).cast("string"))).alias("corner_text"),
        F.concat((q % 3 + 1).cast("string"), F.lit(":"), F.lpad((q % 60).cast("string"), 2, "0"), F.lit("."), F.col("l_linenumber").cast("string")).alias("time_text"),
        F.concat(F.when(q % 3 == 0, "芝").when(q % 3 == 1, "ダ").otherwise("謎"), (q * 50 + 1000).cast("string")).alias("course_text"),
        q.alias("q"),
    )


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_linenumber AS position FROM lineitem WHERE l_returnflag <> 'N'")
def finished_only(spark, sf):
    return cleaning.finished_only(_raw(spark, sf)).select("l_orderkey", "l_partkey", "l_linenumber", "position")


@query("SELECT l_orderkey, l_partkey, l_linenumber, (l_linenumber < 4)::INTEGER AS rank FROM lineitem")
def top3_label(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", cleaning.top3_label("l_linenumber").alias("rank"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, CASE l_linestatus WHEN 'O' THEN '牡' ELSE 'セ' END AS sex, (l_quantity::INTEGER % 9)::INTEGER AS age FROM lineitem")
def split_sex_age(spark, sf):
    return _raw(spark, sf).select("l_orderkey", "l_partkey", "l_linenumber", parsing.sex("sex_age").alias("sex"), parsing.age("sex_age").alias("age"))


@query("""SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber <> 7 THEN (l_quantity::INTEGER + 400)::INTEGER END AS weight,
  CASE WHEN l_linenumber <> 7 THEN CASE l_linenumber % 2 WHEN 0 THEN l_linenumber ELSE -l_linenumber END END::INTEGER AS weight_change FROM lineitem""")
def split_weight(spark, sf):
    w = {"weight": parsing.weight("weight_text"), "weight_change": parsing.weight_change("weight_text")}
    return _raw(spark, sf).select("l_orderkey", "l_partkey", "l_linenumber", *[c.alias(n) for n, c in w.items()])


@query("SELECT l_orderkey, l_partkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n_horses FROM lineitem")
def field_size(spark, sf):
    return cleaning.field_size(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), "l_orderkey")


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 20 THEN p_retailprice END, 0) AS prize FROM part")
def fill_prize(spark, sf):
    return table(spark, sf, "part").select("p_partkey", cleaning.fill_prize(F.when(F.col("p_size") > 20, F.col("p_retailprice"))).alias("prize"))


@query("SELECT c_custkey, CASE WHEN c_nationkey > 3 THEN greatest(c_acctbal, 0) END AS margin FROM customer")
def clip_margin(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", cleaning.clip_margin(F.when(F.col("c_nationkey") > 3, F.col("c_acctbal"))).alias("margin"))


@query("""SELECT l_orderkey, l_partkey, l_linenumber, a AS first_corner, b AS final_corner, b - l_linenumber AS final_to_rank, a - l_linenumber AS first_to_rank, a - b AS first_to_final
  FROM (SELECT *, CASE WHEN q % 5 > 0 THEN (q % 17 + 1)::INTEGER END AS a, CASE WHEN q % 5 > 0 THEN (q % 11 + 1)::INTEGER END AS b FROM (SELECT *, l_quantity::INTEGER AS q FROM lineitem))""")
def corner_positions(spark, sf):
    c = cleaning.corner_positions("corner_text", "l_linenumber")
    return _raw(spark, sf).select("l_orderkey", "l_partkey", "l_linenumber", *[x.alias(n) for n, x in c.items()])


_PLACES = ", ".join(f"('{k}', '{v}')" for k, v in PLACES.items())


@query(f"""WITH place(name, code) AS (VALUES {_PLACES}), named AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '東京' WHEN 1 THEN '中山' WHEN 2 THEN '謎' ELSE 'フランス' END AS name FROM orders)
  SELECT o_orderkey, coalesce(code, '99') AS place_code FROM named LEFT JOIN place USING (name)""")
def place_code(spark, sf):
    k = F.col("o_orderkey") % 4
    name = F.when(k == 0, "東京").when(k == 1, "中山").when(k == 2, "謎").otherwise("フランス")
    return table(spark, sf, "orders").select("o_orderkey", parsing.place_code(F.concat(F.lit("1"), name, F.lit("3"))).alias("place_code"))


@query("""SELECT l_orderkey, l_partkey, l_linenumber, CASE q % 3 WHEN 0 THEN '芝' WHEN 1 THEN 'ダート' END AS race_type, ((q * 50 + 1000) // 100)::INTEGER AS course_len
  FROM (SELECT *, l_quantity::INTEGER AS q FROM lineitem)""")
def race_type_and_distance(spark, sf):
    return _raw(spark, sf).select("l_orderkey", "l_partkey", "l_linenumber", parsing.race_type("course_text").alias("race_type"), parsing.hundreds("course_text").alias("course_len"))


@query("""SELECT l_orderkey, l_partkey, l_linenumber, round((q % 3 + 1) * 60.0::DOUBLE + q % 60 + l_linenumber / 10.0::DOUBLE, 4) AS seconds FROM (SELECT *, l_quantity::INTEGER AS q FROM lineitem)""")
def race_time_seconds(spark, sf):
    return _raw(spark, sf).select("l_orderkey", "l_partkey", "l_linenumber", F.round(parsing.race_seconds("time_text"), 4).alias("seconds"))


@query(f"""WITH {RUN}, kept AS (SELECT * FROM run WHERE flag <> 'N') SELECT race_id, umaban AS position, (umaban < 4)::INTEGER AS rank, wakuban, umaban, CASE WHEN flag = 'A' THEN '牡' ELSE '牝' END AS sex,
  (quantity::INTEGER % 9)::INTEGER AS age, (quantity::INTEGER + 400)::INTEGER AS weight, 4 AS weight_change, count(*) OVER (PARTITION BY race_id)::INTEGER AS n_horses, horse_id FROM kept""")
def clean_results(spark, sf):
    raw = runners(spark, sf).select(
        "race_id", F.when(F.col("flag") == "N", "除外").otherwise(F.col("umaban").cast("string")).alias("position"), F.col("wakuban").cast("string").alias("wakuban"),
        F.col("umaban").cast("string").alias("umaban"), F.concat(F.when(F.col("flag") == "A", "牡").otherwise("牝"), (F.col("quantity").cast("int") % 9).cast("string")).alias("sex_age"),
        F.lit("55.0").alias("carried"), F.lit("---").alias("odds"), F.lit("").alias("popularity"), F.concat((F.col("quantity").cast("int") + 400).cast("string"), F.lit("(+4)")).alias("weight_text"), "horse_id",
    )
    return cleaning.clean_results(raw).drop("carried", "odds", "popularity")


def _history_sql() -> str:
    code = "CASE o.p " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in list(PLACES.items())[:10]) + " END"
    return f"""WITH o AS (SELECT *, l_quantity::INTEGER AS q, l_linenumber AS u, {list(PLACES)[:10]}[l_orderkey % 10 + 1] AS p FROM lineitem),
  c AS (SELECT *, {code} AS place_code, CASE WHEN q % 5 > 0 THEN (q % 17 + 1)::INTEGER END AS a, CASE WHEN q % 5 > 0 THEN (q % 11 + 1)::INTEGER END AS b FROM o)
  SELECT l_partkey AS horse_id, l_shipdate::DATE AS date, l_orderkey::INTEGER AS R, place_code, {list(WEATHER)}[l_orderkey % 6 + 1] AS weather, (u + 9)::INTEGER AS n_horses, CASE WHEN u % 3 > 0 THEN u END::INTEGER AS wakuban,
    (u * 2)::INTEGER AS umaban, round(1 + l_discount * 10, 1) AS odds, CASE WHEN u <> 5 THEN u END::INTEGER AS popularity, u::INTEGER AS position, (u < 4)::INTEGER AS rank, (50 + u * 0.5)::DOUBLE AS carried,
    CASE q % 3 WHEN 0 THEN '芝' WHEN 1 THEN 'ダート' END AS race_type, ((q * 50 + 1000) // 100)::INTEGER AS course_len, {list(GROUND)}[l_orderkey % 4 + 1] AS ground_state,
    round((q % 3 + 1) * 60.0::DOUBLE + q % 60 + u / 10.0::DOUBLE, 4) AS time, CASE WHEN u <> 6 THEN greatest(round(l_tax - 0.04, 2), 0) END::DOUBLE AS margin, a AS first_corner, b AS final_corner,
    (b - u)::INTEGER AS final_to_rank, (a - u)::INTEGER AS first_to_rank, a - b AS first_to_final, round(30 + q / 10.0, 1)::DOUBLE AS last_3f, CASE WHEN q >= 20 THEN l_extendedprice ELSE 0 END::DOUBLE AS prize
  FROM c WHERE l_returnflag <> 'N'"""


@query(_history_sql())
def clean_history(spark, sf):
    q, u, nan = F.col("q"), F.col("l_linenumber"), F.lit(float("nan"))
    more = table(spark, sf, "lineitem").withColumn("q", F.col("l_quantity").cast("int"))
    raw = more.select(
        F.col("l_partkey").alias("horse_id"), F.date_format("l_shipdate", "yyyy/MM/dd").alias("date_text"), F.concat(F.lit("1"), _of(list(PLACES)[:10], "l_orderkey % 10"), F.lit("3")).alias("place_text"),
        _of(WEATHER, "l_orderkey % 6").alias("weather"), F.col("l_orderkey").cast("int").alias("R"), (u + 9).cast("int").alias("n_horses"), F.when(u % 3 > 0, u.cast("double")).otherwise(nan).alias("wakuban"),
        (u * 2).cast("int").alias("umaban"), F.round(F.lit(1.0) + F.col("l_discount") * 10, 1).alias("odds"), F.when(u == 5, nan).otherwise(u.cast("double")).alias("popularity"),
        F.when(F.col("l_returnflag") == "N", "中止").otherwise(u.cast("string")).alias("position"), (50 + u * 0.5).alias("carried"),
        F.concat(F.when(q % 3 == 0, "芝").when(q % 3 == 1, "ダ").otherwise("謎"), (q * 50 + 1000).cast("string")).alias("course_text"), _of(GROUND, "l_orderkey % 4").alias("ground_state"),
        F.concat((q % 3 + 1).cast("string"), F.lit("."), F.lpad((q % 60).cast("string"), 2, "0"), F.lit("."), u.cast("string")).alias("time_text"),
        F.when(u == 6, nan).otherwise(F.round(F.col("l_tax") - 0.04, 2)).alias("margin"),
        F.when(q % 5 > 0, F.concat_ws("-", (q % 17 + 1).cast("string"), (q % 13 + 1).cast("string"), (q % 11 + 1).cast("string"))).alias("corner_text"), F.round(F.lit(30.0) + q / 10, 1).alias("last_3f"),
        F.when(q < 20, nan).otherwise(F.col("l_extendedprice")).alias("prize"),
    )
    return cleaning.clean_history(raw).withColumn("time", F.round("time", 4))


@query("SELECT o_orderkey, o_orderdate::DATE AS date, ((1000 + o_orderkey % 1500) // 100)::INTEGER AS course_len, (o_orderkey % 10 + 1)::INTEGER AS place_id FROM orders")
def clean_race_info(spark, sf):
    raw = table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy年M月d日").alias("date"), (1000 + F.col("o_orderkey") % 1500).cast("string").alias("course_len"),
        F.lpad((F.col("o_orderkey") % 10 + 1).cast("string"), 2, "0").alias("place_id"), F.lit("3").alias("age"), F.lit("牝").alias("sex"),
    )
    return cleaning.clean_race_info(raw)


_FLAG_WORDS = ["(国際)", "[指]", "(特指)", "ハンデ", "定量", "牝", "(混)", "九州産馬", "2勝クラス"]


def _conditions(spark, sf):
    words = [F.when(F.col("o_orderkey").bitwiseAND(1 << i) > 0, w) for i, w in enumerate(_FLAG_WORDS)]
    return table(spark, sf, "orders").select("o_orderkey", F.concat_ws("", *words).alias("condition"))


def _flags_sql() -> str:
    text = " || ".join(f"CASE WHEN (o_orderkey & {1 << i}) > 0 THEN '{w}' ELSE '' END" for i, w in enumerate(_FLAG_WORDS))
    inner, names = f"SELECT o_orderkey, {text} AS t FROM orders", []
    for word, name in CONDITIONS.items():
        inner = f"SELECT o_orderkey, {''.join(n + ', ' for n in names)}contains(t, '{word}')::INTEGER AS {name}, replace(t, '{word}', '') AS t FROM ({inner})"
        names.append(name)
    return f"SELECT o_orderkey, {', '.join(names)} FROM ({inner})"


@query(_flags_sql())
def condition_flags(spark, sf):
    return header.condition_flags(_conditions(spark, sf)).drop("condition")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN '稍重' ELSE '良' END AS ground_state1, CASE o_orderkey % 3 WHEN 0 THEN '良' WHEN 1 THEN '不良' ELSE '稍重' END AS ground_state2 FROM orders""")
def ground_states(spark, sf):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, "芝 : 良").when(k == 1, "障芝 : 良 ダート : 不良").otherwise("ダート : 稍重")
    one, two = header.ground_states(text)
    return table(spark, sf, "orders").select("o_orderkey", one.alias("ground_state1"), two.alias("ground_state2"))


@query("SELECT event_id, date_trunc('minute', ts)::VARCHAR AS post FROM events")
def post_timestamp(spark, sf):
    stamp = parsing.post_timestamp(F.date_format("ts", "yyyy-MM-dd 00:00:00"), F.date_format("ts", "HH:mm"))
    return table(spark, sf, "events").select("event_id", F.date_format(stamp, "yyyy-MM-dd HH:mm:ss").alias("post"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'G2' ELSE CASE o_orderkey % 5 WHEN 0 THEN '1勝クラス' WHEN 1 THEN '2勝クラス' WHEN 2 THEN 'オープン特別' WHEN 3 THEN '3勝クラス' ELSE '未勝利' END END AS race_class FROM orders""")
def race_class_label(spark, sf):
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, "3歳500万下").when(k == 1, "４歳以上２勝クラス").when(k == 2, "オープン特別").when(k == 3, "1600万下").otherwise("2歳未勝利")
    grade = F.when(F.col("o_orderstatus") == "P", "第9回記念(G2)").otherwise("特別")
    return table(spark, sf, "orders").select("o_orderkey", header.race_class(text, grade).alias("race_class"))


_AGES, _SURFACES, _HEADER_WORDS = ("2歳", "3歳", "4歳以上"), ("芝", "ダート", "障芝"), ["(国際)", "[指]", "(特指)", "ハンデ", "定量", "牝", "(混)", "九州産馬"]
_PLACE_NAMES = list(PLACES)[:10]


def _sql_of(values, index: str) -> str:
    return f"({list(values)})[({index.replace(' div ', ' // ')}) + 1]"


def _header_sql() -> str:
    words = " || ".join(f"CASE WHEN ((o_orderkey // 3) & {1 << i}) > 0 THEN '{w}' ELSE '' END" for i, w in enumerate(_HEADER_WORDS))
    names, inner = [], f"""SELECT *, {_sql_of(_AGES, 'o_orderkey % 3')} || {_sql_of(CLASSES, 'o_orderkey % 11')} || ' ' || {words} AS t, t AS whole FROM orders"""
    for word, name in CONDITIONS.items():
        inner = f"SELECT * EXCLUDE (t), contains(t, '{word}')::INTEGER AS {name}, replace(t, '{word}', '') AS t FROM ({inner})"
        names.append(name)
    rest = "regexp_replace(trim(t), '[0-9]+歳(以上)?', '', 'g')"
    for w in (*SEXES, *sorted(CLASSES, key=len, reverse=True), "()", "[]"):
        rest = f"replace({rest}, '{w}', '')"
    return f"""SELECT o_orderkey, (1000 + 100 * (o_orderkey % 20))::INTEGER AS course_len, {_sql_of(WEATHER, 'o_orderkey % 6')} AS weather, {_sql_of(_SURFACES, 'o_orderkey % 3')} AS race_type,
      (9 + o_orderkey % 8)::VARCHAR || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') AS time, o_orderdate::DATE AS date, (1 + o_orderkey % 12)::INTEGER AS days, (1 + o_orderkey % 5)::INTEGER AS times,
      {_sql_of(_PLACE_NAMES, 'o_orderkey % 10')} AS place, lpad((1 + o_orderkey % 10)::VARCHAR, 2, '0') AS place_id, CASE WHEN o_orderkey % 3 = 2 THEN '直線' WHEN o_orderkey % 2 = 0 THEN '右' ELSE '左' END AS around,
      {_sql_of(GROUND, 'o_orderkey % 4')} AS ground_state1, CASE WHEN o_orderkey % 3 = 2 THEN {_sql_of(GROUND, '(o_orderkey // 4) % 4')} ELSE {_sql_of(GROUND, 'o_orderkey % 4')} END AS ground_state2,
      {_sql_of(('2', '3', '4+'), 'o_orderkey % 3')} AS age, CASE WHEN contains(whole, '牝') THEN '牝' END AS sex, {_sql_of(CLASSES, 'o_orderkey % 11')} AS race_class, {", ".join(names)},
      nullif(trim(regexp_replace({rest}, '\\s+', ' ', 'g')), '') AS race_condition FROM ({inner})"""


@query(_header_sql())
def parse_race_header(spark, sf):
    k = F.col("o_orderkey")
    surface, ground = _of(_SURFACES, "o_orderkey % 3"), _of(GROUND, "o_orderkey % 4")
    course = F.concat(_of(("芝", "ダ", "障芝"), "o_orderkey % 3"), _of(("右", "左"), "o_orderkey % 2"), (1000 + 100 * (k % 20)).cast("string"), F.lit("m"))
    state = F.concat(surface, F.lit(" : "), ground, F.when(k % 3 == 2, F.concat(F.lit(" ダート : "), _of(GROUND, "(o_orderkey div 4) % 4"))).otherwise(""))
    post = F.concat((9 + k % 8).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))
    words = [F.when(F.expr(f"(o_orderkey div 3) & {1 << i}") > 0, w) for i, w in enumerate(_HEADER_WORDS)]
    one = F.concat(course, F.lit(" / 天候 : "), _of(WEATHER, "o_orderkey % 6"), F.lit(" / "), state, F.lit(" / 発走 : "), post)
    meeting = F.concat((1 + k % 5).cast("string"), F.lit("回"), _of(_PLACE_NAMES, "o_orderkey % 10"), (1 + k % 12).cast("string"), F.lit("日目"))
    two = F.concat(F.date_format("o_orderdate", "yyyy年M月d日"), F.lit(" "), meeting, F.lit(" "), _of(_AGES, "o_orderkey % 3"), _of(CLASSES, "o_orderkey % 11"), F.lit(" "), F.concat_ws("", *words))
    return header.parse_race_header(table(spark, sf, "orders").select("o_orderkey", one.alias("text1"), two.alias("text2"))).drop("text1", "text2")


@query("""SELECT o_orderkey, (1000 + 100 * (o_orderkey % 20))::INTEGER AS course_len, '曇' AS weather, CASE WHEN o_orderkey % 2 = 0 THEN '稍重' ELSE '良' END AS ground_state,
  CASE WHEN o_orderkey % 3 = 0 THEN '障害' ELSE 'ダート' END AS race_type, CASE WHEN o_orderkey % 3 = 0 THEN '直線' ELSE '左' END AS around,
  CASE WHEN o_orderkey % 3 = 0 THEN '障害' WHEN o_orderkey % 5 = 0 THEN 'G1' ELSE '1勝クラス' END AS race_class FROM orders""")
def card_race_fields(spark, sf):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("10:05発走 / "), F.when(k % 3 == 0, "障").otherwise("ダ"), (1000 + 100 * (k % 20)).cast("string"), F.lit("m (左) / 天候:曇 / 馬場:"), F.when(k % 2 == 0, "稍").otherwise("良"), F.lit(" 1回 東京 ４歳以上 １勝クラス"))
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("text"), F.when(k % 5 == 0, "G1").alias("grade"))
    return header.card_race_fields(rows).drop("text", "grade")


@query("""SELECT o_orderkey AS race_id, 'weather' AS "column", '謎' AS value FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 'ground', o_orderpriority FROM orders WHERE o_orderkey % 3 = 1""")
def vocab_check(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(k.alias("race_id"), F.when(k % 7 == 0, "謎").otherwise("晴").alias("weather"), F.when(k % 3 == 1, F.col("o_orderpriority")).when(k % 3 == 2, "良").alias("ground"))
    return cleaning.vocab_check(rows, {"weather": WEATHER, "ground": GROUND})


@query("SELECT c_custkey AS horse_id, (DATE '2015-01-01' + c_nationkey * 30)::DATE AS birthday, c_name AS owner_id, c_mktsegment AS breeder_id FROM customer")
def clean_horse_info(spark, sf):
    day = F.date_add(F.lit("2015-01-01").cast("date"), F.col("c_nationkey") * 30)
    raw = table(spark, sf, "customer").select(F.col("c_custkey").alias("horse_id"), F.date_format(day, "yyyy年M月d日").alias("birthday_text"), F.col("c_name").alias("owner_id"), F.col("c_mktsegment").alias("breeder_id"), F.lit(1).alias("x"))
    return cleaning.clean_horse_info(raw)


@query(f"""WITH {RUN} SELECT race_id, umaban, wakuban, horse_id, (count(*) OVER (PARTITION BY race_id))::INTEGER AS n_horses, o_orderdate::DATE AS date, '良' AS ground_state1, '良' AS ground_state2, 16 AS course_len
  FROM run JOIN orders ON o_orderkey = race_id WHERE flag <> 'N'""")
def clean_race_card(spark, sf):
    days = races(spark, sf).select("race_id", F.date_format("date", "yyyy年M月d日").alias("date"))
    raw = runners(spark, sf).join(days, "race_id").select(
        "race_id", F.col("wakuban").cast("string").alias("wakuban"), F.col("umaban").cast("string").alias("umaban"), F.lit("牡3").alias("sex_age"), F.lit(55.0).alias("carried"), F.lit("---").alias("odds"),
        F.lit("1").alias("popularity"), F.when(F.col("flag") == "N", "--").otherwise("480(+4)").alias("weight_text"), "horse_id", F.lit(1650).alias("course_len"), F.lit("良").alias("ground_state"), "date",
    )
    return cleaning.clean_race_card(raw).select("race_id", "umaban", "wakuban", "horse_id", "n_horses", "date", "ground_state1", "ground_state2", "course_len")


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'A'")
def drop_scratched(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.when(F.col("l_returnflag") == "A", "--").otherwise("480(0)").alias("weight_text"))
    return cleaning.drop_scratched(rows).drop("weight_text")


@query("SELECT l_orderkey, l_partkey, l_linenumber, 0 AS weight, 0 AS weight_change FROM lineitem")
def default_weights(spark, sf):
    rows = cleaning.default_weights(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"))
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", parsing.weight("weight_text").alias("weight"), parsing.weight_change("weight_text").alias("weight_change"))


@query("SELECT c_custkey, CASE WHEN c_nationkey > 5 THEN c_nationkey ELSE 0 END::INTEGER AS days, lpad(c_custkey::VARCHAR, greatest(5, length(c_custkey::VARCHAR))::INTEGER, '0') AS jockey_id FROM customer")
def conform_types(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_nationkey") > 5, F.col("c_nationkey").cast("double")).alias("days"), F.col("c_custkey").alias("jockey_id"))
    return cleaning.conform_types(rows, [("days", "int", 0), ("jockey_id", "string", 5)])


@query("SELECT n_nationkey AS nation, n_name AS nationname FROM nation")
def strip_column_spaces(spark, sf):
    return cleaning.strip_column_spaces(table(spark, sf, "nation").select(F.col("n_nationkey").alias(" nation"), F.col("n_name").alias("nation name")))
