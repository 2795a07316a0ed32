"""Queries over payouts, policies, settlement and the threshold sweep, and race-day queries."""

from pyspark.sql import functions as F

from ..operators import features, payouts, policies, scoring, settlement
from ..operators.joins import union_batches
from ..streaming import raceday
from ..streaming.history_stream import state_store
from ..streaming.race_events import race_events as fired_events
from ..sources.scratch import scratch_path
from ..vocab import DIRECTIONS, WEATHER
from .mapping import PAY, RUN, SCORED, day_rows, day_sql, payout_texts, query, races, runners, table

THRESHOLD = 0.3


def _payouts(spark, sf):
    return payouts.parse_payouts(payout_texts(runners(spark, sf)))


def _scores(spark, sf):
    """Rounded: thresholds are compared alike by either engine."""
    return scoring.score_std(runners(spark, sf).withColumn("score", F.col("quantity"))).withColumn("score", F.round("score", 9))


def _text(df, *columns):
    return df.withColumns({c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))) for c in columns})


@query(f"WITH {PAY} SELECT race_id, ticket_type, seq, array_to_string(win, ',') AS win, payout FROM pay")
def parse_payouts(spark, sf):
    return _text(_payouts(spark, sf), "win")


@query(f"WITH {PAY} SELECT ticket_type, (max(seq) + 1)::INTEGER AS winners FROM pay GROUP BY ticket_type")
def max_winners(spark, sf):
    return payouts.max_winners(payout_texts(runners(spark, sf)))


GRID = policies.threshold_grid()
_GRID = "grid AS (SELECT 3.5::DOUBLE * i / 100 + 0.5::DOUBLE * (1 - i / 100::DOUBLE) AS threshold FROM range(100) t(i))"


@query(f"""WITH {RUN}, {SCORED}, e AS (SELECT min(score) AS low, max(score) AS high FROM score)
  SELECT i::INTEGER AS i, round(high * i / 100 + low * (1 - i / 100::DOUBLE), 6) AS threshold FROM range(100) t(i), e""")
def threshold_grid(spark, sf):
    return policies.thresholds_of(_scores(spark, sf)).select("i", F.round("threshold", 6).alias("threshold"))


@query(f"WITH {RUN}, {SCORED}, {_GRID} SELECT race_id, umaban, round(threshold, 6) AS threshold FROM score JOIN grid ON score >= threshold")
def threshold_pick(spark, sf):
    return policies.threshold_pick(_scores(spark, sf), GRID).select("race_id", "umaban", F.round("threshold", 6).alias("threshold"))


@query(f"WITH {RUN}, {SCORED} SELECT race_id, string_agg(umaban::VARCHAR, ',' ORDER BY umaban) AS picks FROM score WHERE score >= {THRESHOLD} GROUP BY race_id HAVING count(*) >= 2")
def picks_per_race(spark, sf):
    picked = _scores(spark, sf).filter(F.col("score") >= THRESHOLD)
    return _text(policies.picks_per_race(picked, "umaren"), "picks").drop("ticket_type")


def _picks_sql(ticket: str) -> str:
    number, flag = ("wakuban", " AND wakuban_flag = 1") if ticket == "wakuren" else ("umaban", "")
    return f"SELECT race_id, '{ticket}' AS ticket_type, list({number} ORDER BY {number}) AS picks FROM score WHERE score >= {THRESHOLD}{flag} GROUP BY race_id HAVING count(*) >= {policies.LEAST[ticket]}"


POLICIES = {
    "tansho": policies.policy_tansho, "fukusho": policies.policy_fukusho, "wakuren": policies.policy_wakuren_box, "umaren": policies.policy_umaren_box,
    "umatan": policies.policy_umatan_box, "wide": policies.policy_wide_box, "sanrenpuku": policies.policy_sanrenpuku_box, "sanrentan": policies.policy_sanrentan_box,
}
COUNT = {
    "tansho": "len(picks)", "fukusho": "len(picks)", "wakuren": "len(list_distinct(picks)) * (len(list_distinct(picks)) + 1) // 2", "umaren": "len(picks) * (len(picks) - 1) // 2",
    "wide": "len(picks) * (len(picks) - 1) // 2", "umatan": "len(picks) * (len(picks) - 1)", "sanrenpuku": "len(picks) * (len(picks) - 1) * (len(picks) - 2) // 6",
    "sanrentan": "len(picks) * (len(picks) - 1) * (len(picks) - 2)",
}


def _settled_sql(ticket: str) -> str:
    return f"""SELECT race_id, ticket_type, array_to_string(picks, ',') AS picks, ({COUNT[ticket]})::BIGINT AS n_bets, ({COUNT[ticket]} * 100)::BIGINT AS bet_amount, back::DOUBLE AS return_amount, (back > 0)::INTEGER AS hit
  FROM (SELECT b.*, coalesce((SELECT sum(payout) FROM pay WHERE pay.race_id = b.race_id AND pay.ticket_type = b.ticket_type AND list_has_all(b.picks, pay.win)), 0) AS back FROM ({_picks_sql(ticket)}) b)"""


def _register(ticket: str) -> None:
    def policy(spark, sf):
        return _text(POLICIES[ticket](_scores(spark, sf), THRESHOLD), "picks")

    def settle(spark, sf):
        return _text(settlement.settle(POLICIES[ticket](_scores(spark, sf), THRESHOLD), _payouts(spark, sf)), "picks")

    box = "" if ticket in ("tansho", "fukusho") else "_box"
    policy.__name__, settle.__name__ = f"policy_{ticket}{box}", f"settle_{ticket}"
    query(f"WITH {RUN}, {SCORED} SELECT race_id, ticket_type, array_to_string(picks, ',') AS picks FROM ({_picks_sql(ticket)})")(policy)
    query(f"WITH {PAY}, {SCORED} {_settled_sql(ticket)}")(settle)


for _ticket in POLICIES:
    _register(_ticket)

# Ticket types that settle alike, together
for _name, _alike in {
    "settle_single": ("tansho", "fukusho"), "settle_frame_box": ("wakuren",), "settle_pair_box": ("umaren", "wide"), "settle_exacta_box": ("umatan",),
    "settle_trio_box": ("sanrenpuku",), "settle_trifecta_box": ("sanrentan",),
}.items():

    def _family(spark, sf, alike=_alike):
        scores, paid = _scores(spark, sf), _payouts(spark, sf)
        bets = union_batches(*[POLICIES[t](scores, THRESHOLD) for t in alike])
        return settlement.settle(bets, paid).groupBy("ticket_type").agg(F.count("*").alias("races"), F.sum("n_bets").alias("n_bets"), F.sum("return_amount").alias("return_amount"))

    _family.__name__ = _name
    _settled = " UNION ALL ".join(_settled_sql(t) for t in _alike)
    query(f"WITH {PAY}, {SCORED} SELECT ticket_type, count(*) AS races, sum(n_bets)::BIGINT AS n_bets, sum(return_amount) AS return_amount FROM ({_settled}) GROUP BY ticket_type")(_family)

_PAIRS = f"SELECT a.race_id, a.umaban AS x, b.umaban AS y FROM score a JOIN score b ON a.race_id = b.race_id AND a.umaban <> b.umaban WHERE a.score >= 0.97 AND b.score >= {THRESHOLD}"


@query(f"WITH {RUN}, {SCORED} SELECT race_id, 'umatan' AS ticket_type, x || ',' || y AS picks FROM ({_PAIRS})")
def policy_axis_partner(spark, sf):
    return _text(policies.policy_axis_partner(_scores(spark, sf), 0.97, THRESHOLD), "picks")


@query(f"""WITH {PAY}, {SCORED} SELECT race_id, picks, coalesce(payout, 0)::DOUBLE AS return_amount FROM (SELECT race_id, x || ',' || y AS picks FROM ({_PAIRS})) p
  LEFT JOIN (SELECT race_id, array_to_string(win, ',') AS picks, payout FROM pay WHERE ticket_type = 'umatan') w USING (race_id, picks)""")
def settle_straight(spark, sf):
    return _text(settlement.settle_straight(policies.policy_axis_partner(_scores(spark, sf), 0.97, THRESHOLD), _payouts(spark, sf)), "picks").select("race_id", "picks", "return_amount")


@query(f"WITH {PAY}, {SCORED} SELECT b.race_id, count(payout) AS winners, coalesce(sum(payout), 0)::BIGINT AS payouts FROM ({_picks_sql('wide')}) b LEFT JOIN pay USING (race_id, ticket_type) GROUP BY b.race_id")
def settle_join(spark, sf):
    rows = settlement.settle_join(policies.policy_wide_box(_scores(spark, sf), THRESHOLD), _payouts(spark, sf))
    return rows.select("race_id", F.size("won").cast("long").alias("winners"), settlement.returned(F.col("won"), lambda w: F.lit(True)).alias("payouts"))


_TWO = f"(SELECT * FROM ({_settled_sql('umaren')}) UNION ALL SELECT * FROM ({_settled_sql('wide')}))"


def _two(spark, sf):
    scores, paid = _scores(spark, sf), _payouts(spark, sf)
    bets = policies.policy_umaren_box(scores, THRESHOLD).unionByName(policies.policy_wide_box(scores, THRESHOLD))
    return settlement.race_returns(settlement.settle(bets, paid))


@query(f"WITH {PAY}, {SCORED} SELECT race_id, sum(n_bets)::BIGINT AS n_bets, sum(bet_amount)::BIGINT AS bet_amount, sum(return_amount) AS return_amount, max(hit) AS hit_or_not FROM {_TWO} GROUP BY race_id")
def race_returns(spark, sf):
    return _two(spark, sf)


def _portfolio_sql(source: str, keys: str) -> str:
    lead, group = (keys + ", ", "GROUP BY " + keys) if keys else ("", "")
    return f"""SELECT {lead}sum(n_bets)::BIGINT AS n_bets, count(*) AS n_races, sum(hit)::BIGINT AS n_hits, sum(bet_amount)::BIGINT AS total_bet_amount,
  round(sum(return_amount) / sum(bet_amount), 6) AS return_rate, round(stddev_samp(return_amount) * sqrt(count(*)) / sum(bet_amount), 6) AS std FROM {source} {group}"""


_BY_RACE = f"(SELECT race_id, sum(n_bets) AS n_bets, sum(bet_amount) AS bet_amount, sum(return_amount) AS return_amount, max(hit) AS hit FROM {_TWO} GROUP BY race_id)"


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("return_rate", "std")})


@query(f"WITH {PAY}, {SCORED} {_portfolio_sql(_BY_RACE, '')}")
def portfolio_returns(spark, sf):
    return _rounded(settlement.portfolio_returns(_two(spark, sf)))


@query(f"WITH {PAY}, {SCORED}, p AS ({_portfolio_sql(_BY_RACE, '')}) SELECT round(return_rate - std, 4) AS lower, round(return_rate + std, 4) AS upper FROM p")
def return_band(spark, sf):
    return settlement.return_band(_rounded(settlement.portfolio_returns(_two(spark, sf)))).select(F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


def _sweep_sql() -> str:
    parts = []
    for t in POLICIES:
        number, flag = ("wakuban", " AND wakuban_flag = 1") if t == "wakuren" else ("umaban", "")
        picks = f"SELECT threshold, race_id, '{t}' AS ticket_type, list({number} ORDER BY {number}) AS picks FROM score JOIN grid ON score >= threshold{flag} GROUP BY threshold, race_id HAVING count(*) >= {policies.LEAST[t]}"
        parts.append(f"SELECT threshold, race_id, ticket_type, picks, ({COUNT[t]}) AS n_bets FROM ({picks})")
    return f"""WITH {PAY}, {SCORED}, {_GRID}, bet AS ({" UNION ALL ".join(parts)}),
  s AS (SELECT b.threshold, b.ticket_type, b.race_id, any_value(n_bets) AS n_bets, any_value(n_bets) * 100 AS bet_amount,
    coalesce(sum(payout) FILTER (WHERE list_has_all(b.picks, pay.win)), 0) AS return_amount, (return_amount > 0)::INTEGER AS hit
    FROM bet b LEFT JOIN pay ON pay.race_id = b.race_id AND pay.ticket_type = b.ticket_type GROUP BY b.threshold, b.ticket_type, b.race_id),
  p AS ({_portfolio_sql("s", "threshold, ticket_type")}) SELECT * REPLACE (round(threshold, 6) AS threshold) FROM p"""


@query(_sweep_sql())
def threshold_sweep(spark, sf):
    return _rounded(settlement.threshold_sweep(_scores(spark, sf), _payouts(spark, sf))).withColumn("threshold", F.round("threshold", 6))


GRID_2D = policies.threshold_grid_2d(0.8, 1.6, 10, 0.2, 10)
_POINTS = """grid2 AS (SELECT {'t1': t1, 't2': t1 * j / 10 + 0.2::DOUBLE * (1 - j / 10::DOUBLE)} AS t
  FROM (SELECT 1.6::DOUBLE * i / 10 + 0.8::DOUBLE * (1 - i / 10::DOUBLE) AS t1 FROM range(10) x(i)), range(10) y(j))"""


@query(f"""WITH {PAY}, {SCORED}, {_POINTS}, pair AS (SELECT t.t1 AS t1, t.t2 AS t2, a.race_id, [a.umaban, b.umaban] AS picks FROM grid2 JOIN score a ON a.score >= t.t1 JOIN score b ON b.race_id = a.race_id AND b.umaban <> a.umaban AND b.score >= t.t2),
  s AS (SELECT t1, t2, p.race_id, count(*) AS n_bets, count(*) * 100 AS bet_amount, coalesce(sum(payout) FILTER (WHERE pay.win = picks), 0) AS return_amount, (return_amount > 0)::INTEGER AS hit
    FROM pair p LEFT JOIN (SELECT race_id, win, payout FROM pay WHERE ticket_type = 'umatan') pay ON pay.race_id = p.race_id GROUP BY 1, 2, 3),
  q AS ({_portfolio_sql("s", "t1, t2")}) SELECT * REPLACE (round(t1, 6) AS t1, round(t2, 6) AS t2) FROM q""")
def axis_sweep(spark, sf):
    out = _rounded(settlement.axis_sweep(_scores(spark, sf), _payouts(spark, sf), GRID_2D))
    return out.withColumns({c: F.round(c, 6) for c in ("t1", "t2")})


_POSTS = "(SELECT event_id AS race_id, ts::DATE AS date, user_id % 5 AS place_id, ts AS post_time FROM events)"


def _posts(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("race_id"), F.to_date("ts").alias("date"), (F.col("user_id") % 5).alias("place_id"), F.col("ts").alias("post_time"))


@query(f"SELECT race_id, strftime(lag(post_time) OVER (PARTITION BY date, place_id ORDER BY race_id), '%Y-%m-%d %H:%M:%S') AS previous FROM {_POSTS}")
def previous_post_time(spark, sf):
    return raceday.previous_post_time(_posts(spark, sf)).select("race_id", F.date_format("previous_post_time", "yyyy-MM-dd HH:mm:ss").alias("previous"))


@query(f"""WITH p AS (SELECT *, post_time - INTERVAL 50 MINUTE AS a, lag(post_time) OVER (PARTITION BY date, place_id ORDER BY race_id) AS b FROM {_POSTS}), now AS (SELECT TIMESTAMP '2024-01-10 12:00:00' AS n)
  SELECT race_id FROM p, now WHERE (coalesce(b, a) < n AND n < post_time) OR (a > n - INTERVAL 50 MINUTE AND a <= n)""")
def active_races(spark, sf):
    return raceday.active_races(_posts(spark, sf), "2024-01-10 12:00:00").select("race_id")


@query(f"""WITH p AS (SELECT *, post_time - INTERVAL 50 MINUTE AS a, lag(post_time) OVER (PARTITION BY date, place_id ORDER BY race_id) AS b FROM {_POSTS}),
  e AS (SELECT *, 'announced' AS event, a AS t FROM p UNION ALL SELECT *, 'off', post_time FROM p UNION ALL SELECT *, 'next', b FROM p WHERE epoch_ms(b) < epoch_ms(a))
  SELECT race_id, date, place_id, event, strftime(t, '%Y-%m-%d %H:%M:%S') AS at FROM e""")
def race_events(spark, sf):
    """All events of all races, from a stream of the schedule and a clock that runs beyond the last post time."""
    races, clock, to, check = (scratch_path(spark, x) for x in ("races", "clock", "events", "stream"))
    posts = _posts(spark, sf).withColumn("seen", F.date_trunc("day", "post_time"))
    posts.write.parquet(races)
    end = posts.agg((F.max("post_time") + F.expr("interval 1 day")).alias("seen")).filter("seen is not null")
    end.write.parquet(clock)
    stream = spark.readStream
    events = fired_events(stream.schema(posts.schema).parquet(races), stream.schema(end.schema).parquet(clock))
    with state_store(spark):
        events.writeStream.format("parquet").option("path", to).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(to).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT event_id AS race_id, ts::DATE AS date FROM events")
def schedule_order(spark, sf):
    return raceday.schedule_order(_posts(spark, sf), "date", "post_time").select("race_id", "date")


_DAY = f"""{RUN}, {day_sql('l_partkey')}, card AS (SELECT run.*, o_orderdate::DATE AS date, umaban % 3 AS s, count(*) OVER (PARTITION BY race_id) AS n_horses FROM run JOIN orders ON o_orderkey = race_id WHERE flag <> 'N'),
  seen AS (SELECT horse_id AS id, row_number() OVER (ORDER BY min((o_orderdate::DATE, race_id, umaban))) - 1 AS code FROM run JOIN orders ON o_orderkey = race_id WHERE race_id % 2 = 0 GROUP BY 1),
  new AS (SELECT horse_id AS id, (SELECT count(*) FROM seen) + row_number() OVER (ORDER BY min((date, race_id, umaban))) - 1 AS code FROM card WHERE horse_id NOT IN (SELECT id FROM seen) GROUP BY 1),
  code AS (SELECT * FROM seen UNION ALL SELECT * FROM new),
  past AS (SELECT c.race_id, c.umaban, avg(h.quantity) AS m FROM card c JOIN hist h ON h.horse_id = c.horse_id AND h.date < c.date GROUP BY 1, 2),
  raw AS (SELECT c.race_id, c.umaban, c.wakuban, coalesce(m, 0) + 3 * (s = 0)::INTEGER + (quantity::INTEGER % 9) + (umaban % 5 - 2) * 0.5 + (code % 11) * 0.25 + (race_id % 4 = 0)::INTEGER AS x
    FROM card c LEFT JOIN past USING (race_id, umaban) JOIN code ON id = c.horse_id),
  z AS (SELECT *, round((x - avg(x) OVER (PARTITION BY race_id)) / nullif(CASE WHEN max(x) OVER (PARTITION BY race_id) > min(x) OVER (PARTITION BY race_id) THEN stddev_pop(x) OVER (PARTITION BY race_id) END, 0), 6) AS score FROM raw)"""
_DAY_SQL = f"WITH {_DAY} SELECT race_id, umaban, score FROM z"


def _cards(spark, sf):
    """All order lines as race cards; lines with flag N are scratched."""
    days, u, q = races(spark, sf).select("race_id", F.date_format("date", "yyyy年M月d日").alias("date")), F.col("umaban"), F.col("quantity").cast("int")
    weather, around = (F.get(F.array(*map(F.lit, v)), (F.col("race_id") % len(v)).cast("int")) for v in (WEATHER, DIRECTIONS))
    return runners(spark, sf).join(days, "race_id").select(
        "race_id", F.col("wakuban").cast("string").alias("wakuban"), u.cast("string").alias("umaban"),
        F.concat(F.when(u % 3 == 0, "牡").when(u % 3 == 1, "牝").otherwise("セ"), (q % 9).cast("string")).alias("sex_age"), (F.lit(50.0) + u).alias("carried"),
        F.when(u % 4 == 0, "---").otherwise(F.format_string("%.1f", u + 1.5)).alias("odds"), u.cast("string").alias("popularity"),
        F.when(F.col("flag") == "N", "--").otherwise(F.concat((q + 440).cast("string"), F.lit("("), F.format_string("%+d", u % 5 - 2), F.lit(")"))).alias("weight_text"), "horse_id",
        (F.lit(1000) + F.col("race_id") % 26 * 100).cast("int").alias("course_len"), F.when(F.col("race_id") % 4 == 0, "良").otherwise("重").alias("ground_state"), "date",
        weather.alias("weather"), around.alias("around"), F.lit("芝").alias("race_type"), F.lit("未勝利").alias("race_class"),
    )


def _scorer(spark, sf):
    """Cards to scored cards: history, all features with the codes of a former run, score, rank."""
    former = runners(spark, sf).join(races(spark, sf).select("race_id", "date"), "race_id").filter("race_id % 2 = 0")
    masters = features.label_encode_masters(former.select("horse_id", "date", "race_id", "umaban"), ["horse_id"], ["date", "race_id", "umaban"])[1]
    x = F.coalesce("quantity_allR", F.lit(0.0)) + 3 * F.col("sex__牡") + F.col("age") + F.col("weight_change") * 0.5 + F.col("horse_id_code") % 11 * 0.25 + F.col("ground_state1__良")
    more = lambda df: features.featurize(df, masters)[0]
    return lambda cards: raceday.day_of_scoring(cards, day_rows(spark, sf, "l_partkey"), lambda df: df.withColumn("score", x), ["quantity"], features=more)


def _rounded_day(df):
    """A race whose scores are all equal has no deviation."""
    return df.select("race_id", "umaban", F.round("score", 6).alias("score"))


@query(_DAY_SQL)
def day_of_scoring(spark, sf):
    return _rounded_day(_scorer(spark, sf)(_cards(spark, sf)))


@query(_DAY_SQL)
def score_stream(spark, sf):
    """The same as a stream: cards arrive as files, races whole."""
    arriving, to, checkpoint = (scratch_path(spark, x) for x in ("cards", "scored", "stream"))
    _cards(spark, sf).repartition(2, "race_id").write.parquet(arriving)
    stream = spark.readStream.schema(spark.read.parquet(arriving).schema).parquet(arriving)
    raceday.score_stream(stream, _scorer(spark, sf), to, checkpoint).awaitTermination()
    return _rounded_day(spark.read.parquet(to))
