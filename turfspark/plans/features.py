"""Queries over history features, encoders, splits and scores."""

from pyspark.sql import functions as F

from ..functions.ordering import stored
from ..operators import features, history, history_state as history_states, ml, scoring, splitting
from ..sources.scratch import scratch_path
from ..streaming import history_stream as history_streams
from .mapping import RUN, day_rows, day_sql, query, races, runners, spread, table

# One target row per entity and day; history is the same table, strictly earlier days.
_KEY = "SELECT DISTINCT horse_id, date, flag FROM hist"


def _days(spark, sf, entity):
    """Stored, as they are counted and read as runners and as history."""
    return stored(day_rows(spark, sf, entity), "days")


def _keys(rows):
    return spread(rows.select("horse_id", "date", "flag"), "horse_id", "date").distinct()


def _history_sql(entity: str, group: bool, lastn: bool, key: str = _KEY) -> str:
    columns = []
    for t in ("quantity", "discount"):
        for n in (5, 9) if lastn else ():
            columns.append(f'round(avg(h.{t}) FILTER (WHERE rn <= {n}), 9) AS "{t}_{n}R"')
            if group:
                columns.append(f'round(avg(h.{t}) FILTER (WHERE rn <= {n} AND h.flag = k.flag), 9) AS "{t}_flag_{n}R"')
        columns.append(f'round(avg(h.{t}), 9) AS "{t}_allR"')
        if group:
            columns.append(f'round(avg(h.{t}) FILTER (WHERE h.flag = k.flag), 9) AS "{t}_flag_allR"')
    return f"""WITH {day_sql(entity)}, key AS ({key}),
  joined AS (SELECT k.horse_id AS e, k.date AS d, k.flag AS f, h.*, row_number() OVER (PARTITION BY k.horse_id, k.date, k.flag ORDER BY h.date DESC, h.R DESC) AS rn
    FROM key k JOIN hist h ON h.horse_id = k.horse_id AND h.date < k.date)
  SELECT k.horse_id, k.date, k.flag, {", ".join(columns)}, max(h.date) AS latest
  FROM key k LEFT JOIN joined h ON h.e = k.horse_id AND h.d = k.date AND h.f = k.flag GROUP BY k.horse_id, k.date, k.flag"""


def _rounded(df):
    return df.select(*[F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@query(_history_sql("l_partkey", False, True))
def history_lastn_part(spark, sf):
    rows = _days(spark, sf, "l_partkey")
    return _rounded(history.history_features(_keys(rows), rows, ["quantity", "discount"]))


@query(_history_sql("l_partkey", True, True))
def history_features(spark, sf):
    rows = _days(spark, sf, "l_partkey")
    return _rounded(history.history_features(_keys(rows), rows, ["quantity", "discount"], ["flag"]))


@query(_history_sql("l_suppkey", True, True))
def history_group_supplier(spark, sf):
    rows = _days(spark, sf, "l_suppkey")
    return _rounded(history.history_features(_keys(rows), rows, ["quantity", "discount"], ["flag"], path="linear"))


_CUTS = ("1997-01-01", "1999-07-01", "2002-01-01")


@query(_history_sql("l_partkey", True, True, f"SELECT DISTINCT horse_id, c::DATE AS date, flag FROM hist, unnest({list(_CUTS)}) AS u(c)"))
def history_state(spark, sf):
    """Features of every entity on three days, each out of the stored state after the days before were added to it."""
    rows, path = _days(spark, sf, "l_partkey"), scratch_path(spark, "state")
    targets, asked = ["quantity", "discount"], rows.select("horse_id", "flag").distinct()
    none = history_states.state_of(rows.limit(0), targets, ["flag"])
    history_states.save(none, path)
    out, begin = None, "0001-01-01"
    for cut in _CUTS:
        history_states.advance(spark, path, rows.filter((F.col("date") >= begin) & (F.col("date") < cut)), targets, ["flag"])
        state = stored(history_states.load(spark, path, none.schema), "state")  # as it is after these days
        found = history_states.features(asked.select("horse_id", F.lit(cut).cast("date").alias("date"), "flag"), state, targets, ["flag"])
        out, begin = found if out is None else out.unionByName(found), cut
    return _rounded(out)


@query(_history_sql("l_partkey", True, True))
def history_stream(spark, sf):
    """Two streams, of runners and of results, which arrive period by period; the state of each entity is all that is
    kept of the past."""
    cards, results, out, checkpoint = (scratch_path(spark, x) for x in ("cards", "results", "features", "stream"))
    rows, begin = day_rows(spark, sf, "l_partkey"), "0001-01-01"
    for cut in _CUTS:
        some = stored(rows.filter((F.col("date") >= begin) & (F.col("date") < cut)), "period")
        _keys(some).write.mode("append").parquet(cards)
        some.write.mode("append").parquet(results)
        arriving = [spark.readStream.schema(schema).parquet(path) for schema, path in ((_keys(some).schema, cards), (some.schema, results))]
        found = history_streams.history_feature_stream(*arriving, ["quantity", "discount"], ["flag"])
        with history_streams.state_store(spark):
            found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        begin = cut
    return _rounded(spark.read.schema(found.schema).parquet(out).drop("late"))


@query(_history_sql("l_suppkey", False, True).replace("sum(l_quantity)", "sum(l_quantity)::DECIMAL(12, 2)::DOUBLE"))
def history_decimal(spark, sf):
    """A decimal target: means are doubles."""
    rows = _days(spark, sf, "l_suppkey").withColumn("quantity", F.col("quantity").cast("decimal(12,2)"))
    return _rounded(history.history_features(_keys(rows), rows, ["quantity", "discount"], path="linear"))


_ASOF = f"""WITH {day_sql('l_partkey')}, key AS ({_KEY}), joined AS (SELECT k.horse_id AS e, k.date AS d, k.flag AS f, h.*,
  row_number() OVER (PARTITION BY k.horse_id, k.date, k.flag ORDER BY h.date DESC, h.R DESC) AS rn FROM key k JOIN hist h ON h.horse_id = k.horse_id AND h.date < k.date)
  SELECT k.horse_id, k.date, k.flag, {{}} FROM key k LEFT JOIN joined h ON h.e = k.horse_id AND h.d = k.date AND h.f = k.flag GROUP BY k.horse_id, k.date, k.flag"""


def _one(spark, sf, *columns, groups=(), windows=(5, 9)):
    rows = _days(spark, sf, "l_partkey")
    found = history.history_features(_keys(rows), rows, ["quantity"], list(groups), windows)
    return _rounded(found.select("horse_id", "date", "flag", *columns))


@query(_ASOF.format('round(avg(h.quantity) FILTER (WHERE rn <= 5), 9) AS "quantity_5R", round(avg(h.quantity) FILTER (WHERE rn <= 9), 9) AS "quantity_9R"'))
def mean_lastn(spark, sf):
    return _one(spark, sf, "quantity_5R", "quantity_9R")


@query(_ASOF.format('round(avg(h.quantity) FILTER (WHERE rn <= 5 AND h.flag = k.flag), 9) AS "quantity_flag_5R", round(avg(h.quantity) FILTER (WHERE rn <= 9 AND h.flag = k.flag), 9) AS "quantity_flag_9R"'))
def mean_lastn_by_group(spark, sf):
    return _one(spark, sf, "quantity_flag_5R", "quantity_flag_9R", groups=["flag"])


@query(_ASOF.format('round(avg(h.quantity), 9) AS "quantity_allR"'))
def mean_all(spark, sf):
    return _one(spark, sf, "quantity_allR", windows=())


@query(_ASOF.format('round(avg(h.quantity) FILTER (WHERE h.flag = k.flag), 9) AS "quantity_flag_allR"'))
def mean_all_by_group(spark, sf):
    return _one(spark, sf, "quantity_flag_allR", groups=["flag"], windows=())


@query(_ASOF.format("max(h.date) AS latest"))
def latest_date(spark, sf):
    return _one(spark, sf, "latest", windows=())


_EVENT = """hist AS (SELECT user_id AS horse_id, ts::DATE AS date, event_type AS flag, event_id AS R, round(value * 100) AS value FROM events), key AS (SELECT DISTINCT horse_id, date, flag FROM hist)"""


@query(f"""WITH {_EVENT} SELECT k.horse_id, k.date, k.flag, round(avg(h.value), 9) AS "value_allR", round(avg(h.value) FILTER (WHERE h.flag = k.flag), 9) AS "value_flag_allR", max(h.date) AS latest
  FROM key k LEFT JOIN hist h ON h.horse_id = k.horse_id AND h.date < k.date GROUP BY 1, 2, 3""")
def history_events(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("horse_id"), F.to_date("ts").alias("date"), F.col("event_type").alias("flag"), F.col("event_id").alias("R"), F.round(F.col("value") * 100).alias("value"))
    return _rounded(history.history_features(_keys(rows), rows, ["value"], ["flag"], windows=(), path="linear"))


@query("""WITH key AS (SELECT DISTINCT user_id, ts, event_type FROM events),
  joined AS (SELECT k.user_id AS e, k.ts AS t, k.event_type AS f, h.*, row_number() OVER (PARTITION BY k.user_id, k.ts, k.event_type ORDER BY h.ts::DATE DESC, h.event_id DESC) AS rn
    FROM key k JOIN events h ON h.user_id = k.user_id AND h.ts::DATE < k.ts::DATE)
  SELECT k.user_id AS horse_id, epoch_us(k.ts) AS at, k.event_type AS flag, round(avg(round(h.value * 100)) FILTER (WHERE rn <= 5), 9) AS "value_5R", round(avg(round(h.value * 100)), 9) AS "value_allR", max(h.ts::DATE) AS latest
  FROM key k LEFT JOIN joined h ON h.e = k.user_id AND h.t = k.ts AND h.f = k.event_type GROUP BY 1, 2, 3""")
def history_of_instants(spark, sf):
    """Times, not days, in both tables: rows of the same day don't count."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("horse_id"), F.col("ts").alias("date"), F.col("event_type").alias("flag"), F.col("event_id").alias("R"), F.round(F.col("value") * 100).alias("value"))
    found = _rounded(history.history_features(_keys(rows), rows, ["value"], windows=(5,)))
    return found.withColumn("at", F.unix_micros(F.col("date").cast("timestamp"))).drop("date")


@query("""SELECT l.l_partkey AS horse_id, l.l_orderkey AS race_id, count(*) AS n FROM (SELECT DISTINCT l_partkey, l_orderkey, l_shipdate::DATE AS d FROM lineitem) l
  JOIN (SELECT DISTINCT l_partkey, l_shipdate::DATE AS d FROM lineitem) h ON h.l_partkey = l.l_partkey AND h.d < l.d GROUP BY 1, 2""")
def asof_history(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("horse_id"), F.col("l_orderkey").alias("race_id"), F.to_date("l_shipdate").alias("date"))
    joined = history.asof_history(lines.distinct(), lines.select("horse_id", "date").distinct(), [])
    return joined.groupBy("horse_id", "race_id").agg(F.count("*").alias("n"))


@query(f"""WITH {day_sql('l_linestatus')} SELECT r.horse_id, r.date, r.flag, count(*) AS n, sum(h.discount) AS discounts, max(h.date) AS latest
  FROM hist r JOIN hist h ON h.horse_id = r.horse_id AND h.date < r.date GROUP BY r.horse_id, r.date, r.flag""")
def asof_history_hot(spark, sf):
    """Two entities with all rows between them, so each is joined by periods."""
    rows = day_rows(spark, sf, "l_linestatus")
    joined = history.asof_history(rows.select("horse_id", "date", "flag"), rows, ["discount"])
    return joined.groupBy("horse_id", "date", "flag").agg(F.count("*").alias("n"), F.sum("h_discount").alias("discounts"), F.max("h_date").alias("latest"))


@query("""SELECT l_partkey AS horse_id, l_orderkey AS race_id, l_linenumber, rn FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate::DATE DESC, l_orderkey DESC, l_linenumber DESC)::INTEGER AS rn
  FROM (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber, l_shipdate::DATE AS l_shipdate FROM lineitem))""")
def recent_rank(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("horse_id"), F.col("l_orderkey").alias("race_id"), "l_linenumber", F.to_date("l_shipdate").alias("date")).distinct()
    return lines.select("horse_id", "race_id", "l_linenumber", history.recent_rank(["horse_id"], F.col("date"), [F.col("race_id"), F.col("l_linenumber")]).alias("rn"))


@query("""SELECT l_partkey AS horse_id, l_orderkey AS race_id, l_linenumber FROM (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber, l_shipdate::DATE AS d FROM lineitem)
  QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY d DESC, l_orderkey DESC, l_linenumber DESC) <= 5""")
def lastn_history(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("horse_id"), F.col("l_orderkey").alias("race_id"), "l_linenumber", F.to_date("l_shipdate").alias("date")).distinct()
    return history.lastn_history(lines, 5, order=("race_id", "l_linenumber")).select("horse_id", "race_id", "l_linenumber")


_LATEST = "SELECT l_partkey, l_orderkey, l_linenumber, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::INTEGER"


@query(f"{_LATEST} AS interval FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def add_interval(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select("l_partkey", "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("date"), F.to_date("o_orderdate").alias("latest"))
    return features.add_interval(rows).drop("date")


@query("SELECT o_orderkey, date_diff('day', DATE '1990-04-05' + (o_custkey % 1000)::INTEGER, o_orderdate::DATE)::INTEGER AS age_days FROM orders")
def add_agedays(spark, sf):
    birthday = F.date_add(F.lit("1990-04-05").cast("date"), (F.col("o_custkey") % 1000).cast("int"))
    return features.add_agedays(table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), birthday.alias("birthday"))).drop("date")


_PRIORITIES = ["1-URGENT", "2-HIGH", "none such"]


@query("SELECT o_orderkey, " + ", ".join(f"(o_orderpriority = '{v}')::INTEGER AS \"o_orderpriority__{v}\"" for v in _PRIORITIES) + ", (o_orderstatus = 'F')::INTEGER AS \"o_orderstatus__F\" FROM orders")
def one_hot_fixed(spark, sf):
    specs = {"o_orderpriority": (_PRIORITIES, ["o_orderpriority"]), "o_orderstatus": (["F"], ["o_orderstatus"]), "missing": (["x"], ["missing"])}
    return features.one_hot_fixed(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), specs)


_CODES = """known AS (SELECT DISTINCT user_id::VARCHAR AS id, user_id * 2 AS encoded_id FROM events WHERE user_id % 4 = 0),
 new AS (SELECT user_id::VARCHAR AS id, min(event_id) AS f FROM events WHERE user_id % 4 <> 0 GROUP BY 1),
 master AS (SELECT id, encoded_id FROM known UNION ALL SELECT id, (SELECT coalesce(max(encoded_id) + 1, 0) FROM known) + row_number() OVER (ORDER BY f) - 1 FROM new)"""


@query(f"WITH {_CODES} SELECT event_id, encoded_id::BIGINT AS user_id_code FROM events JOIN master ON id = user_id::VARCHAR")
def label_encode_master(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id")
    known = events.filter("user_id % 4 = 0").select(F.col("user_id").cast("string").alias("id"), (F.col("user_id") * 2).alias("encoded_id")).distinct()
    return features.label_encode_master(events, "user_id", ["event_id"], known)[0].select("event_id", "user_id_code")


@query("""SELECT c_custkey AS horse_id, (SELECT count(DISTINCT v) FROM (SELECT coalesce(CASE WHEN c_nationkey > 2 THEN c_mktsegment END, 'Na') AS v FROM customer) x WHERE x.v < coalesce(CASE WHEN c.c_nationkey > 2 THEN c.c_mktsegment END, 'Na'))::INTEGER AS peds_0,
  (SELECT count(DISTINCT n_name) FROM nation x, customer y WHERE y.c_nationkey = x.n_nationkey AND x.n_name < n.n_name)::INTEGER AS peds_1 FROM customer c JOIN nation n ON n_nationkey = c_nationkey""")
def clean_peds(spark, sf):
    peds = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    peds = peds.select(F.col("c_custkey").alias("horse_id"), F.when(F.col("c_nationkey") > 2, F.col("c_mktsegment")).alias("peds_0"), F.col("n_name").alias("peds_1"))
    return features.clean_peds(peds, ["peds_0", "peds_1"])


@query("SELECT page_id AS horse_id, l[1] AS peds_0, l[2] AS peds_1, l[3] AS peds_2 FROM (SELECT page_id, regexp_extract_all(html, 'href=\"/([^\"/]+)\"', 1) AS l FROM pages)")
def pivot_peds(spark, sf):
    return features.pivot_peds(table(spark, sf, "pages").withColumnRenamed("page_id", "horse_id"), width=3, pattern=r'href="/([^"/]+)"')


# Every category cycles through its values and one that is unknown; the ids come from several tables.
_CATEGORIES = {c: values for c, (values, _) in features.ONE_HOT.items()}
_ID_SQL = {
    "horse_id": "horse_id", "jockey_id": "jockey_id", "trainer_id": "nullif(horse_id % 97, 0)", "owner_id": "'o' || (jockey_id * 7 % 53)", "breeder_id": "'b' || (race_id % 31)",
}


def _category(k: int, values: list[str]) -> str:
    return f"(race_id // 3 + umaban * {k + 1}) % {len(values) + 1}"


def feature_rows(spark, sf):
    rows = runners(spark, sf).join(races(spark, sf).select("race_id", "date"), "race_id")
    named = {c: F.get(F.array(*map(F.lit, v)), F.expr(_category(k, v).replace("//", "div")).cast("int")) for k, (c, v) in enumerate(_CATEGORIES.items())}
    ids = {c: F.expr(x) for c, x in _ID_SQL.items()}
    days = {"latest": F.expr("date_sub(date, cast(umaban * 7 + race_id % 50 AS int))"), "birthday": F.expr("date_sub(date, cast(700 + horse_id % 900 AS int))")}
    gone = {c: F.lit("x") for _, drops in features.ONE_HOT.values() for c in drops if c not in named}
    return rows.withColumns(ids).select("race_id", "umaban", "date", *_ID_SQL, *[c.alias(n) for n, c in (named | days | gone).items()])


def stored_masters(rows):
    """Codes of a former run: those of the jockeys with an even number."""
    return {"jockey_id": rows.filter("jockey_id % 2 = 0").select(F.col("jockey_id").cast("string").alias("id"), (F.col("jockey_id") + 3).alias("encoded_id")).distinct()}


def _feature_sql() -> str:
    hot = ", ".join(f'coalesce(({_category(k, v)} = {i})::INTEGER, 0) AS "{c}__{x}"' for k, (c, v) in enumerate(_CATEGORIES.items()) for i, x in enumerate(v))
    ctes, joins, codes = [], [], []
    for c, expression in _ID_SQL.items():
        known = "SELECT DISTINCT jockey_id::VARCHAR AS id, jockey_id + 3 AS code FROM j WHERE jockey_id % 2 = 0" if c == "jockey_id" else "SELECT NULL::VARCHAR AS id, NULL::BIGINT AS code WHERE false"
        ctes.append(f"""known_{c} AS ({known}), code_{c} AS (SELECT * FROM known_{c} UNION ALL SELECT id, (SELECT coalesce(max(code) + 1, 0) FROM known_{c}) + row_number() OVER (ORDER BY f) - 1
          FROM (SELECT {c}::VARCHAR AS id, min((date, race_id, umaban)) AS f FROM (SELECT date, race_id, umaban, {expression} AS {c} FROM j) WHERE {c} IS NOT NULL GROUP BY 1) WHERE id NOT IN (SELECT id FROM known_{c}))""")
        joins.append(f"LEFT JOIN code_{c} ON code_{c}.id = ({expression})::VARCHAR")
        codes.append(f"code_{c}.code::BIGINT AS {c}_code")
    return f"""WITH {RUN}, j AS (SELECT run.*, o_orderdate::DATE AS date FROM run JOIN orders ON o_orderkey = race_id), {", ".join(ctes)}
  SELECT race_id, umaban, {", ".join(f"{x} AS {c}" for c, x in _ID_SQL.items())}, (umaban * 7 + race_id % 50)::INTEGER AS interval, (700 + horse_id % 900)::INTEGER AS age_days, {hot}, {", ".join(codes)}
  FROM j {" ".join(joins)}"""


@query(_feature_sql())
def featurize(spark, sf):
    """All eight categories, five id columns, one of them with codes of a former run, interval and age."""
    rows = feature_rows(spark, sf)
    return features.featurize(rows, stored_masters(rows))[0].drop("date", "place_id")


@query("""WITH n AS (SELECT o_orderkey AS race_id, row_number() OVER (ORDER BY o_orderdate::DATE, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
  SELECT race_id, CASE WHEN i >= round_even(n * 0.7, 0) THEN 'test' WHEN i >= round_even(round_even(n * 0.7, 0) * 0.7, 0) THEN 'valid' ELSE 'train' END AS fold FROM n""")
def split_by_time(spark, sf):
    return splitting.split_by_time(races(spark, sf)).select("race_id", "fold")


@query("""WITH n AS (SELECT o_orderkey AS race_id, row_number() OVER (ORDER BY o_orderdate::DATE, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
  SELECT race_id, CASE WHEN i < n - floor(n * 0.2) - floor(n * 0.1) THEN 'train' WHEN i < n - floor(n * 0.1) THEN 'valid' ELSE 'test' END AS fold FROM n""")
def split_three_way(spark, sf):
    return splitting.split_three_way(races(spark, sf), 0.2, 0.1).select("race_id", "fold")


def _scores(spark, sf):
    return runners(spark, sf).withColumn("score", F.col("quantity"))


def _policy_sql(expression: str) -> str:
    return f"""WITH {RUN}, f AS (SELECT race_id, (count(DISTINCT umaban) > count(DISTINCT wakuban))::INTEGER AS wakuban_flag FROM run GROUP BY race_id),
  s AS (SELECT *, (quantity - avg(quantity) OVER w) / nullif(stddev_pop(quantity) OVER w, 0) AS z, quantity / sum(quantity) OVER w AS share FROM run WINDOW w AS (PARTITION BY race_id))
  SELECT s.race_id, umaban, wakuban, round({expression}, 9) AS score, wakuban_flag FROM s JOIN f ON s.race_id = f.race_id"""


@query(_policy_sql("quantity"))
def score_basic(spark, sf):
    return _rounded(scoring.score_basic(_scores(spark, sf)))


@query(_policy_sql("z"))
def score_std(spark, sf):
    return _rounded(scoring.score_std(_scores(spark, sf)))


@query(_policy_sql("share"))
def score_relative(spark, sf):
    return _rounded(scoring.score_relative(_scores(spark, sf)))


@query(_policy_sql("(z - (SELECT min(z) FROM s)) / (SELECT max(z) - min(z) FROM s)"))
def score_minmax(spark, sf):
    return _rounded(scoring.score_minmax(_scores(spark, sf)))


@query(f"WITH {RUN} SELECT race_id, (count(DISTINCT umaban) > count(DISTINCT wakuban))::INTEGER AS wakuban_flag FROM run GROUP BY race_id")
def frame_share_flag(spark, sf):
    return scoring.frame_share_flag(runners(spark, sf)).select("race_id", "wakuban_flag").distinct()


@query(f"WITH {RUN} SELECT race_id, umaban, row_number() OVER (PARTITION BY race_id ORDER BY quantity DESC, umaban)::INTEGER AS score_rank FROM run")
def race_rank_by_score(spark, sf):
    return scoring.race_rank_by_score(_scores(spark, sf)).select("race_id", "umaban", "score_rank")


@query(f"WITH {RUN} SELECT race_id, umaban FROM run QUALIFY row_number() OVER (PARTITION BY race_id ORDER BY quantity DESC, umaban) <= 3")
def top_runners(spark, sf):
    return scoring.top_runners(_scores(spark, sf)).select("race_id", "umaban")


_AUC = """c AS (SELECT l_quantity AS s, sum((l_returnflag = 'R')::INTEGER) AS pos, sum((l_returnflag <> 'R')::INTEGER) AS neg FROM lineitem GROUP BY 1),
  r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)"""


@query(f"WITH {_AUC} SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)::DOUBLE), 6) AS auc FROM r")
def auc(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return scoring.auc(rows).select(F.round("auc", 6).alias("auc"))


# ---- models: SQL repeats the fits ----------------------------------------------------------------
_FOLD = f"""{RUN}, number AS (SELECT o_orderkey AS race_id, row_number() OVER (ORDER BY o_orderdate::DATE, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders WHERE o_orderkey IN (SELECT race_id FROM run)),
  fold AS (SELECT run.*, CASE WHEN i >= round_even(n * 0.7, 0) THEN 'test' WHEN i >= round_even(round_even(n * 0.7, 0) * 0.7, 0) THEN 'valid' ELSE 'train' END AS fold,
    (quantity > 25 AND discount < 0.08)::INTEGER AS rank FROM run JOIN number USING (race_id))"""


# A feature of five values, some missing: trees of depth 4 part them all, so SQL can follow the boosting value by value.
_BANDS = f"""{_FOLD}, raw AS (SELECT *, CASE WHEN umaban < 7 THEN ceil(quantity / 10) END AS known FROM fold),
  median AS (SELECT quantile_disc(known, 0.5) AS m FROM raw WHERE fold = 'train'), learning AS (SELECT raw.*, coalesce(known, m) AS band FROM raw, median)"""
_BOOSTED = f"""{_BANDS}, cell AS (SELECT band, avg(rank) AS p FROM learning WHERE fold = 'train' GROUP BY band),
  boost(band, p, k, s) AS (SELECT band, p, 1, 2 * p - 1 FROM cell UNION ALL SELECT band, p, k + 1, s + 0.1 * 4 * (p / (1 + exp(2 * s)) - (1 - p) / (1 + exp(-2 * s))) FROM boost WHERE k < 20),
  scored AS (SELECT race_id, umaban, fold, rank, round(1 / (1 + exp(-2 * s)), 6) AS score FROM learning JOIN boost USING (band) WHERE k = 20)"""
_AREAS = """count_of AS (SELECT fold, score, sum(rank) AS pos, sum(1 - rank) AS neg FROM scored GROUP BY ALL),
  lower_of AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY fold ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM count_of),
  area AS (SELECT fold, sum(pos + neg)::BIGINT AS runners, sum(pos)::BIGINT AS positive, round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)::DOUBLE), 6) AS auc FROM lower_of GROUP BY fold)"""


def _learning(spark, sf):
    rows = runners(spark, sf).join(races(spark, sf), "race_id").withColumn("rank", ((F.col("quantity") > 25) & (F.col("discount") < 0.08)).cast("int"))
    rows = rows.withColumns({"band": F.when(F.col("umaban") < 7, F.ceil(F.col("quantity") / 10)), "cents": F.round(F.col("discount") * 100).cast("int")})
    return splitting.split_by_time(rows).select("race_id", "umaban", "wakuban", "band", "cents", "rank", "fold")


def _trained(spark, sf):
    rows = stored(_learning(spark, sf), "learning")
    return rows, ml.train_classifier(rows.filter("fold = 'train'"), ["band"])


@query(f"WITH {RUN} SELECT umaban, horse_id, jockey_id, quantity, discount, price, wakuban, (quantity > 25)::INTEGER AS rank FROM run")
def xy_columns(spark, sf):
    rows = runners(spark, sf).withColumn("rank", (F.col("quantity") > 25).cast("int"))
    x, y = splitting.xy_columns(rows)
    return rows.select(*x, y)


@query(f"WITH RECURSIVE {_BOOSTED}, {_AREAS} SELECT * FROM area")
def train_classifier(spark, sf):
    """Runners, winners and area under the curve of each fold, of the library's default model."""
    rows, model = _trained(spark, sf)
    scored = ml.score_runners(model, rows, ["band"]).withColumn("score", F.round("score", 6))
    counts = rows.groupBy("fold").agg(F.count("*").alias("runners"), F.sum("rank").alias("positive"))
    return counts.join(scoring.auc(scored, "score", "rank", by="fold"), "fold").select("fold", "runners", "positive", F.round("auc", 6).alias("auc"))


@query(f"WITH RECURSIVE {_BOOSTED} SELECT race_id, umaban, rank, score FROM scored WHERE fold = 'test'")
def score_runners(spark, sf):
    rows, model = _trained(spark, sf)
    return ml.score_runners(model, rows.filter("fold = 'test'"), ["band"]).select("race_id", "umaban", "rank", F.round("score", 6).alias("score"))


_X = ["band", "cents", "umaban", "wakuban"]


def _splits(name: str, source: str) -> str:
    """The best split of every node of ``source`` (i, node, feature, x, y): what it takes off the sum of squares."""
    square = lambda n, p: f"({p} - {p} * {p} / {n}::DOUBLE)"
    return f"""{name}_v AS (SELECT node, feature, x, count(*) AS n, sum(y) AS p FROM {source} GROUP BY ALL),
  {name}_c AS (SELECT node, feature, x, sum(n) OVER w AS nl, sum(p) OVER w AS pl, sum(n) OVER a AS nt, sum(p) OVER a AS pt FROM {name}_v WINDOW w AS (PARTITION BY node, feature ORDER BY x), a AS (PARTITION BY node, feature)),
  {name} AS (SELECT node, feature, x, {square('nt', 'pt')} - {square('nl', 'pl')} - {square('(nt - nl)', '(pt - pl)')} AS gain FROM {name}_c WHERE nt > nl AND pt > 0 AND pt < nt
    QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature) = 1)"""


# A tree of depth 2: the split of all rows, and the splits of its two sides.
_IMPORTANCE = f"""{_BANDS}, numbered AS (SELECT *, row_number() OVER () AS i FROM learning WHERE fold = 'train'),
  long AS (SELECT i, 0 AS node, rank AS y, unnest({_X}) AS feature, unnest([band, round(discount * 100), umaban, wakuban]::DOUBLE[]) AS x FROM numbered),
  {_splits('top', 'long')}, side AS (SELECT long.i, 1 + (long.x > top.x)::INTEGER AS node FROM long JOIN top ON long.feature = top.feature),
  half AS (SELECT long.i, side.node, y, feature, x FROM long JOIN side ON long.i = side.i), {_splits('next', 'half')},
  gains AS (SELECT feature, gain FROM top UNION ALL SELECT feature, gain FROM next UNION ALL SELECT unnest({_X}), 0),
  importance AS (SELECT feature, round(sum(gain) / (SELECT sum(gain) FROM gains), 6) AS importance FROM gains GROUP BY feature)"""


def _tree(spark, sf):
    rows = stored(_learning(spark, sf), "learning")
    return ml.train_classifier(rows.filter("fold = 'train'"), _X, trees=1, depth=2)


@query(f"WITH {_IMPORTANCE} SELECT feature, importance FROM importance")
def feature_importance(spark, sf):
    return ml.feature_importance(_tree(spark, sf), _X, spark).select("feature", F.round("importance", 6).alias("importance"))


@query(f"WITH {_IMPORTANCE} SELECT feature FROM importance ORDER BY importance DESC, feature LIMIT 2")
def top_features(spark, sf):
    return ml.top_features(_tree(spark, sf), _X, spark, 2).select("feature")


@query(f"""WITH RECURSIVE {_BOOSTED}, {_AREAS}, fit AS (SELECT unnest([0, 1, 2, 3, 4])::INTEGER AS fit, unnest(['start', 'size', 'size', 'leaves', 'leaves']) AS step, unnest(['4', '5', '5', '4', '4']) AS depth,
    unnest(['1', '1', '1', '10', '10']) AS least, unnest([20, 10, 20, 10, 20])::INTEGER AS trees)
  SELECT fit, step, depth, least, trees, auc, fit = 0 AS taken FROM fit, area WHERE fold = 'valid'""")
def tune(spark, sf):
    """All these settings part the five values, so their scores have the same order; the start stays."""
    rows = stored(_learning(spark, sf), "learning")
    steps = (("size", ({"maxDepth": 4}, {"maxDepth": 5})), ("leaves", ({"minInstancesPerNode": 1}, {"minInstancesPerNode": 10})))
    found = ml.tune(rows.filter("fold = 'train'"), rows.filter("fold = 'valid'"), ["band"], steps=steps, trees=20)[1]
    return found.select("fit", "step", F.col("setting")["maxDepth"].alias("depth"), F.col("setting")["minInstancesPerNode"].alias("least"), "trees", F.round("auc", 6).alias("auc"), "taken")
