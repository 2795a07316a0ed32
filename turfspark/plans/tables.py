"""Queries over sources, sinks, keyed updates, joins and profiles."""

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions.ordering import stored
from ..operators import cleaning, joins, profile
from ..sources import known_keys, pages, tables
from ..sources.scratch import scratch_path
from .mapping import PAY, RACE, RUN, payout_kinds, payout_texts, query, races, runners, table
from ..operators.payouts import parse_payouts


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def read_table(spark, sf):
    return tables.read_table(spark, f"{sf}/nation.parquet", "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT c_custkey, lpad(c_nationkey::VARCHAR, 5, '0') AS jockey_id, c_mktsegment FROM customer")
def read_csv_typed(spark, sf):
    to = scratch_path(spark, "csv")
    rows = table(spark, sf, "customer").select("c_custkey", F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("jockey_id"), "c_mktsegment")
    tables.write_csv(rows, to, "overwrite")
    return tables.read_csv_typed(spark, to, "c_custkey long, jockey_id string, c_mktsegment string")


@query("SELECT o_orderkey, o_totalprice, year(o_orderdate)::INTEGER AS year FROM orders")
def write_table(spark, sf):
    to = scratch_path(spark, "table")
    tables.write_table(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year")), to, ["year"])
    return tables.read_table(spark, to)


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey::VARCHAR, s_name FROM supplier")
def write_csv(spark, sf):
    to, rows = scratch_path(spark, "csv"), table(spark, sf, "supplier").select("s_suppkey", "s_name")
    tables.write_csv(rows, to)
    tables.write_csv(rows, to)
    return tables.read_csv_typed(spark, to)


@query("SELECT strftime(ts, '%H:%M') AS time, lpad(event_id::VARCHAR, 12, '0') AS race_id FROM events")
def read_schedule(spark, sf):
    to = scratch_path(spark, "schedule")
    table(spark, sf, "events").select(F.date_format("ts", "HH:mm"), F.lpad(F.col("event_id").cast("string"), 12, "0")).write.csv(to)
    return tables.read_schedule(spark, to)


@query("SELECT page_id, (unnest(range(len(l))))::INTEGER AS pos, unnest(l) AS link FROM (SELECT page_id, regexp_extract_all(html, 'href=\"/([^\"/]+)\"', 1) AS l FROM pages)")
def extract_links(spark, sf):
    return pages.extract_links(table(spark, sf, "pages"), r'href="/([^"/]+)"')


@query("""SELECT page_id, 0 AS table_no, (unnest(range(len(l))))::INTEGER AS row_no, unnest(l) || '|abrb' AS cells
  FROM (SELECT page_id, regexp_extract_all(html, 'href="/([^"/]+)"', 1) AS l FROM pages)""")
def pages_to_tables(spark, sf):
    """The pages hold no tables: each page's links become one first, built by Spark."""
    rows = F.transform(F.regexp_extract_all("html", F.lit(r'href="/([^"/]+)"'), 1), lambda x: F.concat(F.lit("<tr><td>"), x, F.lit("</td><td>a<br />b</td></tr>")))
    built = table(spark, sf, "pages").select("page_id", F.concat(F.lit("<table>"), F.array_join(rows, ""), F.lit("</table>")).alias("html"))
    return pages.pages_to_tables(built).withColumn("cells", F.array_join("cells", "|"))


@query("SELECT page_id::VARCHAR AS page_id, coalesce(html, '') AS html, 'utf-8' AS charset, false AS damaged FROM pages")
def read_pages(spark, sf):
    """Every page as a file named after its key, read back by its name."""
    to = scratch_path(spark, "pages")
    tables.write_pages(table(spark, sf, "pages"), to)
    return tables.read_pages(spark, to)


@query("""SELECT page_id::VARCHAR AS page_id, '<meta charset="' || m || '"><td>馬番 ' || page_id || ' 着順</td>' AS html, CASE m WHEN 'x-sjis' THEN 'cp932' WHEN 'EUC-JP' THEN 'euc_jp' ELSE 'utf-8' END AS charset,
  false AS damaged FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'EUC-JP' WHEN 1 THEN 'x-sjis' ELSE 'UTF-8' END AS m FROM pages)""")
def read_pages_charsets(spark, sf):
    """Pages in three charsets in one folder, each found from what the page declares."""
    to, declared = scratch_path(spark, "pages"), {"EUC-JP": "euc_jp", "x-sjis": "cp932", "UTF-8": "utf-8"}
    for at, (name, charset) in enumerate(declared.items()):
        some = table(spark, sf, "pages").filter(F.col("page_id") % 3 == at)
        text = F.concat(F.lit(f'<meta charset="{name}"><td>馬番 '), F.col("page_id").cast("string"), F.lit(" 着順</td>"))
        tables.write_pages(some.select("page_id", text.alias("html")), to, charset=charset)
    return tables.read_pages(spark, to)


_CARRIED, _ODDS = "50 + umaban % 4 + 0.5", "1 + (horse_id % 100) / 10.0"


@query(f"""WITH {RUN}, kept AS (SELECT * FROM run WHERE flag <> 'N') SELECT race_id::VARCHAR AS race_id, umaban AS position, (umaban < 4)::INTEGER AS rank, wakuban, umaban,
  CASE flag WHEN 'A' THEN '牡' ELSE '牝' END AS sex, (quantity::INTEGER % 9)::INTEGER AS age, ({_CARRIED})::DOUBLE AS carried, round({_ODDS}, 1)::DOUBLE AS odds, (horse_id % 18 + 1)::INTEGER AS popularity,
  (quantity::INTEGER + 400)::INTEGER AS weight, (umaban - 4)::INTEGER AS weight_change, count(*) OVER (PARTITION BY race_id)::INTEGER AS n_horses, horse_id::VARCHAR AS horse_id FROM kept""")
def result_pages(spark, sf):
    """The chain from pages: a result page for each order, its table's rows, named columns, cleaned results."""
    names = ["position", "wakuban", "umaban", "sex_age", "carried", "odds", "popularity", "weight_text", "horse_id"]
    q, u = F.col("quantity").cast("int"), F.col("umaban")
    cells = [
        F.when(F.col("flag") == "N", "除外").otherwise(u.cast("string")), F.col("wakuban"), u, F.concat(F.when(F.col("flag") == "A", "牡").otherwise("牝"), (q % 9).cast("string")),
        F.expr(_CARRIED).cast("double"), F.round(F.expr(_ODDS), 1).cast("double"), F.col("horse_id") % 18 + 1, F.concat((q + 400).cast("string"), F.when(u >= 4, "(+").otherwise("("), (u - 4).cast("string"), F.lit(")")), F.col("horse_id"),
    ]
    row = F.concat(F.lit("<tr><td>"), F.concat_ws("</td> <td>", *[c.cast("string") for c in cells]), F.lit("</td></tr>"))
    head = F.lit("<html><p>x</p><table><tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>")
    rows = F.array_join(F.array_sort(F.collect_list(F.struct("umaban", row.alias("r"))))["r"], "\n")  # runners of one race
    built = runners(spark, sf).groupBy("race_id").agg(F.concat(head, rows, F.lit("</table></html>")).alias("html"))  # where the runners are
    built = built.select(F.col("race_id").cast("string").alias("page_id"), "html")
    raw = pages.main_table(pages.pages_to_tables(built), names).withColumnRenamed("page_id", "race_id")
    return cleaning.clean_results(raw)


@query(f"WITH {PAY} SELECT race_id::VARCHAR AS race_id, ticket_type, seq, array_to_string(win, ',') AS win, payout FROM pay")
def payout_pages(spark, sf):
    """The chain from pages: a payout page for each order, its tables' rows, parsed payouts."""
    cell = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("br"), F.lit("<br/>"))
    row = lambda k: F.concat(F.lit("<tr><th>"), k["kind"], F.lit("</th><td>"), cell(k["win"]), F.lit("</td><td>"), cell(k["payout"]), F.lit("</td></tr>"))
    html = F.concat(F.lit("<table>"), F.array_join(F.transform("kinds", row), ""), F.lit("</table>"))
    built = payout_kinds(runners(spark, sf)).withColumn("html", html)
    built = built.select(F.col("race_id").cast("string").alias("page_id"), "html")
    paid = parse_payouts(pages.create_return_rows(pages.pages_to_tables(built)))
    return paid.withColumn("win", F.concat_ws(",", F.transform("win", lambda x: x.cast("string"))))


_SPANNED = [[("{r}", 2, 1), ("1", 1, 1), ("2", 1, 2)], [("3", 1, 1), ("4", 2, 1), ("5", 1, 1)], [("6", 1, 2), ("7", 1, 1)]]


@query(f"""WITH {RUN} SELECT race_id::VARCHAR AS page_id, 0 AS table_no, row_no,
  CASE row_no WHEN 0 THEN race_id || '|h|h|h' WHEN 1 THEN race_id || '|1|2|2' WHEN 2 THEN race_id || '|3|4|5' ELSE '6|6|4|7' END AS cells
  FROM (SELECT DISTINCT race_id FROM run), unnest([0, 1, 2, 3]) AS u(row_no)""")
def spanned_tables(spark, sf):
    """A page for each order whose table has cells over several rows and columns, in its head and its body."""
    cell = lambda text, down, right: f'<td rowspan="{down}" colspan={right}>{text}</td>'
    body = "".join("<tr>" + "".join(cell(*c) for c in row) + "</tr>" for row in _SPANNED)
    html = "<table><thead><tr><th>{r}</th><th colspan='3' rowspan=9>h</th></tr></thead><tbody>" + body + "</tbody></table>"
    built = runners(spark, sf).select("race_id").distinct().select(F.col("race_id").cast("string").alias("page_id"))
    built = built.withColumn("html", F.replace(F.lit(html), F.lit("{r}"), F.col("page_id")))
    return pages.pages_to_tables(built).withColumn("cells", F.array_join("cells", "|"))


NEW = "(SELECT o_orderkey, 'new' AS tag, o_totalprice * 2 AS price FROM orders WHERE o_orderkey % 3 = 0)"


@query(f"SELECT o_orderkey, 'old' AS tag, o_totalprice AS price FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT * FROM {NEW}")
def upsert_by_key(spark, sf):
    orders = table(spark, sf, "orders")
    old = orders.select("o_orderkey", F.lit("old").alias("tag"), F.col("o_totalprice").alias("price"))
    new = orders.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("new").alias("tag"), (F.col("o_totalprice") * 2).alias("price"))
    return tables.upsert_by_key(old, new, "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def new_keys_only(spark, sf):
    done = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return tables.new_keys_only(table(spark, sf, "customer").select("c_custkey"), done, "c_custkey")


_URGENT = "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"


@query(_URGENT)
def new_keys_by_filter(spark, sf):
    """The same with a filter kept beside the known keys: of one half first, the other merged into it."""
    done = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    expected = customers.count()
    halves = [known_keys.key_filter(done.filter(f"c_custkey % 2 = {i}"), "c_custkey", expected) for i in (0, 1)]
    keys = stored(known_keys.merged_filter(*halves), "filter")
    return known_keys.new_keys_by_filter(customers, done, keys, "c_custkey")


TOUCHED = """(SELECT coalesce(m.id, b.id) AS id, coalesce(b.stamp, m.updated_at) AS updated_at FROM (SELECT o_custkey AS id, max(o_orderdate) AS updated_at FROM orders
  WHERE o_orderkey % 2 = 0 GROUP BY 1) m FULL JOIN (SELECT DISTINCT o_custkey AS id, TIMESTAMP '2024-02-21 00:00:00' AS stamp FROM orders WHERE o_orderkey % 5 = 0) b ON m.id = b.id)"""


def _touched(spark, sf):
    orders = table(spark, sf, "orders")
    master = orders.filter("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("updated_at"))
    return tables.touch_master(master, orders.filter("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("id")), "2024-02-21 00:00:00")


@query(f"SELECT id, updated_at::DATE AS day FROM {TOUCHED}")
def touch_master(spark, sf):
    return _touched(spark, sf).select("id", F.to_date("updated_at").alias("day"))


@query(f"SELECT id FROM {TOUCHED} WHERE updated_at::DATE = DATE '2024-02-21'")
def ids_updated_on(spark, sf):
    return tables.ids_updated_on(_touched(spark, sf), "2024-02-21")


@query(f"WITH {RUN}, {RACE} SELECT run.race_id, umaban, horse_id, date, race_class FROM run JOIN race ON run.race_id = race.race_id WHERE race_class <> '5-LOW'")
def join_race_info(spark, sf):
    known = races(spark, sf).withColumn("date", F.when(F.col("race_class") != "5-LOW", F.col("date")))
    return joins.join_race_info(runners(spark, sf), known).select("race_id", "umaban", "horse_id", "date", "race_class")


@query(f"WITH {RUN} SELECT race_id, umaban, horse_id, p_brand AS breeder_id FROM run LEFT JOIN part ON p_partkey = horse_id AND p_size > 10")
def join_horse_info(spark, sf):
    horses = table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("horse_id"), F.col("p_brand").alias("breeder_id"), F.col("p_name").alias("owner_id"))
    return joins.join_horse_info(runners(spark, sf), horses).select("race_id", "umaban", "horse_id", "breeder_id")


@query(f"WITH {RUN} SELECT race_id, umaban, horse_id, p_type AS peds_0, p_brand AS peds_1 FROM run LEFT JOIN part ON p_partkey = horse_id")
def join_peds(spark, sf):
    peds = table(spark, sf, "part").select(F.col("p_partkey").alias("horse_id"), F.col("p_type").alias("peds_0"), F.col("p_brand").alias("peds_1"))
    return joins.join_peds(runners(spark, sf), peds).select("race_id", "umaban", "horse_id", "peds_0", "peds_1")


@query(f"""WITH {RUN}, per AS (SELECT horse_id, count(*) AS starts, max(quantity) AS best FROM run GROUP BY 1)
  SELECT race_id, umaban, run.horse_id, p_type AS peds_0, p_brand AS breeder_id, starts, best FROM run LEFT JOIN part ON p_partkey = run.horse_id JOIN per ON per.horse_id = run.horse_id""")
def join_bucketed(spark, sf):
    """Runners, pedigrees and a total for each horse, of tables cut alike by the horse: joined without a shuffle."""
    keep = lambda df, name: tables.write_bucketed(df, f"{name}_{uuid4().hex}", "horse_id", 8, scratch_path(spark, name))
    ran = keep(runners(spark, sf).select("race_id", "umaban", "horse_id", "quantity"), "runners")
    peds = keep(table(spark, sf, "part").select(F.col("p_partkey").alias("horse_id"), F.col("p_type").alias("peds_0"), F.col("p_brand").alias("breeder_id")), "peds")
    starts = ran.groupBy("horse_id").agg(F.count("*").alias("starts"), F.max("quantity").alias("best"))
    rows = joins.join_peds(ran.hint("merge"), peds.hint("merge")).hint("merge").join(starts.hint("merge"), "horse_id")
    return rows.select("race_id", "umaban", "horse_id", "peds_0", "breeder_id", "starts", "best")


@query(f"WITH {PAY} SELECT DISTINCT race_id FROM pay WHERE ticket_type = 'tansho' AND race_id NOT IN (SELECT race_id FROM pay WHERE ticket_type = 'wakuren')")
def payout_gap(spark, sf):
    return joins.payout_gap(parse_payouts(payout_texts(runners(spark, sf))))


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 5)")
def history_of_runners(spark, sf):
    today = table(spark, sf, "part").filter("p_size <= 5").select(F.col("p_partkey").alias("l_partkey"))
    return joins.history_of_runners(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), today, "l_partkey")


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT s_name FROM supplier")
def union_batches(spark, sf):
    parts = [("nation", "n_name"), ("region", "r_name"), ("supplier", "s_name")]
    return joins.union_batches(*[table(spark, sf, t).select(F.col(c).alias("name")) for t, c in parts])


@query("SELECT DISTINCT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def except_known(spark, sf):
    known = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return joins.except_known(table(spark, sf, "part").select(F.col("p_partkey").alias("id")), known)


@query("SELECT DISTINCT l_partkey AS horse_id FROM lineitem")
def distinct_ids(spark, sf):
    return joins.distinct_ids(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("horse_id")))


@query("SELECT DISTINCT o_custkey AS id FROM orders ORDER BY id")
def sorted_unique_ids(spark, sf):
    return joins.sorted_unique_ids(table(spark, sf, "orders").select(F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" ")).alias("t")), "t")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark, sf):
    return profile.value_counts(table(spark, sf, "events"), "event_type")


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL")
def combo_counts(spark, sf):
    return profile.combo_counts(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("""SELECT 'big' AS "column", count(*) FILTER (WHERE o_totalprice <= 100000) AS nulls FROM orders UNION ALL SELECT 'o_orderkey', 0 FROM (SELECT 1)
  UNION ALL SELECT 'urgent', count(*) FILTER (WHERE o_orderpriority <> '1-URGENT') FROM orders""")
def null_counts(spark, sf):
    big, urgent = F.when(F.col("o_totalprice") > 100000, 1).alias("big"), F.when(F.col("o_orderpriority") == "1-URGENT", 1).alias("urgent")
    return profile.null_counts(table(spark, sf, "orders").select("o_orderkey", big, urgent))


@query("""SELECT p_partkey, 'p_name' AS "column" FROM part WHERE contains(p_name, '1') UNION ALL SELECT p_partkey, 'p_brand' FROM part WHERE contains(p_brand, '1')
  UNION ALL SELECT p_partkey, 'p_size' FROM part WHERE contains(p_size::VARCHAR, '1')""")
def find_value(spark, sf):
    return profile.find_value(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey", "1")


TOKENS = "(SELECT user_id AS race_id, event_id AS id, event_type AS info FROM events)"


def _tokens(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("race_id"), F.col("event_id").alias("id"), F.col("event_type").alias("info"))


@query(f"SELECT race_id, min(id) FILTER (WHERE regexp_matches(info, '^c')) AS c, min(id) FILTER (WHERE regexp_matches(info, 'w$')) AS w FROM {TOKENS} GROUP BY race_id")
def first_token_position(spark, sf):
    return profile.first_token_position(_tokens(spark, sf), {"c": "^c", "w": "w$"})


@query(f"SELECT race_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS positions FROM {TOKENS} WHERE regexp_matches(info, '^c') GROUP BY race_id")
def collect_positions(spark, sf):
    return profile.collect_positions(_tokens(spark, sf), "^c").withColumn("positions", F.concat_ws(",", F.transform("positions", lambda x: x.cast("string"))))
