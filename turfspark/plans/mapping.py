"""The provided tables in the roles of racing tables, in Spark and in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import parts_for

PART_ROWS = 250_000
REGISTRY: dict[str, tuple] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) with the SQL that gives the same rows."""

    def register(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by keys into as many partitions as its rows ask for; sums, windows and lists by these keys stay within them."""
    return df.repartition(parts_for(df, df.count(), PART_ROWS), *keys)


def runners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as runners, one per order and line number."""
    return (
        spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
        .groupBy(F.col("l_orderkey").alias("race_id"), F.col("l_linenumber").alias("umaban"))
        .agg(
            F.min("l_partkey").alias("horse_id"), F.min("l_suppkey").alias("jockey_id"), F.max("l_quantity").alias("quantity"), F.max("l_discount").alias("discount"),
            F.max("l_extendedprice").alias("price"), F.min("l_returnflag").alias("flag"), F.max(F.to_date("l_shipdate")).alias("ship"),
        )
        .withColumn("wakuban", F.floor((F.col("umaban") + 1) / 2).cast("int"))
    )


RUN = """run AS (SELECT l_orderkey AS race_id, l_linenumber AS umaban, min(l_partkey) AS horse_id, min(l_suppkey) AS jockey_id, max(l_quantity) AS quantity,
  max(l_discount) AS discount, max(l_extendedprice) AS price, min(l_returnflag) AS flag, max(l_shipdate)::DATE AS ship, ((l_linenumber + 1) // 2)::INTEGER AS wakuban
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def races(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("race_id"), F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("race_class"), F.col("o_orderstatus").alias("ground_state")
    )


RACE = "race AS (SELECT o_orderkey AS race_id, o_orderdate::DATE AS date, o_orderpriority AS race_class, o_orderstatus AS ground_state FROM orders)"


def day_rows(spark: SparkSession, sf_dir: str, entity: str) -> DataFrame:
    """Lines as history: one row per entity and day and return flag; ``R`` numbers a day's rows."""
    return (
        spread(table(spark, sf_dir, "lineitem").withColumn("_day", F.to_date("l_shipdate")), entity, "_day")
        .groupBy(F.col(entity).alias("horse_id"), F.col("_day").alias("date"), F.col("l_returnflag").alias("flag"))
        .agg(F.sum("l_quantity").alias("quantity"), F.max(F.round(F.col("l_discount") * 100)).alias("discount"))
        .withColumn("R", F.ascii("flag"))
    )


def day_sql(entity: str) -> str:
    return f"""hist AS (SELECT {entity} AS horse_id, l_shipdate::DATE AS date, l_returnflag AS flag, sum(l_quantity) AS quantity, max(round(l_discount * 100)) AS discount,
  ascii(l_returnflag) AS R FROM lineitem GROUP BY 1, 2, 3)"""


def payout_kinds(rows: DataFrame) -> DataFrame:
    """(race_id, kinds): payout tables in raw text, an array of (kind, win, payout); the three dearest lines of an order win."""
    order = F.struct((-F.col("price")).alias("o"), "umaban", "wakuban", F.floor("price").cast("long").alias("p"))
    top = rows.groupBy("race_id").agg(F.slice(F.array_sort(F.collect_list(order)), 1, 3).alias("t"), F.count("*").alias("n"))
    texts = F.transform("t", lambda x: F.struct(x["umaban"].cast("string").alias("u"), x["wakuban"].cast("string").alias("w"), F.format_number(x["p"], 0).alias("p")))
    top = top.select("race_id", "n", texts.alias("t"))  # once, as they come in several kinds
    u, w, p = ([F.get("t", F.lit(i))[k] for i in range(3)] for k in "uwp")
    row = lambda least, kind, win, pay: F.when(F.col("n") >= least, F.struct(F.lit(kind).alias("kind"), win.alias("win"), pay.alias("payout")))
    join = lambda sep, *c: F.concat_ws(sep, *c)
    kinds = [
        row(1, "単勝", u[0], p[0]), row(2, "複勝", join("br", u[0], u[1]), join("br", p[0], p[1])), row(2, "枠連", join(" - ", w[0], w[1]), p[1]),
        row(2, "馬連", join(" - ", u[0], u[1]), p[1]), row(2, "馬単", join(" → ", u[0], u[1]), p[0]),
        row(3, "ワイド", join("br", join(" - ", u[0], u[1]), join(" - ", u[0], u[2]), join(" - ", u[1], u[2])), join("br", p[0], p[1], p[2])),
        row(3, "三連複", join(" - ", u[0], u[1], u[2]), p[2]), row(3, "三連単", join(" → ", u[0], u[1], u[2]), join("br", p[0], F.lit(""))),
    ]
    return top.select("race_id", F.array_compact(F.array(*kinds)).alias("kinds"))


def payout_texts(rows: DataFrame) -> DataFrame:
    """The same with a row for each kind."""
    return payout_kinds(rows).select("race_id", F.explode("kinds").alias("k")).select("race_id", "k.*")


PAY = (
    RUN
    + """, top AS (SELECT race_id, list(umaban ORDER BY price DESC, umaban) AS u, list(wakuban ORDER BY price DESC, umaban) AS w,
  list(floor(price)::BIGINT ORDER BY price DESC, umaban) AS p, count(*) AS n FROM run GROUP BY race_id),
pay AS (SELECT race_id, 'tansho' AS ticket_type, 0 AS seq, [u[1]] AS win, p[1] AS payout FROM top
  UNION ALL SELECT race_id, 'fukusho', 0, [u[1]], p[1] FROM top WHERE n >= 2 UNION ALL SELECT race_id, 'fukusho', 1, [u[2]], p[2] FROM top WHERE n >= 2
  UNION ALL SELECT race_id, 'wakuren', 0, [w[1], w[2]], p[2] FROM top WHERE n >= 2 UNION ALL SELECT race_id, 'umaren', 0, [u[1], u[2]], p[2] FROM top WHERE n >= 2
  UNION ALL SELECT race_id, 'umatan', 0, [u[1], u[2]], p[1] FROM top WHERE n >= 2
  UNION ALL SELECT race_id, 'wide', 0, [u[1], u[2]], p[1] FROM top WHERE n >= 3 UNION ALL SELECT race_id, 'wide', 1, [u[1], u[3]], p[2] FROM top WHERE n >= 3
  UNION ALL SELECT race_id, 'wide', 2, [u[2], u[3]], p[3] FROM top WHERE n >= 3
  UNION ALL SELECT race_id, 'sanrenpuku', 0, [u[1], u[2], u[3]], p[3] FROM top WHERE n >= 3
  UNION ALL SELECT race_id, 'sanrentan', 0, [u[1], u[2], u[3]], p[1] FROM top WHERE n >= 3)"""
)
SCORED = """scored AS (SELECT *, round((quantity - avg(quantity) OVER (PARTITION BY race_id)) / nullif(stddev_pop(quantity) OVER (PARTITION BY race_id), 0), 9) AS score
  FROM run), flagged AS (SELECT race_id, (count(DISTINCT umaban) > count(DISTINCT wakuban))::INTEGER AS wakuban_flag FROM run GROUP BY race_id),
score AS (SELECT s.race_id, umaban, wakuban, score, wakuban_flag FROM scored s JOIN flagged f ON s.race_id = f.race_id)"""
