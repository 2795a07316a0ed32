"""The JVM interprets a generated method of more than 8,000 bytes and never compiles it."""

import re

import pytest
from pyspark.sql import functions as F

from turfspark.functions import parsing
from turfspark.operators import features
from turfspark.plans.queries import queries


@pytest.mark.parametrize("name", ["clean_history", "featurize"])
def test_generated_methods_are_compiled(spark, sf_dir, capsys, name):
    df = queries()[name](spark, sf_dir)
    capsys.readouterr()
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the code is made while it runs
    try:
        df.explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000


def test_race_seconds_of_odd_texts(spark):
    texts = [" 1:34.5\n", "1:34", "1.34.5x", "1\x0134\x015\x01", "1:34.5\x01", "１:34.5", "12:5.25", "0.05:1", ":34.5"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", parsing.race_seconds("t").alias("s")).orderBy("i").collect()
    assert [r.s for r in rows] == [94.5, None, None, None, None, None, 725.25, None, None]


def test_rows_are_joined_to_codes_without_one_hot_columns(spark, monkeypatch):
    monkeypatch.setattr(features, "BROADCAST_IDS", 0)
    rows = spark.range(40).select(F.col("id").alias("race_id"), F.lit(1).alias("umaban"), F.current_date().alias("date"), (F.col("id") % 7).alias("horse_id"), F.lit("晴").alias("weather"))
    out = features.featurize(rows)[0]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("weather__晴") < plan.index("Join") and plan.count("AS weather__晴") == 1
    assert out.columns[-1] == "horse_id_code" and {r["weather__晴"] for r in out.collect()} == {1}
