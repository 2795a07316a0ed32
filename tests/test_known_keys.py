import random

import pytest

from turfspark.sources import known_keys as K
from turfspark.sources import tables

IDS = "id long, v string"


def frames(spark, n=3000, seed=5):
    rnd = random.Random(seed)
    known = [(rnd.randrange(4 * n), "k") for _ in range(n)] + [(None, "k")] * 3
    batch = [(rnd.randrange(4 * n), str(i)) for i in range(400)] + [(None, "null"), (7, "twice"), (7, "twice")]
    return spark.createDataFrame(known, IDS), spark.createDataFrame(batch, IDS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("bits", [16, 2])  # 2: most of the answers are false positives
@pytest.mark.parametrize("broadcast_keys", [K.BROADCAST_KEYS, 0])
def test_result_is_that_of_the_anti_join(spark, bits, broadcast_keys):
    known, batch = frames(spark)
    keys = K.key_filter(known, "id", 3000, bits)
    got = K.new_keys_by_filter(batch, known, keys, "id", broadcast_keys)
    assert got.columns == batch.columns
    assert rows(got) == rows(tables.new_keys_only(batch, known, "id"))


def test_false_positives_follow_the_size_and_no_known_key_is_missed(spark):
    known = spark.range(0, 20000).withColumnRenamed("id", "k")
    other = spark.range(100000, 120000).withColumnRenamed("id", "k")
    share = lambda df, bits: K.possibly_known(df, K.key_filter(known, "k", 20000, bits), "k").filter("possibly").count() / 20000
    assert share(known, 16) == share(known, 2) == 1.0
    assert share(other, 16) < 0.03 and 0.2 < share(other, 2)
    assert K.filled(K.key_filter(known, "k", 20000)) < 0.5 < K.filled(K.key_filter(known, "k", 2000))


def test_merged_filters_equal_one_of_all_keys(spark):
    known, _ = frames(spark)
    parts = [K.key_filter(known.filter(f"id % 3 = {i}"), "id", 3000) for i in range(3)]
    whole = rows(K.key_filter(known, "id", 3000))
    assert rows(K.merged_filter(*parts)) == rows(K.merged_filter(parts[2], *parts)) == whole  # in any order, and again
    with pytest.raises(Exception, match="filters differ"):
        K.merged_filter(parts[0], K.key_filter(known, "id", 100)).collect()


def test_known_keys_are_not_read_without_a_possible_hit(spark, tmp_path):
    path = str(tmp_path / "known")
    spark.range(0, 50).write.parquet(path)
    known = spark.read.parquet(path)
    keys = spark.createDataFrame(K.key_filter(known, "id", 50, 64, 8).collect(), "word long, bits long, words long, hashes int")
    batch = spark.range(1000, 1040)
    got = K.new_keys_by_filter(batch, known, keys, "id")
    assert got.count() == 40 and path not in str(got.inputFiles())
    assert path in str(K.new_keys_by_filter(spark.range(49, 60), known, keys, "id").inputFiles())


def test_empty_sides_and_types(spark):
    known, batch = frames(spark)
    none = known.limit(0)
    assert rows(K.new_keys_by_filter(batch, none, K.key_filter(none, "id", 10), "id")) == rows(batch)
    assert K.new_keys_by_filter(batch.limit(0), known, K.key_filter(known, "id", 10), "id").count() == 0
    with pytest.raises(ValueError, match="types"):
        K.new_keys_by_filter(batch.selectExpr("cast(id as string) id"), known, K.key_filter(known, "id", 10), "id")
    with pytest.raises(ValueError, match="double"):
        K.key_filter(batch.selectExpr("cast(id as double) id"), "id", 10)


def test_tables_cut_alike_join_and_group_without_a_shuffle(spark, tmp_path):
    from turfspark.operators.joins import join_horse_info, join_peds

    rnd = random.Random(2)
    ran = spark.createDataFrame([(i, rnd.choice([None, *range(40)])) for i in range(500)], "race_id int, horse_id int")
    horses = spark.createDataFrame([(h, f"b{h}", f"o{h}") for h in range(0, 40, 2)], "horse_id int, breeder_id string, owner_id string")
    peds = spark.createDataFrame([(h, f"p{h}") for h in range(30)], "horse_id int, peds_0 string")
    kept = [tables.write_bucketed(df, f"cut_{n}", "horse_id", 4, str(tmp_path / n)) for n, df in (("ran", ran), ("horses", horses), ("peds", peds))]
    merge = [t.hint("merge") for t in kept]
    got = join_peds(join_horse_info(merge[0], merge[1]).hint("merge"), merge[2])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(got) and plan(got).count("SortMergeJoin") == 2
    assert rows(got) == rows(join_peds(join_horse_info(ran, horses), peds))
    assert "Exchange" not in plan(kept[0].groupBy("horse_id").count())
    assert "Exchange" in plan(join_peds(ran.hint("merge"), peds))
    schema = kept[2].schema
    spark.sql("DROP TABLE cut_peds")  # an external table: its files stay
    again = tables.open_bucketed(spark, "cut_peds", schema, str(tmp_path / "peds"), "horse_id", 4)
    assert rows(again) == rows(peds)
    assert "Exchange" not in plan(join_peds(merge[0], again.hint("merge")))
    for n in ("ran", "horses", "peds"):
        spark.sql(f"DROP TABLE cut_{n}")
