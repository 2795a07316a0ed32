import datetime as dt
import random

import pandas as pd
import pytest

from turfspark.operators import history as H
from turfspark.streaming import history_stream as HS

CARD, RESULT = "race_id int, horse_id int, date date, g string", "horse_id int, date date, g string, R int, t1 double, t2 double"


def same(got, want):
    key = lambda r: r[0]
    fix = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert sorted(map(fix, got), key=key) == sorted(map(fix, want), key=key)


@pytest.fixture
def run(spark, tmp_path):
    """Puts files into two folders and runs all that arrived through the stream; returns all rows so far."""
    cards, results, out = (str(tmp_path / n) for n in ("cards", "results", "out"))

    def arrive(card_rows, result_rows):
        spark.createDataFrame(card_rows, CARD).coalesce(1).write.mode("append").parquet(cards)
        spark.createDataFrame(result_rows, RESULT).coalesce(1).write.mode("append").parquet(results)
        rows = HS.history_feature_stream(spark.readStream.schema(CARD).parquet(cards), spark.readStream.schema(RESULT).parquet(results), ["t1", "t2"], ["g"])
        with HS.state_store(spark):
            rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
        return spark.read.schema(rows.schema).parquet(out)

    return arrive


def test_every_prefix_equals_the_batch_features(spark, run):
    rnd = random.Random(4)
    day = lambda k: dt.date(2023, 1, 1) + dt.timedelta(k)
    value = lambda: rnd.choice([None, float("nan"), 1.0, 2.5, 7.0, 3.25])
    group = lambda: rnd.choice(["a", "b", None])
    cards, results, number = [], [], 0
    for begin, end in ((0, 5), (5, 6), (6, 20)):
        new_cards, new_results = [], []
        for k in range(begin, end):
            for _ in range(6):
                number += 1
                horse = rnd.choice([1, 2, 3, 3, 3, None])
                new_cards.append((number, horse, day(k), group()))
                new_results.append((rnd.choice([1, 2, 3, 3, 3, None]), day(k), group(), number, value(), value()))
        new_cards.append((1000 + end, 9, None, "a"))
        cards, results = cards + new_cards, results + new_results
        got = run(rnd.sample(new_cards, len(new_cards)), rnd.sample(new_results, len(new_results)))
        want = H.history_features(spark.createDataFrame(cards, CARD), spark.createDataFrame(results, RESULT), ["t1", "t2"], ["g"], path="linear")
        assert got.columns == [*want.columns, "late"] and got.filter("late").count() == 0
        same(got.drop("late").collect(), want.collect())


def test_results_of_the_day_enter_the_next_one_and_late_rows_are_told(spark, run):
    d = lambda k: dt.date(2024, 3, k)
    run([(1, 7, d(1), "a")], [(7, d(1), "a", 1, 4.0, 1.0)])
    run([(2, 7, d(1), "a")], [(7, d(1), "a", 2, 8.0, 1.0)])  # more of the same day, in a later trigger
    rows = {r.race_id: r for r in run([(3, 7, d(2), "a"), (4, 7, d(1), "a")], [(7, d(2), "b", 1, 2.0, 1.0)]).collect()}
    assert (rows[1].t1_allR, rows[2].t1_allR, rows[3].t1_allR, rows[3].latest) == (None, None, 6.0, d(1))
    assert not rows[4].late
    rows = {r.race_id: r for r in run([(5, 7, d(3), "b"), (6, 7, d(1), "a")], [(7, d(1), "a", 3, 100.0, 1.0)]).collect()}
    assert rows[6].late is False or rows[6].t1_allR is None
    rows = {r.race_id: r for r in run([(7, 7, d(1), "a"), (8, 7, d(4), "b")], [(7, d(3), "b", 1, 6.0, 1.0)]).collect()}
    assert rows[7].late and rows[7].t1_allR is None
    assert (rows[8].t1_allR, rows[8].t1_g_allR, rows[8].t1_5R) == (5.0, 4.0, 5.0)


def test_one_call_takes_a_bucket_of_entities():
    class States(dict):
        getValue, updateValue = dict.get, dict.__setitem__

    class Handle:
        def getMapState(self, *_):
            return states

    states, names = States(), HS.feature_names(["t1"], ["g"], (5,))
    processor = HS._Processor(names, 1, (5,))
    processor.init(Handle())
    columns = ["entity", "day", "is_result", "groups", "card", "ordering", "values"]
    rows = [(str(e), f"2024-03-0{d}", r, '["a"]', None if r else f"{e} {d}", f"[{e}]" if r else None, f"[{e}.0]" if r else None) for d in (2, 1) for r in (True, False) for e in range(50)]
    frames = list(processor.handleInputRows((7,), iter([pd.DataFrame(rows, columns=columns)])))
    assert len(frames) == 1 and len(frames[0]) == 100 and len(states) == 50
    got = {r.card: (r.t1_allR, r.t1_g_5R, r.latest) for r in frames[0].itertuples()}
    assert got["30 2"] == (30.0, 30.0, "2024-03-01") and got["30 1"][2] is None
