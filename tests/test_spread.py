import pytest

from turfspark.plans import mapping
from turfspark.plans.queries import queries
from turfspark.sources import pages


@pytest.mark.parametrize("name", ["spanned_tables", "payout_pages"])
def test_work_by_race_is_spread_by_rows(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(mapping, "PART_ROWS", 250)
    found = queries()[name](spark, sf_dir)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.rdd.getNumPartitions() >= 20 and plan.count("RepartitionByExpression") == 1


def test_rows_of_many_pages_leave_together(spark):
    html = "<table><tr><td>a</td></tr><tr><td>b</td><td>c</td></tr></table>"
    rows = [(i, html if i % 3 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "page_id int, html string").coalesce(1)
    want = [(i, 0, r, c) for i in range(50) if i % 3 for r, c in ((0, ["a"]), (1, ["b", "c"]))]
    for n in (1, 7, 1000):
        assert sorted(map(tuple, pages.pages_to_tables(df, rows=n).collect())) == want


def test_runners_follow_the_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(mapping, "PART_ROWS", 250)
    assert mapping.runners(spark, sf_dir).rdd.getNumPartitions() >= 20
