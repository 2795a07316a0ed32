"""Splits by time, whole races at a time, and the columns to learn from."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _race_numbers(df: DataFrame, race: str, date: str) -> DataFrame:
    """Distinct races with their number in the order (date, race), from 0, and their count: races are
    numbered within each day, days' totals are added up."""
    races = df.select(race, F.col(date).alias("_date")).filter(F.col(date).isNotNull()).groupBy(race).agg(F.min("_date").alias("_date"))
    days = races.groupBy("_date").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_date").rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    everything = Window.orderBy("_date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    days = days.select("_date", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(everything).alias("_total"))
    within = F.row_number().over(Window.partitionBy("_date").orderBy(race))
    return races.join(days, "_date").select(race, (F.col("_before") + within - 1).alias("_number"), "_total")


def split_by_time(df: DataFrame, test: float = 0.3, valid: float = 0.3, race: str = "race_id", date: str = "date", name: str = "fold") -> DataFrame:
    """Adds ``fold``: the first round(n (1 - test)) races are for training, of which the last part, cut the
    same way, validates; rounding is half to even. Rows without a date go."""
    numbers = _race_numbers(df, race, date)
    train = F.bround(F.col("_total") * (1 - test), 0)
    fit = F.bround(train * (1 - valid), 0)
    fold = F.when(F.col("_number") >= train, "test").when(F.col("_number") >= fit, "valid").otherwise("train")
    return df.join(numbers.select(race, fold.alias(name)), race)


def split_three_way(df: DataFrame, valid: float = 0.2, test: float = 0.2, race: str = "race_id", date: str = "date", name: str = "fold") -> DataFrame:
    """Contiguous thirds: floor(n valid) and floor(n test) races at the end, the rest to train on."""
    numbers = _race_numbers(df, race, date)
    n_valid, n_test = F.floor(F.col("_total") * valid), F.floor(F.col("_total") * test)
    train = F.col("_total") - n_valid - n_test
    fold = F.when(F.col("_number") < train, "train").when(F.col("_number") < train + n_valid, "valid").otherwise("test")
    return df.join(numbers.select(race, fold.alias(name)), race)


def xy_columns(df: DataFrame, target: str = "rank", drop: tuple[str, ...] = ("date", "odds", "race_id", "fold")) -> tuple[list[str], str]:
    """Numeric feature columns, and the target."""
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint", "boolean")
    return [c for c, kind in df.dtypes if kind in numeric and c != target and c not in drop], target
