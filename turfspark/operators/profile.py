"""Profiling of tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def combo_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls): one aggregate over the table."""
    one = df.agg(*[F.coalesce(F.sum(F.col(f"`{c}`").isNull().cast("long")), F.lit(0)).alias(c) for c in df.columns])
    return one.unpivot([], [F.col(f"`{c}`") for c in df.columns], "column", "nulls")


def find_value(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, column) of every cell that contains a text."""
    others = [c for c in df.columns if c != key]
    cells = df.select(key, *[F.col(f"`{c}`").cast("string").alias(c) for c in others]).unpivot([key], others, "column", "value")
    return cells.filter(F.col("value").contains(text)).select(key, "column")


def first_token_position(df: DataFrame, patterns: dict[str, str], key: str = "race_id", position: str = "id", token: str = "info") -> DataFrame:
    """Per key, the first position of a token that matches each pattern."""
    return df.groupBy(key).agg(*[F.min(F.when(F.col(token).rlike(p), F.col(position))).alias(n) for n, p in patterns.items()])


def collect_positions(df: DataFrame, pattern: str, key: str = "race_id", position: str = "id", token: str = "info", name: str = "positions") -> DataFrame:
    """Per key, all positions of matching tokens, ascending; keys have as many as a page has tokens."""
    return df.filter(F.col(token).rlike(pattern)).groupBy(key).agg(F.array_sort(F.collect_list(position)).alias(name))
