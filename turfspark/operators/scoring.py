"""Score policies: functions from a table of runners with a probability to a score table."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import grouped_totals, running_totals

NOISE = 1e-13


def _race(race: str) -> Window:
    return Window.partitionBy(race)


def frame_share_flag(df: DataFrame, race: str = "race_id", number: str = "umaban", frame: str = "wakuban", name: str = "wakuban_flag") -> DataFrame:
    """1 where a race has more runner numbers than frames."""
    numbers, frames = (F.size(F.collect_set(c).over(_race(race))) for c in (number, frame))
    return df.withColumn(name, (numbers > frames).cast("int"))


def standardised(score: Column, race: str = "race_id") -> Column:
    """Within the race, by the population deviation; null where that is 0, or no more than ``NOISE`` of the largest score, as
    scores that are equal but for the rounding of their sums have it: what is divided then depends on the order of the rows."""
    deviation = F.stddev_pop(score).over(_race(race))
    real = F.isnan(deviation) | (deviation > NOISE * F.max(F.abs(score)).over(_race(race)))
    return F.try_divide(score - F.avg(score).over(_race(race)), F.when(real, deviation))


def score_basic(df: DataFrame, score: str = "score", race: str = "race_id") -> DataFrame:
    return frame_share_flag(df, race).select(race, "umaban", "wakuban", score, "wakuban_flag")


def score_std(df: DataFrame, score: str = "score", race: str = "race_id") -> DataFrame:
    return score_basic(df, score, race).withColumn(score, standardised(F.col(score), race))


def score_relative(df: DataFrame, score: str = "score", race: str = "race_id") -> DataFrame:
    return score_basic(df, score, race).withColumn(score, F.try_divide(F.col(score), F.sum(score).over(_race(race))))


def score_minmax(df: DataFrame, score: str = "score", race: str = "race_id") -> DataFrame:
    """Standardised, then scaled to 0..1 over all rows by a one-row aggregate."""
    table = score_std(df, score, race)
    ends = table.agg(F.struct(F.min(score).alias("low"), F.max(score).alias("high")).alias("e")).scalar()
    return table.withColumn(score, F.try_divide(F.col(score) - ends["low"], ends["high"] - ends["low"]))


def race_rank_by_score(df: DataFrame, score: str = "score", race: str = "race_id", tie: str = "umaban", name: str = "score_rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(_race(race).orderBy(F.desc_nulls_last(score), tie)))


def top_runners(df: DataFrame, n: int = 3, score: str = "score", race: str = "race_id", tie: str = "umaban") -> DataFrame:
    return race_rank_by_score(df, score, race, tie, "score_rank").filter(F.col("score_rank") <= n)


def auc(df: DataFrame, score: str = "score", label: str = "label", by: str | None = None, rows: str | None = None) -> DataFrame:
    """Exact area under the ROC curve, ties counting half, from counts per distinct score; by fold if asked,
    whose scores are spread over ranges like any others. A row stands for as many as ``rows`` says. Null where a class is missing."""
    keys = [by] if by else []
    n = F.col(rows).cast("long") if rows else F.lit(1).cast("long")
    counts = df.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum(F.col(label).cast("long") * n).alias("pos"), F.sum(n).alias("n"))
    counts = counts.withColumn("neg", F.col("n") - F.col("pos"))
    below = {"below": F.col("neg")}
    counts = grouped_totals(counts, keys, [score], below) if by else running_totals(counts, [score], below)
    area = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return counts.groupBy(*keys).agg(F.try_divide(area, F.sum("pos") * F.sum("neg").cast("double")).alias("auc"))
