"""Race day: which races are due, and scoring of race cards as they arrive."""

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.cleaning import clean_race_card
from ..operators.history import history_features
from ..operators.scoring import race_rank_by_score, score_std


def schedule_order(races: DataFrame, date: str = "date", time: str = "time") -> DataFrame:
    return races.orderBy(date, time)


def previous_post_time(races: DataFrame, keys: tuple[str, ...] = ("date", "place_id"), race: str = "race_id", time: str = "post_time", name: str = "previous_post_time") -> DataFrame:
    return races.withColumn(name, F.lag(time).over(Window.partitionBy(*keys).orderBy(race)))


def active_races(races: DataFrame, now, minutes: int = 50, keys: tuple[str, ...] = ("date", "place_id"), race: str = "race_id", time: str = "post_time") -> DataFrame:
    """Races that are next in their meeting at ``now``, or whose weights were announced (``minutes`` before
    the post time) in the last ``minutes``; the first race of a meeting is next from its announcement on."""
    wait = F.make_interval(mins=F.lit(minutes))
    instant = F.lit(now).cast("timestamp")
    rows = previous_post_time(races, keys, race, time, "_before").withColumn("_announced", F.col(time) - wait)
    since = F.coalesce("_before", "_announced")
    due = (since < instant) & (instant < F.col(time))
    announced = (F.col("_announced") > instant - wait) & (F.col("_announced") <= instant)
    return rows.filter(due | announced).drop("_before", "_announced")


def day_of_scoring(
    cards: DataFrame, history: DataFrame, score: Callable[[DataFrame], DataFrame], targets: list[str], groups: list[str] = (), features: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Cards of many races at once: clean, history features, further features, score, rank within the race.
    ``score`` adds a column ``score``."""
    rows = history_features(clean_race_card(cards), history, targets, groups)
    rows = score(features(rows) if features else rows)
    return race_rank_by_score(score_std(rows), "score")


def score_stream(stream: DataFrame, score_batch: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """The same as cards arrive: every trigger scores its new cards against the history as it is then.
    A batch that runs again after a failure overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        score_batch(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
