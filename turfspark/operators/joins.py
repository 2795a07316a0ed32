"""Equi-joins of the feature table. Sides that are small by nature are left to Spark's own size check."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_race_info(runners: DataFrame, races: DataFrame, race: str = "race_id", date: str = "date", keep_undated: bool = False) -> DataFrame:
    """Runners with their race's columns; runners whose race has no date go unless asked for."""
    out = runners.join(races, race, "left")
    return out if keep_undated else out.filter(F.col(date).isNotNull())


def join_horse_info(runners: DataFrame, horses: DataFrame, horse: str = "horse_id", drop_owner: bool = True) -> DataFrame:
    """In training the owner comes from the results; a race card has none and takes the horse table's."""
    if drop_owner:
        horses = horses.drop("owner_id")
    return runners.join(horses, horse, "left")


def join_peds(runners: DataFrame, peds: DataFrame, horse: str = "horse_id") -> DataFrame:
    return runners.join(peds, horse, "left")


def payout_gap(payouts: DataFrame, has: str = "tansho", lacks: str = "wakuren", race: str = "race_id", ticket: str = "ticket_type") -> DataFrame:
    """Races with payouts of one ticket type and none of another."""
    some = payouts.filter(F.col(ticket) == has).select(race).distinct()
    return some.join(payouts.filter(F.col(ticket) == lacks).select(race), race, "left_anti")


def history_of_runners(history: DataFrame, runners: DataFrame, horse: str = "horse_id") -> DataFrame:
    return history.join(runners.select(horse).distinct(), horse, "left_semi")


def union_batches(*batches: DataFrame) -> DataFrame:
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b)
    return out


def except_known(ids: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    return ids.join(known.select(key), key, "left_anti")


def distinct_ids(df: DataFrame, key: str = "horse_id") -> DataFrame:
    return df.select(key).dropDuplicates([key])


def sorted_unique_ids(df: DataFrame, text: str, name: str = "id") -> DataFrame:
    """Trimmed, whole-number, distinct, ascending ids of a text column."""
    ids = df.select(F.trim(text).try_cast("long").alias(name)).filter(F.col(name).isNotNull()).distinct()
    return ids.orderBy(name)
