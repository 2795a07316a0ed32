"""Cleaning of the raw tables: row-wise expressions, one select each; only ``field_size`` shuffles."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parsing as P


def strip_column_spaces(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace(" ", "") for c in df.columns])


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def finished_only(df: DataFrame, position: str = "position") -> DataFrame:
    """Rows whose finishing position is a number, as an integer."""
    return df.withColumn(position, P.whole(F.col(position).cast("string"))).filter(F.col(position).isNotNull())


def top3_label(position: Column | str = "position") -> Column:
    return F.when(P._col(position) < 4, 1).otherwise(0)


def field_size(df: DataFrame, race: str = "race_id", name: str = "n_horses") -> DataFrame:
    return df.withColumn(name, F.count("*").over(Window.partitionBy(race)))


def conform_types(df: DataFrame, rules: list[tuple[str, str, int]]) -> DataFrame:
    """Declared casts: to int with null as 0; to text with leading zeros up to a width, never cut."""
    changed = {}
    for column, kind, width in rules:
        if column in df.columns:
            if kind == "int":
                changed[column] = F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(0.0)), F.lit(0.0)).cast("int")
            else:
                c = F.col(column)
                c = c.cast("long") if dict(df.dtypes)[column] in ("double", "float") else c
                changed[column] = P.zero_padded(c.cast("string"), width)
    return df.withColumns(changed)


def clean_results(df: DataFrame, train: bool = True) -> DataFrame:
    """Results, or with ``train`` off a race card: no position, no label."""
    if train:
        df = field_size(finished_only(df))
    else:
        df = field_size(df)
    label = [F.col("position"), top3_label().alias("rank")] if train else []
    sex = F.coalesce(P.sex("sex_age"), F.lit(None))
    return df.select(
        "race_id", *label, P.whole("wakuban").alias("wakuban"), P.whole("umaban").alias("umaban"), sex.alias("sex"), P.age("sex_age").alias("age"),
        F.col("carried").try_cast("double").alias("carried"), F.col("odds").try_cast("double").alias("odds"), P.whole("popularity").alias("popularity"),
        P.weight("weight_text").alias("weight"), P.weight_change("weight_text").alias("weight_change"), F.col("n_horses").cast("int").alias("n_horses"),
        *[c for c in ("horse_id", "jockey_id", "trainer_id", "owner_id") if c in df.columns],
    )


def fill_prize(prize: Column | str = "prize") -> Column:
    return F.coalesce(F.nanvl(P._col(prize), F.lit(None).cast("double")), F.lit(0.0))


def clip_margin(margin: Column | str = "margin") -> Column:
    c = F.nanvl(P._col(margin), F.lit(None).cast("double"))
    return F.when(c < 0, 0.0).otherwise(c)


def corner_positions(passing: Column | str = "corner_text", position: Column | str = "position") -> dict[str, Column]:
    first, final, rank = P.first_corner(passing), P.final_corner(passing), P._col(position)
    return {"first_corner": first, "final_corner": final, "final_to_rank": final - rank, "first_to_rank": first - rank, "first_to_final": first - final}


def clean_history(df: DataFrame) -> DataFrame:
    df = finished_only(df)
    corners = corner_positions()
    return df.select(
        "horse_id", P.slashed_date("date_text").alias("date"), "R", P.place_code("place_text").alias("place_code"), "weather", P.whole(F.col("n_horses").cast("string")).alias("n_horses"),
        F.nanvl("wakuban", F.lit(None).cast("double")).cast("int").alias("wakuban"), F.col("umaban").cast("int").alias("umaban"), "odds",
        F.nanvl("popularity", F.lit(None).cast("double")).cast("int").alias("popularity"), "position", top3_label().alias("rank"), "carried",
        P.race_type("course_text").alias("race_type"), P.hundreds("course_text").alias("course_len"), "ground_state", P.race_seconds("time_text").alias("time"),
        clip_margin().alias("margin"), *[c.alias(n) for n, c in corners.items()], "last_3f", fill_prize().alias("prize"),
    )


def clean_race_info(df: DataFrame) -> DataFrame:
    fixed = {"course_len": P.hundreds("course_len"), "date": P.japanese_date("date"), "place_id": P.whole(F.col("place_id").cast("string"))}
    return df.withColumns(fixed).drop("age", "sex")


def clean_horse_info(df: DataFrame) -> DataFrame:
    return df.select("horse_id", P.japanese_date("birthday_text").alias("birthday"), "owner_id", "breeder_id")


def drop_scratched(df: DataFrame, weight: str = "weight_text") -> DataFrame:
    return df.filter(F.coalesce(F.col(weight), F.lit("")) != "--")


def default_weights(df: DataFrame, weight: str = "weight_text") -> DataFrame:
    """The day before the race no weights are known."""
    return df.withColumn(weight, F.lit("0(0)"))


def clean_race_card(df: DataFrame) -> DataFrame:
    """A card in the shape of cleaned results with the race's fields; its one ground state stands for both."""
    race = ["course_len", "weather", "race_type", "ground_state", "date", "around", "race_class"]
    races = df.select("race_id", *[c for c in race if c in df.columns]).dropDuplicates(["race_id"])
    out = clean_results(drop_scratched(df), train=False).join(races, "race_id")
    fixed = {"date": F.coalesce(P.japanese_date(F.col("date").cast("string")), P.slashed_date(F.col("date").cast("string"))), "course_len": P.hundreds("course_len")}
    fixed |= {"place_id": P.whole(P.race_place("race_id")), "ground_state1": F.col("ground_state"), "ground_state2": F.col("ground_state")}
    return out.withColumns(fixed).drop("ground_state")


def vocab_check(df: DataFrame, vocabulary: dict[str, tuple[str, ...]], key: str = "race_id") -> DataFrame:
    """(key, column, value) of every value outside its list."""
    wrong = [F.when(~F.col(c).isin(*words), F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))) for c, words in vocabulary.items()]
    return df.select(key, F.explode(F.array_compact(F.array(*wrong))).alias("x")).select(key, "x.column", "x.value")
