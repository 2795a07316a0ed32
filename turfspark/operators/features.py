"""Encoders and date features."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import PART_ROWS, numbered, stored
from ..sources.scratch import scratch_path
from ..vocab import CLASSES, DIRECTIONS, GROUND, PLACES, RACE_TYPES, SEXES, WEATHER

#: column -> (categories, columns that go with it)
ONE_HOT = {
    "place_id": ([str(int(c)) for c in PLACES.values()], ["place", "time"]),
    "race_type": (list(RACE_TYPES.values()), ["race_type"]),
    "weather": (list(WEATHER), ["weather"]),
    "ground_state1": (list(GROUND), ["ground_state1"]),
    "ground_state2": (list(GROUND), ["ground_state2", "race_condition"]),
    "sex": (list(SEXES), ["sex"]),
    "around": (list(DIRECTIONS), ["around"]),
    "race_class": (list(CLASSES), ["race_class"]),
}

BROADCAST_IDS, HOT_ROWS, NULL_KEYS = 200_000, 1_000_000, 10_000
IDS = ("horse_id", "jockey_id", "trainer_id", "owner_id", "breeder_id")


def add_interval(df: DataFrame, date: str = "date", latest: str = "latest") -> DataFrame:
    return df.withColumn("interval", F.datediff(date, latest)).drop(latest)


def add_agedays(df: DataFrame, date: str = "date", birthday: str = "birthday") -> DataFrame:
    return df.withColumn("age_days", F.datediff(date, birthday)).drop(birthday)


def one_hot_columns(column: str, values: list[str], prefix: str | None = None) -> list[Column]:
    """A 0/1 column for each value, unseen ones too; an unknown or null value has none set."""
    prefix = column if prefix is None else prefix
    return [F.col(column).cast("string").eqNullSafe(v).cast("int").alias(f"{prefix}__{v}") for v in values]


def one_hot_fixed(df: DataFrame, specs: dict[str, tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """All specified columns in one select; companion columns are dropped, missing ones are skipped."""
    specs = {c: s for c, s in (ONE_HOT if specs is None else specs).items() if c in df.columns}
    gone = {d for _, drops in specs.values() for d in drops}
    new = [x for c, (values, _) in specs.items() for x in one_hot_columns(c, values)]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in gone], *new)


def label_encode_masters(
    df: DataFrame, columns: list[str], order: list[str], masters: dict[str, DataFrame | None] | None = None, part_rows: int = PART_ROWS
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(rows with ``{column}_code`` for every column, new masters (id, encoded_id)). Known ids keep their code; new ones
    get the following numbers in order of first appearance by ``order``, then by id. A null id has no code. The first
    appearances of all columns come from one aggregate, which is stored and numbered for all together.

    A column's codes are broadcast while its master has at most ``BROADCAST_IDS`` ids. A larger one is joined by id, with the
    rows of an id of more than ``HOT_ROWS`` rows, and those without an id, spread over several keys."""
    spark, masters = df.sparkSession, masters or {}
    known = [m.select(F.lit(c).alias("column"), F.col("id").cast("string").alias("id"), F.col("encoded_id").cast("long").alias("encoded_id")) for c, m in masters.items() if m is not None and c in columns]
    known = reduce(DataFrame.unionByName, known) if known else spark.createDataFrame([], "column string, id string, encoded_id long")
    ids = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("id")) for c in columns]))
    first = df.select(F.struct(*order).alias("_f"), ids.alias("_i")).select("_f", "_i.*").filter("id is not null")
    first = first.groupBy("id", "column").agg(F.min("_f").alias("_f"), F.count("*").alias("_rows"))  # sorted, so ids lead: columns are alike
    seen = stored(first.select("column", "id", "_f", "_rows"), "ids")
    first = seen.join(known, ["column", "id"], "left_anti")
    first = first.select("column", "id", *[F.col(f"_f.{c}").alias(f"_o_{c}") for c in order])
    numbers = numbered(first, ["column", *[f"_o_{c}" for c in order], "id"], "_n", 0, part_rows).select("column", "id", "_n")
    # a column's numbers follow each other; each begins after its largest known code: a row for each column
    begin = numbers.groupBy("column").agg(F.min("_n").alias("_least"))
    after = known.groupBy("column").agg((F.max("encoded_id") + 1).alias("_after"))
    offset = begin.join(after, "column", "left").select("column", (F.coalesce("_after", F.lit(0)) - F.col("_least")).alias("_offset"))
    codes = numbers.join(F.broadcast(offset), "column").select("column", "id", (F.col("_n") + F.col("_offset")).alias("encoded_id"))
    path = scratch_path(spark, "masters")
    known.unionByName(codes).write.partitionBy("column").parquet(path)
    every = spark.read.schema("id string, encoded_id long, column string").parquet(path)
    sizes = {r["column"]: r["count"] for r in every.groupBy("column").count().collect()}  # a row for each column
    hot = seen.filter(F.col("_rows") > HOT_ROWS).select("column", "id", F.ceil(F.col("_rows") / HOT_ROWS).alias("_keys"))
    out, updated = df, {c: every.filter(F.col("column") == c).select("id", "encoded_id") for c in columns}
    for c in columns:
        named = updated[c].select(F.col("id").alias("_id"), F.col("encoded_id").alias(f"{c}_code"))
        if sizes.get(c, 0) <= BROADCAST_IDS:
            out = out.join(F.broadcast(named), F.col(c).cast("string") == F.col("_id"), "left").drop("_id")
        else:
            out = _joined_by_id(out, named, hot.filter(F.col("column") == c).select(F.col("id").alias("_hot"), "_keys"), c, order)
    return out, updated


def _joined_by_id(rows: DataFrame, named: DataFrame, hot: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows with the code of their id. ``hot`` ids, fewer than one for each ``HOT_ROWS`` rows, have several keys."""
    hot = F.broadcast(hot)
    lot = F.xxhash64(*order)
    keyed = rows.join(hot, F.col(column).cast("string") == F.col("_hot"), "left")
    key = F.when(F.col(column).isNull(), -1 - F.pmod(lot, F.lit(NULL_KEYS))).otherwise(F.pmod(lot, F.coalesce("_keys", F.lit(1).cast("long"))))
    keyed = keyed.withColumn("_key", key).drop("_hot", "_keys")
    copies = named.join(hot, F.col("_id") == F.col("_hot"), "left").select("_id", f"{column}_code", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_keys", F.lit(1).cast("long")) - 1)).alias("_copy"))
    return keyed.join(copies, (F.col(column).cast("string") == F.col("_id")) & (F.col("_key") == F.col("_copy")), "left").drop("_id", "_key", "_copy")


def label_encode_master(df: DataFrame, column: str, order: list[str], master: DataFrame | None = None, drop: bool = False) -> tuple[DataFrame, DataFrame]:
    """The same for one column."""
    out, updated = label_encode_masters(df, [column], order, {column: master})
    return (out.drop(column) if drop else out), updated[column]


def clean_peds(peds: DataFrame, columns: list[str], key: str = "horse_id", part_rows: int = PART_ROWS) -> DataFrame:
    """Each column's values as codes in sorted order; null is the value "Na". One unpivot, one numbering of the distinct
    values of all positions, one pivot; nulls, which may be most of a column, get their code without a shuffle."""
    long = peds.select(key, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot([key], columns, "pos", "value")
    values = long.select("pos", F.coalesce("value", F.lit("Na")).alias("value")).distinct()
    numbers = numbered(values, ["pos", "value"], "_n", 0, part_rows)
    least = numbers.groupBy("pos").agg(F.min("_n").alias("_least"))  # a row for each column
    codes = numbers.join(F.broadcast(least), "pos").select("pos", "value", (F.col("_n") - F.col("_least")).cast("int").alias("code"))
    named = long.filter("value is not null").join(codes, ["pos", "value"]).select(key, "pos", "code")
    none = codes.filter("value = 'Na'").select("pos", "code")
    unnamed = long.filter("value is null").join(F.broadcast(none), "pos").select(key, "pos", "code")
    return named.unionByName(unnamed).groupBy(key).pivot("pos", columns).agg(F.first("code"))


def pivot_peds(pages: DataFrame, html: str = "html", key: str = "horse_id", width: int = 62, pattern: str = r"/horse/(?:ped/)?(\w{10})") -> DataFrame:
    """The first ``width`` ancestor links of a page as columns ``peds_0`` and so on."""
    links = F.regexp_extract_all(html, F.lit(pattern), 1)
    return pages.select(key, links.alias("_l")).select(key, *[F.get("_l", F.lit(i)).alias(f"peds_{i}") for i in range(width)])


def featurize(df: DataFrame, masters: dict[str, DataFrame | None] | None = None, order: list[str] = ("date", "race_id", "umaban")) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The whole chain: interval and age, one-hot columns, label codes of the id columns that are there.
    Returns the rows and the new masters."""
    if "latest" in df.columns:
        df = add_interval(df)
    if "birthday" in df.columns:
        df = add_agedays(df)
    ids = [c for c in IDS if c in df.columns]
    if not ids:
        return one_hot_fixed(df), {}
    # codes first: a join moves rows without the one-hot columns, which are made where the rows end up
    coded, updated = label_encode_masters(df, ids, list(order), masters)
    out, codes = one_hot_fixed(coded), [f"{c}_code" for c in ids]
    return out.select(*[c for c in out.columns if c not in codes], *codes), updated
