"""Global numbering and running sums without a single-task window: rows are range-partitioned on the whole order,
numbered within partitions, and the partitions' totals, a row each, are added up. The number of partitions follows
the number of rows, and equal values of the leading key may lie in several."""

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path

PART_ROWS, LEAST_ROWS = 1_000_000, 20_000


def parts_for(df: DataFrame, n: int, part_rows: int = PART_ROWS, least: int = LEAST_ROWS) -> int:
    """Number of partitions of ``part_rows`` rows; of small tables partitions have ``least`` rows, up to two for each core."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, ceil(n / part_rows), min(ceil(n / min(least, part_rows)), 2 * cores))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, order: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """``df`` with ``_part``, ascending with the order (nulls first). It's written to the shared folder, since ranges are
    sampled and must be the same wherever they are used; before that as it is, so that what gives it runs once."""
    df = stored(df, "unordered")
    parts = parts_for(df, df.count(), part_rows)
    rows = df.repartitionByRange(parts, *[F.asc_nulls_first(c) for c in order]).withColumn("_part", F.spark_partition_id())
    return stored(rows, "ranged")


def running_totals(df: DataFrame, order: list[str], values: dict[str, Column], part_rows: int = PART_ROWS) -> DataFrame:
    """Adds for each of ``values`` its sum over all rows strictly before the row in the order; nulls come first. The
    order must be total for a defined result."""
    rows = ranged(df.withColumns({f"_v_{n}": v for n, v in values.items()}), order, part_rows)
    within = Window.partitionBy("_part").orderBy(*[F.asc_nulls_first(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    totals = rows.groupBy("_part").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_t_{n}") for n in values])
    out = rows.join(totals, "_part")  # Spark broadcasts it while it's small
    sums = {n: F.coalesce(F.sum(f"_v_{n}").over(within), F.lit(0)) + F.col(f"_t_{n}") for n in values}
    return out.withColumns(sums).drop("_part", *[f"_{k}_{n}" for n in values for k in "vt"])


def numbered(df: DataFrame, order: list[str], name: str, start: int | Column = 0, part_rows: int = PART_ROWS) -> DataFrame:
    """Row number from ``start`` on in the order."""
    out = running_totals(df, order, {name: F.lit(1).cast("long")}, part_rows)
    return out.withColumn(name, F.col(name) + start)


def grouped_totals(df: DataFrame, group: list[str], order: list[str], values: dict[str, Column], part_rows: int = PART_ROWS) -> DataFrame:
    """Adds for each of ``values`` its sum over the rows of the same group strictly before the row in the order; nulls
    come first. A group of any size is spread over ranges: only one that crosses the bounds of a range takes sums over
    from the ranges before, at most a row for each range."""
    rows = ranged(df.withColumns({f"_v_{n}": v for n, v in values.items()}), [*group, *order], part_rows)
    within = Window.partitionBy("_part", *group).orderBy(*[F.asc_nulls_first(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    key = F.struct(*group)
    ends = rows.groupBy("_part").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    crossing = ends.withColumn("before", F.lag("last").over(Window.orderBy("_part"))).filter(F.col("first").eqNullSafe(F.col("before")))
    crossing = F.broadcast(crossing.select(F.col("first").alias("_key")).distinct())
    totals = rows.select("_part", key.alias("_group"), *[f"_v_{n}" for n in values]).join(crossing, F.col("_group").eqNullSafe(F.col("_key")), "left_semi")
    totals = totals.groupBy("_part", "_group").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col("_part").alias("_at"), "_group", *[F.sum(f"_t_{n}").over(before).alias(f"_t_{n}") for n in values])
    same = (F.col("_part") == F.col("_at")) & key.eqNullSafe(F.col("_group"))
    out = rows.join(F.broadcast(carried), same, "left")
    sums = {n: F.coalesce(F.sum(f"_v_{n}").over(within), F.lit(0)) + F.coalesce(F.col(f"_t_{n}"), F.lit(0)) for n in values}
    return out.withColumns(sums).drop("_part", "_at", "_group", *[f"_{k}_{n}" for n in values for k in "vt"])
