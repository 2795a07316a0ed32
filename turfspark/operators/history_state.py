"""As-of features from a stored state, so that a day reads that day and its entities, not all history.

The state of an entity has the sums and counts of its targets over all rows, and the newest rows, as many as the
widest window; the state of an entity and a category has sums and counts only. States of different rows of history
are merged by adding sums and keeping the newest rows of both: in any order and grouping, to the same state. Its size
follows the number of entities and categories, not that of rows.

A row of the state: the entity, ``kind`` and ``category`` (null for the entity as a whole, else the group's column and
its value as text), ``s_{target}`` and ``n_{target}``, and ``last``, the newest rows, newest first (null for categories).

Null entities, rows without a day, and null categories have no state, as they have no features. Means skip nulls and NaN.
Ties within a day are ordered by ``order`` columns, and between rows alike in these by targets, the larger the newer.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import stored
from ..sources import tables
from .history import WINDOWS, recent_rank

BUCKETS = 64


def _value(df: DataFrame, c: str) -> Column:
    kind, value = dict(df.dtypes)[c], F.col(c).cast("double")
    return F.nanvl(value, F.lit(None).cast("double")) if kind in ("double", "float") else value


def _newest(lists: Column, n: int) -> Column:
    return F.slice(F.reverse(F.array_sort(lists)), 1, n)


def state_of(
    history: DataFrame, targets: list[str], groups: list[str] = (), windows: tuple[int, ...] = WINDOWS, entity: str = "horse_id", when: str = "date", order: tuple[str, ...] = ("R",)
) -> DataFrame:
    """The state of some rows of history. Rows are summed by day before they meet, and only a day's newest are carried on, so
    that an entity with a large part of all rows costs as many rows as it has days."""
    n = max(windows, default=1)
    rows = history.withColumn(when, F.to_date(when)).filter(F.col(when).isNotNull() & F.col(entity).isNotNull())
    rows = rows.select(entity, F.col(when).alias("_w"), *[F.col(c).alias(f"_o_{c}") for c in order], *[_value(rows, t).alias(f"_t_{t}") for t in targets], *[F.col(g).cast("string").alias(f"_g_{g}") for g in groups])
    sums = [f(f"_t_{t}").alias(f"{a}_{t}") for t in targets for a, f in (("s", F.sum), ("n", F.count))]
    entry = F.struct(*[c for c in rows.columns if c != entity])
    ranked = rows.withColumn("_rn", recent_rank([entity, "_w"], F.col("_w"), [F.col(c) for c in rows.columns if c not in (entity, "_w")])).filter(F.col("_rn") <= n)
    ranked = ranked.withColumn("_rn", recent_rank([entity], F.col("_w"), [-F.col("_rn")])).filter(F.col("_rn") <= n)
    newest = ranked.groupBy(entity).agg(_newest(F.collect_list(entry), n).alias("last"))
    none = F.lit(None).cast("string")
    out = rows.groupBy(entity).agg(*sums).join(newest, entity).select(entity, none.alias("kind"), none.alias("category"), *_sum_names(targets), "last")
    for g in groups:
        some = rows.filter(F.col(f"_g_{g}").isNotNull()).groupBy(entity, F.lit(g).alias("kind"), F.col(f"_g_{g}").alias("category")).agg(*sums)
        out = out.unionByName(some.withColumn("last", F.lit(None).cast(out.schema["last"].dataType)))
    return out


def _sum_names(targets: list[str]) -> list[str]:
    return [f"{a}_{t}" for t in targets for a in ("s", "n")]


def _targets(state: DataFrame) -> list[str]:
    return [c[2:] for c in state.columns if c.startswith("s_")]


def merge(states: list[DataFrame], windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """One state of several, of different rows of history."""
    first, n = states[0], max(windows, default=1)
    both = first
    for s in states[1:]:
        both = both.unionByName(s)
    keys = [c for c in first.columns if c != "last" and c not in _sum_names(_targets(first))]
    last = F.when(F.col("kind").isNull(), _newest(F.flatten(F.collect_list("last")), n))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _sum_names(_targets(first))], last.alias("last")).select(*first.columns)


def unseen(state: DataFrame, history: DataFrame, entity: str = "horse_id", when: str = "date") -> DataFrame:
    """Rows of later days than the entity's state has seen: a day that comes twice counts once. A day's rows come together."""
    seen = state.filter("kind is null").select(entity, F.col("last")[0]["_w"].alias("_seen"))
    return history.join(seen, entity, "left").filter(F.col("_seen").isNull() | (F.to_date(when) > F.col("_seen"))).drop("_seen")


def _bucketed(state: DataFrame, entity: str, buckets: int) -> DataFrame:
    return state.withColumn("bucket", F.pmod(F.xxhash64(F.col(entity).cast("string")), F.lit(buckets)).cast("int"))


def save(state: DataFrame, path: str, entity: str = "horse_id", buckets: int = BUCKETS) -> None:
    """A table with a folder for each bucket of entities, sorted by entity, so that a few entities are found by few reads."""
    rows = _bucketed(state, entity, buckets).repartition("bucket").sortWithinPartitions("bucket", entity)
    tables.write_table(rows, path, ["bucket"])


def load(spark: SparkSession, path: str, schema, of: DataFrame | None = None, entity: str = "horse_id", buckets: int = BUCKETS) -> DataFrame:
    """The stored state, of the schema that ``state_of`` gives; with ``of`` only that of its entities, from their buckets (at
    most ``buckets`` numbers are collected)."""
    state = spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(path)
    if of is None:
        return state.drop("bucket")
    wanted = of.select(entity).distinct()
    some = [r[0] for r in _bucketed(wanted, entity, buckets).select("bucket").distinct().collect()]
    return state.filter(F.col("bucket").isin(some)).join(wanted, entity, "left_semi").drop("bucket")


def advance(spark: SparkSession, path: str, day: DataFrame, targets: list[str], groups: list[str] = (), windows: tuple[int, ...] = WINDOWS, entity: str = "horse_id", when: str = "date",
            order: tuple[str, ...] = ("R",), buckets: int = BUCKETS) -> None:
    """Adds a day, or several, to the stored state: of the entities that ran the state is read, merged and replaced, in
    their buckets. Days come in ascending order for each entity; what was added before, by a run that failed or ran
    again, isn't added twice."""
    schema = state_of(day, targets, groups, windows, entity, when, order).schema
    old = load(spark, path, schema, day, entity, buckets)
    fresh = stored(unseen(old, day, entity, when), "fresh")  # sums, newest rows and each group read it
    new = state_of(fresh, targets, groups, windows, entity, when, order)
    merged = merge([old, new], windows).select(*new.columns)
    merged = stored(_bucketed(merged, entity, buckets), "state")  # it's used for the partitions, the keys and the rows
    tables.upsert_partitions(spark, path, merged, entity, "bucket", schema=merged.schema)


def features(
    runners: DataFrame, state: DataFrame, targets: list[str], groups: list[str] = (), windows: tuple[int, ...] = WINDOWS, entity: str = "horse_id", when: str = "date", latest: str | None = "latest"
) -> DataFrame:
    """The columns of ``history_features`` out of the state of all strictly earlier days: one join on the entity. A runner
    whose entity's state holds its own day or a later one is an error."""
    sums = F.struct(*_sum_names(targets))
    of_category = F.when(F.col("kind").isNotNull(), F.struct(F.struct("kind", "category").alias("k"), sums.alias("v")))
    per_entity = state.groupBy(F.col(entity).alias("_e")).agg(
        F.max(F.when(F.col("kind").isNull(), F.struct(sums.alias("v"), "last"))).alias("_all"), F.map_from_entries(F.collect_list(of_category)).alias("_by")
    )  # an entity's categories, a few
    rows = runners.join(per_entity, runners[entity] == F.col("_e"), "left")
    ahead = F.col("_all.last")[0]["_w"] >= F.to_date(when)
    last = F.when(ahead, F.raise_error(F.lit("the state isn't of earlier days only"))).otherwise(F.col("_all.last"))
    rows = rows.withColumn("_last", F.when(F.to_date(when).isNotNull(), last))
    mean = lambda values: F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))
    of_group = lambda newest, g: F.filter(newest, lambda x: x[f"_g_{g}"] == F.col(g).cast("string"))
    some = {f"_some_{k}": F.slice("_last", 1, k) for k in windows}  # found once for all targets
    some |= {f"_some_{g}_{k}": of_group(F.slice("_last", 1, k), g) for g in groups for k in windows}
    rows = rows.withColumns(some)
    taken = lambda name, t: F.array_compact(F.col(name)[f"_t_{t}"])
    known = F.col("_last").isNotNull()
    columns = []
    for t in targets:
        for k in windows:
            columns.append(mean(taken(f"_some_{k}", t)).alias(f"{t}_{k}R"))
            columns += [mean(taken(f"_some_{g}_{k}", t)).alias(f"{t}_{g}_{k}R") for g in groups]
        whole = lambda v, t=t: F.when(known, F.try_divide(v[f"s_{t}"], v[f"n_{t}"]))
        columns.append(whole(F.col("_all.v")).alias(f"{t}_allR"))
        columns += [whole(F.col("_by")[F.struct(F.lit(g).alias("kind"), F.col(g).cast("string").alias("category"))]).alias(f"{t}_{g}_allR") for g in groups]
    if latest:
        columns.append(F.get(F.col("_last"), F.lit(0))["_w"].alias(latest))
    return rows.select(*[runners[c] for c in runners.columns], *columns)
