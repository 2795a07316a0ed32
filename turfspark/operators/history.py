"""As-of features: each runner joined to its entity's strictly earlier results.

For every target column the mean over the last n earlier rows, over those of them whose category equals the
runner's, and over all earlier rows, plain and by category; and the date of the latest. Rows of the same day
never count, also where both tables have instants: days are compared. Ties within a day are ordered by ``order``
columns, the larger the newer. A mean is a double whatever the target's type, skips nulls and NaN, and is null
without a row.

Two physical paths with equal results, of which ``auto`` takes ``fanout`` if no entity has more than ``FANOUT_ROWS`` rows
of history and all squares of these numbers add up to ``FANOUT_PAIRS`` at most, by a count of them all, and else ``linear``:

* ``linear``: runners and history of an entity meet in one shuffle, into as many partitions as both tables' rows
  ask for, and windows over them add up sums and gather the n newest rows. If an entity has more than ``HOT_ROWS`` rows
  of history, by a count of them all, history is reduced by day before the shuffle, so that such an entity costs no
  more rows than it has days (and categories), and n rows of a day.
* ``fanout``: one join on the entity with the date condition, one row number, one grouped aggregate. Its
  rows grow with the square of the rows per entity.
"""

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import parts_for

WINDOWS = (5, 9)
FANOUT_ROWS, FANOUT_PAIRS = 200, 4_000_000
HOT_ROWS = 100_000
PART_ROWS = 250_000
SPREAD = 64


def _value(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    return F.nanvl(F.col(c), F.lit(None).cast(kind)) if kind in ("double", "float") else F.col(c)


def pruned_history(history: DataFrame, runners: DataFrame, entity: str = "horse_id") -> DataFrame:
    """History rows of the entities that run."""
    return history.join(runners.select(entity).distinct(), entity, "left_semi")


def _hot_bounds(runners: DataFrame, history: DataFrame, entity: str, spread: int) -> list[tuple]:
    """(entity, bounds) of the entities that hold more than one ``spread``-th of the rows of either table, so at most twice
    ``spread`` of them; the bounds cut the entity's rows of both tables, by ``_at``, into as many periods as its share asks for."""
    share = {}
    for rows in (runners, history):
        n = rows.count()
        counts = rows.filter(F.col("_e").isNotNull()).groupBy("_e").count().filter(F.col("count") * spread > n)
        for r in counts.collect():  # fewer than ``spread``
            share[r[0]] = max(share.get(r[0], 0), r[1] / n)
    if not share:
        return []
    both = runners.select("_e", "_at").unionByName(history.select("_e", "_at")).filter(F.col("_e").isin(list(share)))
    cuts = F.percentile_approx("_at", [k / spread for k in range(1, spread)], 100 * spread)
    out = []
    for e, grid in both.groupBy("_e").agg(cuts).collect():  # a row for each of these entities
        periods = ceil(share[e] * spread)
        if grid:
            out.append((e, sorted({grid[min(len(grid) - 1, k * spread // periods - 1)] for k in range(1, periods)})))
    return out


def _spread_sides(runners: DataFrame, history: DataFrame, entity: str, spread: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_i`` and ``_j``, the period of the runner and of the history row. Rows of a hot entity come once for
    each period of the other side that they can meet: a runner for all up to its own, a history row for all from its own on."""
    bounds = _hot_bounds(runners, history, entity, spread)
    if not bounds:
        return tuple(rows.drop("_at").withColumns({"_i": F.lit(0), "_j": F.lit(0)}) for rows in (runners, history))
    spark = runners.sparkSession
    key = history.schema["_e"]
    table = F.broadcast(spark.createDataFrame(bounds, T.StructType([T.StructField("_hot", key.dataType), T.StructField("_bounds", T.ArrayType(T.LongType()))])))
    out = []
    for rows in (runners, history):
        rows = rows.join(table, F.col("_e") == F.col("_hot"), "left")
        period = F.coalesce(F.size(F.filter("_bounds", lambda b: b <= F.col("_at"))), F.lit(0))
        last = F.coalesce(F.array_size("_bounds"), F.lit(0))
        out.append(rows.withColumns({"_own": F.greatest(period, F.lit(0)), "_end": last}).drop("_hot", "_bounds", "_at"))
    r = out[0].withColumn("_i", F.col("_own")).withColumn("_j", F.explode(F.sequence(F.lit(0), "_own")))
    h = out[1].withColumn("_j", F.col("_own")).withColumn("_i", F.explode(F.sequence("_own", "_end")))
    return r.drop("_own", "_end"), h.drop("_own", "_end")


def asof_history(
    runners: DataFrame, history: DataFrame, carried: list[str], entity: str = "horse_id", when: str = "date", prefix: str = "h_", spread: int = SPREAD
) -> DataFrame:
    """Every runner with each history row of its entity of an earlier day: when it was, and the carried columns. Rows
    without an entity or a day have no pair.

    An entity with more than one ``spread``-th of the rows of a table is joined by periods: its rows of both tables are cut into
    periods of like numbers of rows, and every two periods of which one isn't later than the other meet in a join key of their
    own. Rows of one day may lie in several periods, by a hash of their columns; rows that are alike in all columns stay together."""
    day = lambda c: F.unix_date(F.to_date(c)).cast("long") * (1 << 20)
    fine = lambda df: F.pmod(F.xxhash64(*[F.col(c) for c, kind in df.dtypes if "map<" not in kind]), F.lit(1 << 20))
    h = history.select(F.col(entity).alias("_e"), *[F.col(c).alias(prefix + c) for c in dict.fromkeys([when, *carried])])
    h = h.withColumn("_at", day(F.col(prefix + when)) + fine(h)).withColumnsRenamed({prefix + c: f"_h_{c}" for c in (when, *carried)})
    kind = h.schema["_e"].dataType
    r = runners.withColumns({"_e": F.col(entity).cast(kind), "_at": day(F.col(when)) + fine(runners)})
    r, h = _spread_sides(r, h, entity, spread)
    h = h.withColumnsRenamed({"_e": "_he", "_i": "_hi", "_j": "_hj"})
    same = (F.col("_e") == F.col("_he")) & (F.col("_i") == F.col("_hi")) & (F.col("_j") == F.col("_hj"))
    joined = r.join(h, same & (F.to_date(f"_h_{when}") < F.to_date(when)))
    return joined.drop("_e", "_i", "_j", "_he", "_hi", "_hj").withColumnsRenamed({f"_h_{c}": prefix + c for c in (when, *carried)})


def recent_rank(partition: list[str], when: Column, order: list[Column]) -> Column:
    """1 for the newest row of a partition."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy(F.desc(when), *[F.desc(c) for c in order]))


def lastn_history(history: DataFrame, n: int, entity: str = "horse_id", when: str = "date", order: tuple[str, ...] = ("R",)) -> DataFrame:
    """The n newest rows of each entity."""
    ranked = history.withColumn("_rn", recent_rank([entity], F.col(when), [F.col(c) for c in order]))
    return ranked.filter(F.col("_rn") <= n).drop("_rn")


def history_features(
    runners: DataFrame, history: DataFrame, targets: list[str], groups: list[str] = (), windows: tuple[int, ...] = WINDOWS, entity: str = "horse_id",
    when: str = "date", order: tuple[str, ...] = ("R",), latest: str | None = "latest", path: str = "auto", part_rows: int = PART_ROWS,
) -> DataFrame:
    """Runners with ``{target}_{n}R``, ``{target}_allR``, ``{target}_{group}_{n}R``, ``{target}_{group}_allR``
    and the latest earlier date. ``groups`` are columns of both tables."""
    groups = list(groups)
    history = history.withColumn(when, F.to_date(when))
    known = history.filter(F.col(when).isNotNull() & F.col(entity).isNotNull()).groupBy(entity).count()
    most, rows, pairs = (x or 0 for x in known.agg(F.max("count"), F.sum("count"), F.sum(F.col("count") * F.col("count"))).first())  # three numbers
    if path == "linear" or path == "auto" and (most > FANOUT_ROWS or pairs > FANOUT_PAIRS):
        return _linear(runners, history, list(targets), groups, windows, entity, when, list(order), latest, most, rows, part_rows)
    keys = runners.select(entity, F.to_date(when).alias(when), *groups).filter(F.col(when).isNotNull() & F.col(entity).isNotNull()).distinct()
    features = _fanout(keys, history, list(targets), groups, windows, entity, when, list(order), latest)
    return _attached(runners, features, [entity, when], groups, {when: F.to_date(when)})


def _attached(rows: DataFrame, found: DataFrame, keys: list[str], groups: list[str], of: dict[str, Column] | None = None) -> DataFrame:
    """Left join on the keys (of ``rows`` by the expression in ``of``, if any), null-safe on the groups; the key
    columns stay once."""
    right = found.withColumnsRenamed({c: f"_k_{c}" for c in (*keys, *groups)})
    condition = F.lit(True)
    for c in keys:
        condition = condition & ((of or {}).get(c, F.col(c)) == F.col(f"_k_{c}"))
    for c in groups:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return rows.join(right, condition, "left").drop(*[f"_k_{c}" for c in (*keys, *groups)])


def _fanout(keys, history, targets, groups, windows, entity, when, order, latest) -> DataFrame:
    values = {f"_t_{c}": _value(history, c).cast("double") for c in targets} | {f"_g_{c}": F.col(c) for c in groups} | {f"_o_{c}": F.col(c) for c in order}
    h = pruned_history(history, keys, entity).select(F.col(entity).alias("_e"), F.col(when).alias("_w"), *[v.alias(n) for n, v in values.items()])
    joined = keys.join(h, (F.col(entity) == F.col("_e")) & (F.col("_w") < F.col(when)))
    joined = joined.withColumn("_rn", recent_rank([entity, when, *groups], F.col("_w"), [F.col(f"_o_{c}") for c in order]))
    out = []
    for t in targets:
        v = F.col(f"_t_{t}")
        for n in windows:
            out.append(F.avg(F.when(F.col("_rn") <= n, v)).alias(f"{t}_{n}R"))
            out += [F.avg(F.when((F.col("_rn") <= n) & (F.col(f"_g_{g}") == F.col(g)), v)).alias(f"{t}_{g}_{n}R") for g in groups]
        out.append(F.avg(v).alias(f"{t}_allR"))
        out += [F.avg(F.when(F.col(f"_g_{g}") == F.col(g), v)).alias(f"{t}_{g}_allR") for g in groups]
    if latest:
        out.append(F.max("_w").alias(latest))
    return joined.groupBy(entity, when, *groups).agg(*out)


def _taken(rows: Column, target: str) -> Column:
    return F.array_compact(F.transform(rows, lambda x: x[f"_t_{target}"]))


def _of_group(rows: Column, group: str) -> Column:
    return F.filter(rows, lambda x: x[f"_g_{group}"] == F.col(f"_g_{group}"))


def _events(h: DataFrame, targets: list[str], groups: list[str], n: int, hot: bool) -> DataFrame:
    """What counts of history: sums and counts of the targets, and the rows that may be among the newest ``n`` (``_entry``).
    With a hot entity both are reduced by day before they're shuffled: to a row for each day and category, and ``n`` rows."""
    entry = F.struct(*[c for c in h.columns if c not in ("_e", "_w")])
    by, one = ["_e", "_w", *[f"_g_{g}" for g in groups]], {f"_n_{t}": F.col(f"_t_{t}").isNotNull().cast("long") for t in targets}
    if not hot:
        return h.select(*by, *[F.col(f"_t_{t}").alias(f"_s_{t}") for t in targets], *[c.alias(k) for k, c in one.items()], entry.alias("_entry"))
    sums = h.groupBy(*by).agg(*[F.sum(f"_t_{t}").alias(f"_s_{t}") for t in targets], *[F.count(f"_t_{t}").alias(f"_n_{t}") for t in targets])
    sums = sums.withColumn("_entry", F.lit(None).cast(h.select(entry.alias("x")).schema["x"].dataType))
    if not n:
        return sums
    rank = F.row_number().over(Window.partitionBy("_e", "_w").orderBy(*[F.desc(c) for c in h.columns if c.startswith("_o_")]))
    newest = h.withColumn("_rn", rank).filter(F.col("_rn") <= n)
    none = [F.lit(None).cast(sums.schema[c].dataType).alias(c) for c in sums.columns if c[:3] in ("_s_", "_n_")]
    return sums.unionByName(newest.select(*by, *none, entry.alias("_entry")))


def _linear(runners, history, targets, groups, windows, entity, when, order, latest, most, rows, part_rows) -> DataFrame:
    h, n = history.filter(F.col(when).isNotNull() & F.col(entity).isNotNull()), max(windows, default=0)
    asked = runners.count()
    if asked * 4 < rows:
        h = pruned_history(h, runners, entity)
    h = h.select(
        F.col(entity).alias("_e"), F.col(when).alias("_w"), *[F.col(c).alias(f"_o_{c}") for c in order], *[_value(h, t).cast("double").alias(f"_t_{t}") for t in targets],
        *[F.col(g).alias(f"_g_{g}") for g in groups],
    )
    events = _events(h, targets, groups, n, most > HOT_ROWS)
    kind = {f.name: f.dataType for f in events.schema.fields}
    # rows of no entity or no day have no features: they're spread
    known = F.col(entity).isNotNull() & F.to_date(when).isNotNull()
    spread = F.when(known, 0).otherwise(1 + F.pmod(F.xxhash64(*[F.col(c) for c, x in runners.dtypes if "map<" not in x]), F.lit(1 << 20)))
    keys = runners.select(
        F.when(known, F.col(entity)).cast(kind["_e"]).alias("_e"), F.to_date(when).alias("_w"), *[F.col(g).cast(kind[f"_g_{g}"]).alias(f"_g_{g}") for g in groups],
        *[F.lit(None).cast(kind[c]).alias(c) for c in events.columns if c[:3] in ("_s_", "_n_") or c == "_entry"],
        F.struct(*runners.columns).alias("_row"), F.lit(False).alias("_event"), spread.cast("long").alias("_spread"),
    )
    events = events.withColumns({"_row": F.lit(None).cast(keys.schema["_row"].dataType), "_event": F.lit(True), "_spread": F.lit(0).cast("long")})
    both = keys.unionByName(events).repartition(parts_for(runners, asked + rows, part_rows), "_e", "_spread")
    # a day's runners stand before its results, so what comes before a runner is of earlier days
    one = ["_e", "_spread"]
    upto = Window.partitionBy(*one).orderBy("_w", "_event", *(["_entry"] if n else [])).rowsBetween(Window.unboundedPreceding, 0)
    mean = lambda t, w: F.try_divide(F.sum(f"_s_{t}").over(w), F.sum(f"_n_{t}").over(w))
    found = {f"_all_{t}": mean(t, upto) for t in targets} | {"_latest": F.max(F.when(F.col("_event"), F.col("_w"))).over(upto)}
    both = both.withColumns(found | ({"_p": F.count("_entry").over(upto)} if n else {}))
    for g in groups:  # a null category equals none
        of = Window.partitionBy(*one, f"_g_{g}").orderBy("_w", "_event").rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumns({f"_all_{t}_{g}": F.when(F.col(f"_g_{g}").isNotNull(), mean(t, of)) for t in targets})
    if n:  # entries are numbered; a runner has the number of the last one before it
        both = both.withColumn("_last", F.reverse(F.collect_list("_entry").over(Window.partitionBy(*one).orderBy("_p").rangeBetween(1 - n, 0))))
    average = lambda values: F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))
    columns = []
    for t in targets:
        for k in windows:
            some = F.slice("_last", 1, k)
            columns.append(average(_taken(some, t)).alias(f"{t}_{k}R"))
            columns += [average(_taken(_of_group(some, g), t)).alias(f"{t}_{g}_{k}R") for g in groups]
        columns.append(F.col(f"_all_{t}").alias(f"{t}_allR"))
        columns += [F.col(f"_all_{t}_{g}").alias(f"{t}_{g}_allR") for g in groups]
    if latest:
        columns.append(F.col("_latest").alias(latest))
    return both.filter(~F.col("_event")).select(*[F.col(f"_row.`{c}`").alias(c) for c in runners.columns], *columns)
