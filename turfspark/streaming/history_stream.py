"""History features of race cards while results arrive: two streams and one state for each entity.

The state has the sums, counts and newest rows of all days before the entity's newest day with results, and the rows of
that day, which don't count for runners of the same day. Within a trigger an entity's rows are taken by day, runners before
results; so a runner gets the features of all strictly earlier days that have arrived with or before it, as the batch
query over what has arrived gives them. A runner or result of a day before the newest one closed can't be placed any
more: the runner comes out with ``late`` set and no features, the result is left out.
"""

import json
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.history import WINDOWS

BUCKETS, OUT_ROWS = 4096, 10_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession):
    """Streams started within keep their state in RocksDB, as this one must; the session's setting comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def feature_names(targets: list[str], groups: list[str] = (), windows: tuple[int, ...] = WINDOWS) -> list[str]:
    """In the order of ``history_features``."""
    spans = [*(f"{n}R" for n in windows), "allR"]
    return [f"{t}_{g}{s}" for t in targets for s in spans for g in ("", *(f"{g}_" for g in groups))]


class _State:
    """Of one entity, as text in the state store: a day's rows are lists of order values, group values and target values."""

    def __init__(self, saved: str | None, keep: int):
        self.keep = keep
        self.closed, self.day, self.open, self.newest, self.sums = json.loads(saved) if saved else (None, None, [], [], {})

    def saved(self) -> str:
        return json.dumps([self.closed, self.day, self.open, self.newest, self.sums])

    def close(self, day: str) -> None:
        """Rows of the open day count from now on, for runners of a later day."""
        if self.day is None or self.day >= day:
            return
        for order, groups, values in self.open:
            for key in ("", *(f"{i}={g}" for i, g in enumerate(groups) if g is not None)):
                sums = self.sums.setdefault(key, [[0.0, 0] for _ in values])
                for s, v in zip(sums, values, strict=True):
                    if v is not None:
                        s[0], s[1] = s[0] + v, s[1] + 1
        newer = sorted(self.open, key=lambda r: [(x is not None, x) for x in r[0]], reverse=True)
        self.newest = ([[self.day, *r] for r in newer] + self.newest)[: self.keep]
        self.closed, self.day, self.open = self.day, None, []

    def add(self, day: str, order: list, groups: list, values: list) -> None:
        self.close(day)
        if self.day in (None, day) and (self.closed is None or day > self.closed):
            self.day = day
            self.open.append([order, groups, values])

    def features(self, day: str, groups: list, n_targets: int, windows: tuple[int, ...]) -> tuple[list, str | None, bool]:
        """(features, latest day, late) for a runner."""
        self.close(day)
        if self.closed is not None and day <= self.closed:
            return [], None, True
        mean = lambda v: sum(v) / len(v) if v else None
        # which of the newest rows have the runner's category
        alike = [(i, g, [g is not None and r[2][i] == g for r in self.newest]) for i, g in enumerate(groups)]
        out = []
        for t in range(n_targets):
            values = [r[3][t] for r in self.newest]
            for n in windows:
                out.append(mean([v for v in values[:n] if v is not None]))
                for _, _, same in alike:
                    out.append(mean([v for v, ok in zip(values[:n], same, strict=False) if ok and v is not None]))
            for key in ("", *(f"{i}={g}" if g is not None else None for i, g, _ in alike)):
                s, k = self.sums.get(key, [[0.0, 0]] * n_targets)[t] if key is not None else (0.0, 0)
                out.append(s / k if k else None)
        return out, self.newest[0][0] if self.newest else None, False


@lru_cache(4096)
def _categories(text: str) -> list:
    return json.loads(text)


class _Processor(StatefulProcessor):
    """Of a bucket of entities, with a state for each: what a call costs besides its rows is paid by bucket."""

    def __init__(self, names: list[str], n_targets: int, windows: tuple[int, ...]):
        self.names, self.n_targets, self.windows = names, n_targets, windows

    def init(self, handle: StatefulProcessorHandle) -> None:
        texts = lambda *names: T.StructType([T.StructField(n, T.StringType()) for n in names])
        self.states = handle.getMapState("history", texts("entity"), texts("saved"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues=None) -> Iterator[pd.DataFrame]:
        # the rows of a bucket's entities of one trigger: by entity and day, runners before results
        arrived = [r for b in rows for r in zip(*(b[c] for c in ("entity", "day", "is_result", "groups", "card", "ordering", "values")), strict=True)]
        arrived.sort(key=itemgetter(0, 1, 2))
        out = []
        for entity, of_entity in groupby(arrived, itemgetter(0)):
            saved = self.states.getValue((entity,))
            state = _State(saved[0] if saved else None, max(self.windows, default=1))
            for _, day, is_result, groups, card, ordering, values in of_entity:
                if is_result:
                    state.add(day, json.loads(ordering), _categories(groups), json.loads(values))
                else:
                    found, latest, late = state.features(day, _categories(groups), self.n_targets, self.windows)
                    out.append([card, *(found or [None] * len(self.names)), latest, late])
            self.states.updateValue((entity,), (state.saved(),))
            if len(out) >= OUT_ROWS:
                yield self._frame(out)
                out = []
        if out:
            yield self._frame(out)

    def _frame(self, out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["card", *self.names, "latest", "late"]).astype({n: "float64" for n in self.names})

    def close(self) -> None:
        pass


def history_feature_stream(
    cards: DataFrame, results: DataFrame, targets: list[str], groups: list[str] = (), windows: tuple[int, ...] = WINDOWS, entity: str = "horse_id", when: str = "date", order: tuple[str, ...] = ("R",), buckets: int = BUCKETS
) -> DataFrame:
    """Streaming rows of ``cards`` with the columns of ``history_features``, and ``late``. Cards without an entity or a day
    have no features. Both streams keep to the same order of days for an exact result; see above. A checkpoint keeps its number of ``buckets``."""
    groups, names = list(groups), feature_names(targets, groups, windows)
    text = lambda columns: F.to_json(F.array(*columns)) if columns else F.lit("[]")
    values = [F.nanvl(F.col(t).cast("double"), F.lit(None).cast("double")) for t in targets]
    common = [F.coalesce(F.col(entity).cast("string"), F.lit("")).alias("entity"), F.coalesce(F.to_date(when).cast("string"), F.lit("")).alias("day"), text([F.col(g).cast("string") for g in groups]).alias("groups")]
    empty = F.lit(None).cast("string")
    arriving = cards.select(*common, F.lit(False).alias("is_result"), F.to_json(F.struct(*[F.col(c) for c in cards.columns])).alias("card"), empty.alias("ordering"), empty.alias("values"))
    known = results.filter(F.col(entity).isNotNull() & F.to_date(when).isNotNull())
    known = known.select(*common, F.lit(True).alias("is_result"), empty.alias("card"), text([F.col(c) for c in order]).alias("ordering"), text(values).alias("values"))
    both = arriving.filter("entity <> '' and day <> ''").unionByName(known)
    schema = "card string, " + ", ".join(f"`{n}` double" for n in names) + ", latest string, late boolean"
    both = both.withColumn("bucket", F.pmod(F.xxhash64("entity"), F.lit(buckets)).cast("int"))
    found = both.groupBy("bucket").transformWithStateInPandas(_Processor(names, len(targets), tuple(windows)), schema, "Append", "None")
    nothing = arriving.filter("entity = '' or day = ''").select("card", *[F.lit(None).cast("double").alias(n) for n in names], empty.alias("latest"), F.lit(False).alias("late"))
    rows = found.unionByName(nothing).withColumn("card", F.from_json("card", cards.schema))
    return rows.select("card.*", *names, F.col("latest").cast("date").alias("latest"), "late")
