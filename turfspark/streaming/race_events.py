"""Due races as events: the conditions of ``active_races`` as timers on a state for each meeting.

Of each race come out, each once, with the instant at which it holds (``at``): ``next``, the post time of the race before
it in the meeting, where that is earlier than the announcement; ``announced``, ``minutes`` before the post time; ``off``, the
post time. A race is active at an instant that ``announced`` has reached or ``next`` lies before, and ``off`` has not reached.

Time is the watermark of ``seen``, the column of both inputs that tells when a row was seen; rows of ``clock`` do nothing
but move it on. An event fires when the watermark has passed its instant, or with the row that brings it if that comes
later. A race whose row comes again has the new post time from then on; what has fired doesn't fire again. The
races of a meeting, a few dozen, are one state, which goes a day after the last post time. Instants are kept to the millisecond.
"""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400_000


class _Meeting:
    """Post times by race, in milliseconds, and the events that have fired, as text in the state store."""

    def __init__(self, saved: str | None):
        posts, fired = json.loads(saved) if saved else ([], [])
        self.posts, self.fired = {r: p for r, p in posts}, {(r, e) for r, e in fired}

    def saved(self) -> str:
        return json.dumps([list(self.posts.items()), list(self.fired)])

    def pending(self, wait: int) -> list[tuple]:
        """(instant, race, event) of all that hasn't fired, by instant."""
        out, before = [], None
        for race, post in sorted(self.posts.items()):
            events = {"announced": post - wait, "off": post}
            if before is not None and before < post - wait:
                events["next"] = before
            out += [(at, race, e) for e, at in events.items() if (race, e) not in self.fired]
            before = post
        return sorted(out)


class _Processor(StatefulProcessor):
    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("meeting", T.StructType([T.StructField("saved", T.StringType())]))

    def _load(self) -> _Meeting:
        saved = self.state.get()
        return _Meeting(saved[0] if saved else None)

    def _fire(self, key, meeting: _Meeting, now: int) -> Iterator[pd.DataFrame]:
        """All that is due by ``now``; then one timer, for the next instant."""
        pending = meeting.pending(self.wait)
        due = [p for p in pending if p[0] <= now]
        meeting.fired |= {(race, event) for _, race, event in due}
        later = pending[len(due) :]
        self.state.update((meeting.saved(),))
        self.handle.registerTimer(max(1, later[0][0]) if later else max(meeting.posts.values()) + DAY)
        if due:
            yield pd.DataFrame({"meeting": key[0], "race": [r for _, r, _ in due], "event": [e for *_, e in due], "at": [at for at, *_ in due]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        meeting = self._load()
        arrived = sorted((r.seen, r.race, r.post) for b in rows for r in b.astype({"race": object}).itertuples(index=False))
        meeting.posts |= {race: int(post) for _, race, post in arrived}
        yield from self._fire(key, meeting, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        meeting, now = self._load(), timerValues.getCurrentWatermarkInMs()
        if not meeting.posts:
            return
        if not meeting.pending(self.wait) and now >= max(meeting.posts.values()) + DAY:
            self.state.clear()
            return
        yield from self._fire(key, meeting, now)

    def close(self) -> None:
        pass


def race_events(
    schedule: DataFrame, clock: DataFrame, minutes: int = 50, keys: tuple[str, ...] = ("date", "place_id"), race: str = "race_id", time: str = "post_time", seen: str = "seen", delay: str = "0 seconds"
) -> DataFrame:
    """The stream of (``keys``, ``race``, event, at), to be started within ``history_stream.state_store``. Races are ordered
    within a meeting by ``race``, a whole number or a text; rows without a race or a post time are left out. Rows seen
    ``delay`` or more before the newest of former triggers are dropped by Spark as late."""
    kind = schedule.schema[race].dataType
    kind = kind if isinstance(kind, T.StringType) else T.LongType()
    names = T.StructType([schedule.schema[k] for k in keys])
    rows = schedule.select(F.col(seen).cast("timestamp").alias("seen"), F.to_json(F.struct(*keys)).alias("meeting"), F.col(race).cast(kind).alias("race"), F.unix_millis(F.col(time).cast("timestamp")).alias("post"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("meeting", "string"), ("race", kind), ("post", "long"))]
    rows = rows.unionByName(clock.select(F.col(seen).cast("timestamp").alias("seen"), *none)).withWatermark("seen", delay)
    whole = F.when(F.col("seen").isNotNull(), F.col("race").isNotNull() & F.col("post").isNotNull())  # names ``seen``, so it stays behind the watermark
    out = T.StructType([T.StructField("meeting", T.StringType()), T.StructField("race", kind), T.StructField("event", T.StringType()), T.StructField("at", T.LongType())])
    fired = rows.filter(whole).groupBy("meeting").transformWithStateInPandas(_Processor(minutes * 60_000), out, "Append", "EventTime")
    fired = fired.withColumn("meeting", F.from_json("meeting", names))
    return fired.select("meeting.*", F.col("race").cast(schedule.schema[race].dataType).alias(race), "event", F.timestamp_millis("at").alias("at"))
