"""Bet policies: functions from a score table to picks (race_id, ticket_type, picks)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: least number of picks of a ticket type
LEAST = {"tansho": 1, "fukusho": 1, "wakuren": 2, "umaren": 2, "umatan": 2, "wide": 2, "sanrenpuku": 3, "sanrentan": 3}


def threshold_grid(low: float = 0.5, high: float = 3.5, n: int = 100) -> list[float]:
    """``n`` evenly spaced thresholds from ``low``, ``high`` itself not among them."""
    return [high * i / n + low * (1 - i / n) for i in range(n)]


def thresholds_of(scores: DataFrame, n: int = 100, score: str = "score") -> DataFrame:
    """(i, threshold): ``n`` evenly spaced thresholds from the least score on, the greatest not among them; none without
    a score."""
    ends = scores.agg(F.min(score).cast("double").alias("low"), F.max(score).cast("double").alias("high")).filter("low is not null")
    i = F.col("i")
    return ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select("i", (F.col("high") * i / n + F.col("low") * (1 - i / n)).alias("threshold"))


def threshold_grid_2d(low: float, high: float, n: int, low2: float, n2: int) -> list[tuple[float, float]]:
    """Pairs (t1, t2): for each t1, ``n2`` thresholds from ``low2`` up to it."""
    return [(t1, t1 * j / n2 + low2 * (1 - j / n2)) for t1 in threshold_grid(low, high, n) for j in range(n2)]


def threshold_pick(scores: DataFrame, thresholds: list[float], score: str = "score") -> DataFrame:
    """A row for each runner and threshold that its score reaches; only those pairs are made."""
    grid = F.array(*map(F.lit, thresholds))
    return scores.select("*", F.explode(F.filter(grid, lambda t: t <= F.col(score))).alias("threshold"))


def picks_per_race(picked: DataFrame, ticket: str, keys: tuple[str, ...] = ("race_id",), number: str = "umaban") -> DataFrame:
    """Sorted picks of each race with at least as many as the ticket type needs."""
    picks = picked.groupBy(*keys).agg(F.array_sort(F.collect_list(number)).alias("picks"))  # runners of a race
    return picks.filter(F.size("picks") >= LEAST[ticket]).withColumn("ticket_type", F.lit(ticket))


def _policy(ticket: str):
    def policy(scores: DataFrame, threshold: float, score: str = "score") -> DataFrame:
        picked = scores.filter(F.col(score) >= threshold)
        if ticket == "wakuren":
            return picks_per_race(picked.filter("wakuban_flag = 1"), ticket, number="wakuban")
        return picks_per_race(picked, ticket)

    policy.__name__ = policy.__qualname__ = f"policy_{ticket}"
    policy.__doc__ = f"Runners (for wakuren their frames, in races where frames are shared) that reach the threshold, as {ticket} picks."
    return policy


policy_tansho, policy_fukusho, policy_wakuren_box, policy_umaren_box, policy_umatan_box, policy_wide_box, policy_sanrenpuku_box, policy_sanrentan_box = map(_policy, LEAST)


def policy_axis_partner(scores: DataFrame, axis: float, partner: float, score: str = "score", race: str = "race_id") -> DataFrame:
    """Ordered pairs axis -> partner: runners that reach the upper threshold against those that reach the
    lower one, within the race."""
    reached = scores.filter(F.col(score) >= partner)
    both = reached.groupBy(race).agg(F.array_sort(F.collect_list(F.struct("umaban", F.col(score).alias("s")))).alias("r"))
    first = F.filter("r", lambda x: x["s"] >= axis)
    pairs = F.flatten(F.transform(first, lambda a: F.transform(F.filter("r", lambda b: b["umaban"] != a["umaban"]), lambda b: F.array(a["umaban"], b["umaban"]))))
    return both.select(race, F.lit("umatan").alias("ticket_type"), F.explode(pairs).alias("picks"))


def picks_from(runners: Column, threshold: Column, ticket: str) -> Column:
    """Picks of one ticket type out of a race's array of (umaban, wakuban, score)."""
    number = "wakuban" if ticket == "wakuren" else "umaban"
    return F.transform(F.filter(runners, lambda r: r["score"] >= threshold), lambda r: r[number])
