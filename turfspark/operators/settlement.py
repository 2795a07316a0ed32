"""Settlement of picks against payouts. Combinations are counted in closed form; only the few winning
combinations are tested against the picks."""

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .policies import LEAST, picks_from, threshold_grid


def n_tickets(ticket: Column, picks: Column) -> Column:
    """Number of tickets bought: singles, boxes, or for frames every unordered pair with repetition."""
    k, d = F.size(picks).cast("long"), F.size(F.array_distinct(picks)).cast("long")
    return (
        F.when(ticket.isin("tansho", "fukusho"), k)
        .when(ticket == "wakuren", (d * (d + 1) / 2).cast("long"))
        .when(ticket.isin("umaren", "wide"), (k * (k - 1) / 2).cast("long"))
        .when(ticket == "umatan", k * (k - 1))
        .when(ticket == "sanrenpuku", (k * (k - 1) * (k - 2) / 6).cast("long"))
        .when(ticket == "sanrentan", k * (k - 1) * (k - 2))
    )


def covers(picks: Column, win: Column) -> Column:
    """Whether the picks' singles or box hold a winning combination; a box covers every order."""
    return F.forall(win, lambda w: F.array_contains(picks, w))


def settle_join(picks: DataFrame, payouts: DataFrame, keys: tuple[str, ...] = ("race_id", "ticket_type")) -> DataFrame:
    """Picks with their race's winners as an array (won array<win, payout>), empty where there are none."""
    wins = payouts.groupBy(*keys).agg(F.collect_list(F.struct("win", "payout")).alias("won"))  # winners of one race
    out = picks.join(wins, list(keys), "left")
    return out.withColumn("won", F.coalesce("won", F.array().cast(wins.schema["won"].dataType)))


def returned(won: Column, hit) -> Column:
    return F.aggregate(F.filter(won, lambda w: hit(w["win"])), F.lit(0).cast("long"), lambda total, w: total + F.coalesce(w["payout"], F.lit(0)))


def settle(picks: DataFrame, payouts: DataFrame, amount: int = 100) -> DataFrame:
    """Adds n_bets, bet_amount, return_amount and hit of singles and boxes; a race without payouts returns 0."""
    n = n_tickets(F.col("ticket_type"), F.col("picks"))
    back = returned(F.col("won"), lambda win: covers(F.col("picks"), win)) * amount / 100
    out = settle_join(picks, payouts).withColumns({"n_bets": n, "bet_amount": n * amount, "return_amount": back.cast("double")})
    return out.withColumn("hit", (F.col("return_amount") > 0).cast("int")).drop("won")


def settle_straight(picks: DataFrame, payouts: DataFrame, amount: int = 100) -> DataFrame:
    """One ordered ticket a row: it pays if it equals the winning order."""
    back = returned(F.col("won"), lambda win: F.col("picks") == win) * amount / 100
    out = settle_join(picks, payouts).withColumns({"n_bets": F.lit(1).cast("long"), "bet_amount": F.lit(amount).cast("long"), "return_amount": back.cast("double")})
    return out.withColumn("hit", (F.col("return_amount") > 0).cast("int")).drop("won")


def race_returns(settled: DataFrame, keys: tuple[str, ...] = ("race_id",)) -> DataFrame:
    return settled.groupBy(*keys).agg(
        F.sum("n_bets").alias("n_bets"), F.sum("bet_amount").alias("bet_amount"), F.sum("return_amount").alias("return_amount"), F.max("hit").alias("hit_or_not")
    )


def portfolio_returns(races: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Return rate with its deviation over races: sample std of a race's return times root n over the total."""
    out = races.groupBy(*keys).agg(
        F.coalesce(F.sum("n_bets"), F.lit(0)).alias("n_bets"), F.count("*").alias("n_races"), F.coalesce(F.sum("hit_or_not"), F.lit(0)).alias("n_hits"),
        F.coalesce(F.sum("bet_amount"), F.lit(0)).alias("total_bet_amount"), F.sum("return_amount").alias("_back"), F.stddev_samp("return_amount").alias("_std"),
    )
    total = F.col("total_bet_amount")
    rate = F.when(total == 0, 0.0).otherwise(F.try_divide(F.col("_back"), total))
    std = F.when(total == 0, 0.0).otherwise(F.try_divide(F.col("_std") * F.sqrt("n_races"), total))
    return out.withColumns({"return_rate": rate, "std": std}).drop("_back", "_std")


def return_band(portfolio: DataFrame) -> DataFrame:
    return portfolio.withColumns({"lower": F.col("return_rate") - F.col("std"), "upper": F.col("return_rate") + F.col("std")})


def reached(thresholds: list[float], score: Column) -> Column:
    """How many of the sorted thresholds a score reaches: first by blocks of them, then within the one block."""
    block = max(1, isqrt(len(thresholds)))
    count = lambda some: F.size(F.filter(some, lambda t: t <= score))
    blocks = count(F.array(*map(F.lit, thresholds[::block])))
    within = count(F.slice(F.array(*map(F.lit, thresholds)), (blocks - 1) * block + 1, F.lit(block)))
    return F.when(blocks == 0, 0).otherwise((blocks - 1) * block + within)


def threshold_sweep(scores: DataFrame, payouts: DataFrame, thresholds: list[float] | None = None, tickets: tuple[str, ...] = tuple(LEAST), amount: int = 100) -> DataFrame:
    """A portfolio row for every threshold and ticket type, in one job. A race's picks change only at its runners'
    scores: each such step is settled once, against the winners of one ticket type, and adds to a run of thresholds.
    Of a run only its two ends move, as a gain and a loss; the sums over thresholds are taken at the end, over a row for
    each threshold and ticket type. The deviation comes from sums of squares."""
    thresholds = sorted(threshold_grid() if thresholds is None else thresholds)
    n_grid = len(thresholds)
    runner = F.struct("umaban", "wakuban", F.col("score").cast("double").alias("score"))
    races = scores.filter(F.col("score").isNotNull()).groupBy("race_id").agg(F.collect_list(runner).alias("runners"), F.max("wakuban_flag").alias("flag"))
    levels = F.array_sort(F.filter(F.array_distinct(F.transform("runners", lambda r: r["score"])), lambda s: s >= min(thresholds)))
    races = races.withColumn("levels", levels).filter(F.size("levels") > 0)
    races = races.withColumn("upto", F.transform("levels", lambda s: reached(thresholds, s)))
    wins = payouts.groupBy("race_id", "ticket_type").agg(F.collect_list(F.struct("win", "payout")).alias("won"))
    wins = wins.groupBy("race_id").agg(F.map_from_entries(F.collect_list(F.struct("ticket_type", "won"))).alias("all_won"))
    none = F.array().cast(wins.schema["all_won"].dataType.valueType)
    pair = F.transform("levels", lambda s, i: F.struct(s.alias("level"), F.when(i > 0, F.get("upto", i - 1)).otherwise(0).alias("begin"), F.get("upto", i).alias("end")))
    steps = races.join(wins, "race_id", "left").select("runners", "flag", "all_won", F.explode(F.filter(pair, lambda s: s["begin"] < s["end"])).alias("s"))
    steps = steps.select("runners", "flag", "all_won", "s.*")
    picked = {f"_{c}": picks_from(F.col("runners"), F.col("level"), t) for c, t in (("umaban", "tansho"), ("wakuban", "wakuren"))}
    steps = steps.withColumns(picked).drop("runners", "level")
    settled = []
    for t in tickets:
        picks = F.col("_wakuban" if t == "wakuren" else "_umaban")
        won = F.coalesce(F.get(F.array(F.element_at("all_won", F.lit(t))), F.lit(0)), none)
        n = n_tickets(F.lit(t), picks)
        back = (returned(won, lambda win, picks=picks: covers(picks, win)) * amount / 100).cast("double")
        enough = F.size(picks) >= LEAST[t]
        settled.append(F.when(enough & (F.col("flag") == 1) if t == "wakuren" else enough, F.struct(F.lit(t).alias("ticket_type"), n.alias("n"), back.alias("back"))))
    bets = steps.select("begin", "end", F.explode(F.array_compact(F.array(*settled))).alias("b")).select("begin", "end", "b.*")
    ends = F.explode(F.array(F.struct(F.col("begin").alias("i"), F.lit(1).alias("sign")), F.struct(F.col("end").alias("i"), F.lit(-1).alias("sign"))))
    moved = bets.select("ticket_type", "n", "back", ends.alias("e")).select("ticket_type", "e.i", "e.sign", "n", "back")
    sign, values = F.col("sign"), {"n_bets": F.col("n"), "n_races": F.lit(1), "n_hits": (F.col("back") > 0).cast("int"), "_back": F.col("back"), "_squares": F.col("back") * F.col("back")}
    moved = moved.groupBy("ticket_type", "i").agg(*[F.sum(sign * v).alias(c) for c, v in values.items()])
    every = scores.sparkSession.createDataFrame([(t, i, thresholds[i]) for t in tickets for i in range(n_grid)], "ticket_type string, i int, threshold double")
    so_far = Window.partitionBy("ticket_type").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # a row for each threshold
    sums = every.join(moved, ["ticket_type", "i"], "left").select("ticket_type", "threshold", *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(c) for c in values])
    total, n = F.col("n_bets") * amount, F.col("n_races")
    variance = F.try_divide(F.col("_squares") - F.try_divide(F.col("_back") * F.col("_back"), n), n - 1)
    deviation = F.sqrt(F.when(variance < 0, 0.0).otherwise(variance))
    return sums.filter(n > 0).select(
        "threshold", "ticket_type", "n_bets", F.col("n_races").cast("long").alias("n_races"), F.col("n_hits").cast("long").alias("n_hits"), total.alias("total_bet_amount"),
        F.try_divide(F.col("_back"), total).alias("return_rate"), F.try_divide(deviation * F.sqrt(n), total).alias("std"),
    )


def axis_sweep(scores: DataFrame, payouts: DataFrame, grid: list[tuple[float, float]], amount: int = 100) -> DataFrame:
    """Two thresholds: ordered pairs of an axis and a partner, for every (t1, t2) of the grid.

    A runner is an axis at the i lowest values of t1 and a partner at the j lowest of t2, so what a pair of runners bets
    or wins counts in a rectangle of thresholds from the lowest on, of which only the far corner is kept; so do the square
    of a race's return (pairs of winners), whether it wins (the union of the winners' rectangles, as steps), and whether
    it's bet on (the union of two rectangles: the best partner with the others as axis, and the best partner as axis).
    Corners are added up over races, and thresholds come in at the end only: a two-dimensional sum over the grid."""
    firsts, seconds = sorted({a for a, _ in grid}), sorted({b for _, b in grid})
    upto = lambda values: F.size(F.filter(F.array(*map(F.lit, values)), lambda t: t <= F.col("score").cast("double")))
    rows = scores.filter(F.col("score").isNotNull()).select("race_id", "umaban", upto(firsts).alias("i"), upto(seconds).alias("j"))
    # by partner, the best one first
    races = rows.groupBy("race_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("j")).alias("_by"), "umaban", "i", "j"))).alias("runners"))
    wins = payouts.filter("ticket_type = 'umatan'").groupBy("race_id").agg(F.collect_list(F.struct("win", "payout")).alias("won"))
    place = lambda n, k: F.coalesce(F.get(F.filter("runners", lambda r: r["umaban"] == n), F.lit(0))[k], F.lit(0))
    ordered = F.filter("won", lambda w: (F.size(w["win"]) == 2) & (w["win"][0] != w["win"][1]))
    corner = F.transform(ordered, lambda w: F.struct(place(w["win"][0], "i").alias("i"), place(w["win"][1], "j").alias("j"), (w["payout"] * amount / 100).cast("double").alias("back")))
    reached = F.reverse(F.array_sort(F.filter(corner, lambda w: (w["i"] > 0) & (w["j"] > 0))))
    races = races.join(wins, "race_id", "left").select("runners", F.coalesce(reached, F.array().cast("array<struct<i:int,j:int,back:double>>")).alias("won"))

    names = ("n_bets", "n_races", "n_hits", "_back", "_squares")
    point = lambda i, j, name, value: F.struct(i.alias("i"), j.alias("j"), F.lit(names.index(name)).alias("what"), value.cast("double").alias("value"))
    one, zero = F.lit(1), F.lit(0)
    axes, partners = F.filter("runners", lambda r: r["i"] > 0), F.filter("runners", lambda r: r["j"] > 0)
    bets = F.flatten(F.transform(axes, lambda a: F.transform(partners, lambda b: point(a["i"], b["j"], "n_bets", one))))
    selves = F.transform(axes, lambda a: point(a["i"], a["j"], "n_bets", -one))
    best = lambda n, k: F.coalesce(F.get("runners", F.lit(n))[k], zero)
    others = F.coalesce(F.array_max(F.transform(F.slice("runners", 2, 1 << 30), lambda r: r["i"])), zero)
    bet_on = F.array(
        point(others, best(0, "j"), "n_races", one), point(best(0, "i"), best(1, "j"), "n_races", one), point(F.least(others, best(0, "i")), best(1, "j"), "n_races", -one)
    )
    backs = F.transform("won", lambda w: point(w["i"], w["j"], "_back", w["back"]))
    squares = F.flatten(F.transform("won", lambda v: F.transform("won", lambda w: point(F.least(v["i"], w["i"]), F.least(v["j"], w["j"]), "_squares", v["back"] * w["back"]))))
    paying = F.filter("won", lambda w: w["back"] > 0)  # the largest i first
    before = lambda n: F.coalesce(F.array_max(F.transform(F.slice(paying, 1, n), lambda x: x["j"])), zero)
    steps = F.flatten(F.transform(paying, lambda w, n: F.array(point(w["i"], F.greatest(w["j"], before(n)), "n_hits", one), point(w["i"], before(n), "n_hits", -one))))
    corners = races.select(F.explode(F.concat(bets, selves, bet_on, backs, squares, steps)).alias("p")).select("p.*").filter("i > 0 and j > 0")
    sums = corners.groupBy("i", "j").agg(*[F.sum(F.when(F.col("what") == n, F.col("value")).otherwise(0.0)).alias(c) for n, c in enumerate(names)])

    cells = [(i + 1, j + 1, a, b) for i, a in enumerate(firsts) for j, b in enumerate(seconds)]
    every = scores.sparkSession.createDataFrame(cells, "i int, j int, t1 double, t2 double").join(sums, ["i", "j"], "left")
    for along, across in (("i", "j"), ("j", "i")):  # corners beyond a cell in both directions; windows over rows of the grid
        beyond = Window.partitionBy(across).orderBy(F.desc(along)).rowsBetween(Window.unboundedPreceding, 0)
        every = every.select("i", "j", "t1", "t2", *[F.coalesce(F.sum(c).over(beyond), F.lit(0.0)).alias(c) for c in names])
    if len(set(grid)) < len(cells):
        every = every.join(scores.sparkSession.createDataFrame(sorted(set(grid)), "t1 double, t2 double"), ["t1", "t2"], "left_semi")
    total, n = (F.col("n_bets") * amount).cast("long"), F.col("n_races")
    variance = F.try_divide(F.col("_squares") - F.try_divide(F.col("_back") * F.col("_back"), n), n - 1)
    deviation = F.sqrt(F.when(variance < 0, 0.0).otherwise(variance))
    return every.filter(n > 0).select(
        "t1", "t2", *[F.col(c).cast("long").alias(c) for c in ("n_bets", "n_races", "n_hits")], total.alias("total_bet_amount"),
        F.try_divide(F.col("_back"), total).alias("return_rate"), F.try_divide(deviation * F.sqrt(n), total).alias("std"),
    )
