import itertools
import random
from math import sqrt
from statistics import stdev

from pyspark.sql import functions as F

from turfspark.operators import payouts, policies, scoring, settlement

RAW = [
    ("1", "単勝", "3", "250"), ("1", "複勝", "3br7", "1,200br340"), ("1", "枠連", "2 - 4", "900"), ("1", "馬連", "3 - 8", "1,500"), ("1", "馬単", "8 → 3", "3,000"),
    ("1", "ワイド", "3 - 8br3 - 7br7 - 8", "100br200br300"), ("1", "三連複", "3 - 7 - 8", "5,000"), ("1", "三連単", "8 → 3 → 7", "20,000"), ("2", "単勝", "1", "110"), ("2", "枠連", "1 - 1", "700"),
    ("2", "ワイド", "4 - 7br", "90"), ("2", "謎", "1", "1"),
]


def test_parse(spark):
    got = payouts.parse_payouts(spark.createDataFrame(RAW, "race_id string, kind string, win string, payout string"))
    rows = sorted((r.race_id, r.ticket_type, r.seq, tuple(r.win), r.payout) for r in got.collect())
    assert ("1", "fukusho", 0, (3,), 1200) in rows and ("1", "fukusho", 1, (7,), 340) in rows and ("1", "sanrentan", 0, (8, 3, 7), 20000) in rows
    assert ("2", "wide", 0, (4, 7), 90) in rows and len(rows) == 14
    n = {r.ticket_type: r.winners for r in payouts.max_winners(spark.createDataFrame(RAW, "race_id string, kind string, win string, payout string")).collect()}
    assert n["wide"] == 3 and n["fukusho"] == 2 and n["umatan"] == 1 and len(n) == 8


def brute_settle(ticket, picks, wins):
    if ticket in ("tansho", "fukusho"):
        bets = [(p,) for p in picks]
    elif ticket == "wakuren":
        bets = list(itertools.combinations_with_replacement(sorted(set(picks)), 2))
    elif ticket in ("umaren", "wide"):
        bets = list(itertools.combinations(sorted(picks), 2))
    elif ticket == "umatan":
        bets = list(itertools.permutations(picks, 2))
    elif ticket == "sanrenpuku":
        bets = list(itertools.combinations(sorted(picks), 3))
    else:
        bets = list(itertools.permutations(picks, 3))
    ordered = ticket in ("umatan", "sanrentan")
    return len(bets), sum(p for w, p in wins for b in bets if (tuple(w) if ordered else tuple(sorted(w))) == b)


def data(seed=4, n_races=40):
    rnd = random.Random(seed)
    scores, wins = [], {}
    for race in range(n_races):
        k = rnd.randrange(1, 9)
        numbers = rnd.sample(range(1, 19), k)
        frames = {u: (u + 1) // 2 if rnd.random() < 0.7 else u for u in numbers}
        flag = int(len(set(numbers)) > len(set(frames.values())))
        scores += [(str(race), u, frames[u], rnd.choice([None, 0.4, 0.6, 1.1, 2.0, 3.0]), flag) for u in numbers]
        if race % 7 == 0:
            continue
        for t, size in {"tansho": 1, "fukusho": 1, "wakuren": 2, "umaren": 2, "wide": 2, "umatan": 2, "sanrenpuku": 3, "sanrentan": 3}.items():
            pool = list(frames.values()) if t == "wakuren" else numbers
            for _ in range(rnd.choice([1, 2])):
                if len(pool) >= size:
                    w = tuple(rnd.sample(pool, size))
                    w = w if t in ("umatan", "sanrentan") else tuple(sorted(w))
                    if w not in [x for x, _ in wins.get((str(race), t), [])]:
                        wins.setdefault((str(race), t), []).append((w, rnd.randrange(100, 9000)))
    return scores, wins


def tables(spark, scores, wins):
    s = spark.createDataFrame(scores, "race_id string, umaban int, wakuban int, score double, wakuban_flag int")
    p = spark.createDataFrame([(r, t, i, list(w), v) for (r, t), x in wins.items() for i, (w, v) in enumerate(x)], "race_id string, ticket_type string, seq int, win array<int>, payout long")
    return s, p


def brute_picks(scores, ticket, t):
    out = {}
    for race, u, w, s, flag in scores:
        if s is not None and s >= t and (ticket != "wakuren" or flag):
            out.setdefault(race, []).append(w if ticket == "wakuren" else u)
    return {r: sorted(p) for r, p in out.items() if len(p) >= policies.LEAST[ticket]}


def test_sweep_and_settlement_match_brute_force(spark):
    scores, wins = data()
    s, p = tables(spark, scores, wins)
    grid = [0.5, 1.0, 2.5, 9.0]
    want = {}
    for t in grid:
        for ticket in policies.LEAST:
            races = [brute_settle(ticket, picks, wins.get((r, ticket), [])) for r, picks in brute_picks(scores, ticket, t).items()]
            if races:
                total, back = 100 * sum(n for n, _ in races), [b for _, b in races]
                std = stdev(back) * sqrt(len(back)) / total if len(back) > 1 else None
                want[t, ticket] = (sum(n for n, _ in races), len(races), sum(b > 0 for b in back), total, round(sum(back) / total, 9), std and round(std, 9))
    got = {(r.threshold, r.ticket_type): (r.n_bets, r.n_races, r.n_hits, r.total_bet_amount, round(r.return_rate, 9), r["std"] and round(r["std"], 9)) for r in settlement.threshold_sweep(s, p, grid).collect()}
    assert got == want
    for ticket, policy in {"wakuren": policies.policy_wakuren_box, "wide": policies.policy_wide_box, "sanrentan": policies.policy_sanrentan_box}.items():
        rows = settlement.settle(policy(s, 0.5), p).collect()
        assert {r.race_id: (r.picks, r.n_bets, r.return_amount) for r in rows} == {
            r: (picks, *map(lambda x: x, brute_settle(ticket, picks, wins.get((r, ticket), [])))) for r, picks in brute_picks(scores, ticket, 0.5).items()
        }


def test_straight_and_axis(spark):
    scores, wins = data(9)
    s, p = tables(spark, scores, wins)
    want = {}
    for r in {x[0] for x in scores}:
        mine = {u: v for q, u, _, v, _ in scores if q == r and v is not None}
        for a, b in itertools.permutations(mine, 2):
            if mine[a] >= 1.0 and mine[b] >= 0.5:
                want[r, a, b] = sum(v for w, v in wins.get((r, "umatan"), []) if w == (a, b))
    got = settlement.settle_straight(policies.policy_axis_partner(s, 1.0, 0.5), p)
    assert {(r.race_id, *r.picks): r.return_amount for r in got.collect()} == want
    sweep = settlement.axis_sweep(s, p, [(1.0, 0.5)]).first()
    assert sweep.n_bets == len(want) and sweep.n_hits == len({k[0] for k, v in want.items() if v})


def test_scores(spark):
    df = spark.createDataFrame([("a", 1, 1, 2.0), ("a", 2, 1, 4.0), ("b", 1, 1, 3.0), ("b", 2, 2, 3.0), ("c", 1, 1, 0.0)], "race_id string, umaban int, wakuban int, score double")
    assert {(r.race_id, r.umaban): (r.score, r.wakuban_flag) for r in scoring.score_std(df).collect()} == {("a", 1): (-1, 1), ("a", 2): (1, 1), ("b", 1): (None, 0), ("b", 2): (None, 0), ("c", 1): (None, 0)}
    assert [r.score for r in scoring.score_minmax(df).filter("race_id = 'a'").orderBy("umaban").collect()] == [0, 1]
    assert [r.score for r in scoring.score_relative(df).filter("race_id <> 'b'").orderBy("race_id", "umaban").collect()] == [2 / 6, 4 / 6, None]
    rows = spark.createDataFrame([(s, y, f) for s, y, f in [(0.1, 0, "x"), (0.5, 1, "x"), (0.5, 0, "x"), (0.9, 1, "x"), (0.3, 1, "y")]], "score double, label int, fold string")
    assert scoring.auc(rows.filter("fold = 'x'")).first().auc == 3.5 / 4
    assert {r.fold: r.auc for r in scoring.auc(rows, by="fold").collect()} == {"x": 3.5 / 4, "y": None}
    assert policies.threshold_grid(0.5, 3.5, 3) == [0.5, 1.5, 2.5] and len(policies.threshold_grid_2d(1, 2, 2, 0, 3)) == 6
    assert scoring.top_runners(df, 1).filter("race_id = 'b'").select(F.first("umaban")).first()[0] == 1


def test_two_thresholds_equal_brute_force(spark):
    """Also dead heats, equal scores, winners without a score, races without payouts, and a grid that isn't a product."""
    rnd = random.Random(6)
    levels = [0.0, 0.5, 1.0, 1.5, 2.0, None]
    runners = {r: {u: rnd.choice(levels) for u in range(1, rnd.randint(1, 6) + 1)} for r in range(40)}
    paid = {r: [((rnd.randint(1, 6), rnd.randint(1, 6)), rnd.choice([150, 2300, 0])) for _ in range(rnd.choice([0, 1, 1, 2]))] for r in runners}
    paid = {r: [w for w in v if w[0][0] != w[0][1]] for r, v in paid.items()}
    grid = [(a, b) for a in (0.25, 0.5, 1.2, 2.0, 9.0) for b in (-1.0, 0.5, 1.5)][:-2]
    scores = spark.createDataFrame([(r, u, s) for r, x in runners.items() for u, s in x.items()], "race_id int, umaban int, score double")
    payouts = spark.createDataFrame([(r, "umatan", list(w), p) for r, v in paid.items() for w, p in v] + [(0, "tansho", [1], 9)], "race_id int, ticket_type string, win array<int>, payout long")
    got = {(x.t1, x.t2): x for x in settlement.axis_sweep(scores, payouts, grid).collect()}
    for t1, t2 in grid:
        bets, backs = [], []
        for r, x in runners.items():
            pairs = {(a, b) for a, s in x.items() for b, z in x.items() if a != b and s is not None and z is not None and s >= t1 and z >= t2}
            if pairs:
                bets.append(len(pairs))
                backs.append(float(sum(p for w, p in paid[r] if w in pairs)))
        if not bets:
            assert (t1, t2) not in got
            continue
        x = got.pop((t1, t2))
        assert (x.n_bets, x.n_races, x.n_hits, x.total_bet_amount) == (sum(bets), len(bets), sum(b > 0 for b in backs), 100 * sum(bets))
        assert abs(x.return_rate - sum(backs) / (100 * sum(bets))) < 1e-9
        if len(backs) > 1:
            assert abs(x["std"] - stdev(backs) * len(backs) ** 0.5 / (100 * sum(bets))) < 1e-9
    assert not got


def test_scores_that_differ_by_rounding_have_no_deviation(spark):
    ulp = 31.916666666666668, 31.91666666666667
    rows = [(1, u, 1, s) for u, s in enumerate(ulp)] + [(2, u, 1, s) for u, s in enumerate((0.1 + 0.2, 0.3, 0.3))] + [(3, u, 1, s) for u, s in enumerate((1.0, 1.0 + 1e-9))]
    df = spark.createDataFrame(rows, "race_id int, umaban int, wakuban int, score double")
    got = {(r.race_id, r.umaban): r.score and round(r.score, 6) for r in scoring.score_std(df).collect()}
    assert got == {(1, 0): None, (1, 1): None, (2, 0): None, (2, 1): None, (2, 2): None, (3, 0): -1.0, (3, 1): 1.0}


def test_thresholds_are_reached_by_blocks(spark):
    rnd = random.Random(3)
    for n in (1, 2, 3, 10, 100):
        grid = sorted(rnd.choice([rnd.uniform(0, 4), 1.0, 2.5]) for _ in range(n))
        scores = [*grid, 0.999, 1.0, 2.5, -1.0, 9.0]
        rows = spark.createDataFrame([(s,) for s in scores], "s double").select("s", settlement.reached(grid, F.col("s")).alias("n"))
        assert [(r.s, r.n) for r in rows.collect()] == [(s, sum(t <= s for t in grid)) for s in scores]
