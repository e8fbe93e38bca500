"""A small seeded league: double round robin, two games a week at the same moment, venues of every roof, missing values."""

import random
from datetime import datetime, timedelta

from fieldmark.operators.contests import Dataset
from fieldmark.sources.tables import schema

TEAMS = ("AAA", "BBB", "CCC", "DDD")
VENUES = [("V0", "Zero", 40.0, -74.0, "America/New_York", "outdoors", 10.0), ("V1", "One", 41.8, -87.6, "America/Chicago", "outdoors", 180.0), ("V2", "Two", 39.7, -105.0, "America/Denver", "dome", 1600.0), ("V3", "Three", 34.0, -118.0, "America/Los_Angeles", "retractable", 70.0)]
ROOF = {"V0": "outdoors", "V1": "outdoors", "V2": "dome", "V3": "closed"}


def league(spark, seasons=(2012, 2013, 2014), seed=0, unplayed_last_week=False):
    """(Dataset, venues)"""
    rng = random.Random(seed)
    pairs = [(a, b) for a in range(4) for b in range(4) if a != b]
    rounds = [[(0, 1), (2, 3)], [(1, 2), (3, 0)], [(0, 2), (3, 1)], [(1, 0), (3, 2)], [(2, 1), (0, 3)], [(2, 0), (1, 3)]]
    assert sorted(p for r in rounds for p in r) == sorted(pairs)
    rows = {t: [] for t in ("games", "team_epa", "qb_games", "injuries", "snaps", "player_stats", "weather", "contracts", "players")}
    players = [(t, k) for t in range(4) for k in range(10)]
    for t, k in players:
        draft = (1, 2, 5, None, 3)[k % 5]
        rows["players"].append((f"g{t}{k}", f"p{t}{k}", "WR" if k < 4 else "RB" if k == 4 else "LB", draft, 2010 + k % 3))
        if k not in (3, 8):
            rows["contracts"].append((f"g{t}{k}", "ED" if k == 9 else "WR" if k < 4 else "RB" if k == 4 else "LB", rng.choice((0, 2010, 2012, 2013)), rng.random() / 5))
    for t in range(4):
        for q in range(2):
            rows["players"].append((f"q{t}{q}", None, "QB", (1, 4)[q], 2011 + q))
    for s in seasons:
        for week, games in enumerate(rounds, 1):
            at = datetime(s, 9, 8, 17) + timedelta(days=7 * (week - 1))
            for h, a in games:
                g = f"{s}_{week:02d}_{TEAMS[a]}_{TEAMS[h]}"
                played = not (unplayed_last_week and s == seasons[-1] and week == 6)
                hs, as_ = rng.randint(0, 40), rng.randint(0, 40)
                venue = VENUES[h][0]
                coach = lambda t, s=s: f"coach{t}" + ("new" if t == 1 and s > seasons[0] else "")
                rows["games"].append((g, s, week, "REG", at, TEAMS[h], TEAMS[a], hs if played else None, as_ if played else None, hs - as_ if played else None, week == 4 and h == 1, ROOF[venue], venue, rng.choice((None, 5, 7, 14)), rng.choice((4, 7, 13)), (h < 2) == (a < 2), None if week > 4 else f"q{h}0", f"q{a}{week % 2}", coach(h), coach(a), rng.choice((None, 2.5, -3.0))))
                if ROOF[venue] == "outdoors" and week != 3:
                    for k in range(4):
                        rows["weather"].append((venue, at + timedelta(hours=k), 60 + rng.random() * 20, rng.choice((None, 8.0)), rng.random() / 10, "archive"))
                if not played:
                    continue
                for t, o in ((h, a), (a, h)):
                    p, r = rng.randint(20, 40), rng.randint(20, 30)
                    rows["team_epa"].append((g, s, TEAMS[t], TEAMS[o], rng.gauss(0, 8), p + r, rng.gauss(0, 6), p, rng.gauss(0, 4), r, rng.random() * (p + r), rng.gauss(0, 3), 10))
                    rows["qb_games"].append((g, s, TEAMS[t], f"q{t}{week % 2}", p, rng.gauss(0, 6), rng.gauss(0, 50), p - 2))
                    for k in range(10):
                        off = 0.9 if k < 5 else 0.0
                        if s >= 2013 and rng.random() < 0.9:
                            rows["snaps"].append((g, s, week, TEAMS[t], f"p{t}{k}", "WR" if k < 4 else "RB" if k == 4 else "LB", off, 0.9 - off))
                        if k < 5:
                            rows["player_stats"].append((f"g{t}{k}", g, s, week, TEAMS[t], "RB" if k == 4 else "WR", rng.randint(0, 9), rng.gauss(0, 2), rng.randint(0, 5), rng.gauss(0, 1)))
            for t in range(4):
                if rng.random() < 0.6:
                    rows["injuries"].append((s, week, TEAMS[t], f"g{t}{rng.randrange(10)}", "X", rng.choice(("Out", "Doubtful", "Questionable", None)), rng.choice(("dnp", "limited", "full", None))))
    frames = {t: spark.createDataFrame(r, schema(t)) for t, r in rows.items()}
    return Dataset(**frames), spark.createDataFrame(VENUES, schema("venues"))
