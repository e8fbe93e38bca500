import math
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fieldmark.functions import expressions as X
from fieldmark.operators import asof, availability, contests, fold, logs, passers, ratings, simulation, weather
from fieldmark.operators.features import FEATURE_COLUMNS, ID_COLUMNS, FeatureParams, Parts
from fieldmark.operators.report import CHANGE_THRESHOLDS, LABELS
from tests.synthetic import TEAMS, league


@pytest.fixture(scope="module")
def data(spark):
    made, venues = league(spark)
    return made, venues


def rows_of(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_stored_parts_are_never_sent_whole(spark, data):
    """Parts are joined by shuffles, however small their files: what is constant in them takes no place there."""
    plan = Parts(*data).features()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_elo_of_gaps_beyond_doubles(spark, data):
    assert fold.elo(data[0].games, fold.EloParams(k=1e9)).count() == data[0].games.count()


def test_elo_equals_a_plain_walk(spark, data):
    games = data[0].games
    got = rows_of(fold.elo(games), "game_id")
    rating, season = {}, {}
    total = 0.0
    for g in sorted(games.collect(), key=lambda g: (g.kickoff_utc, g.game_id)):
        for t in (g.home_team, g.away_team):
            if t in rating and season[t] != g.season:
                rating[t] = 1500 + (rating[t] - 1500) * (1 - 1 / 3)
            rating.setdefault(t, 1500.0)
            season[t] = g.season
        a, b = rating[g.home_team], rating[g.away_team]
        assert (got[g.game_id]["elo_home_pre"], got[g.game_id]["elo_away_pre"]) == pytest.approx((a, b))
        d = a - b + (0 if g.neutral else 48)
        e = 1 / (1 + 10 ** (-d / 400))
        y = 0.5 if g.margin == 0 else float(g.margin > 0)
        m = 1 if g.margin == 0 else math.log(abs(g.margin) + 1) * 2.2 / ((d if g.margin > 0 else -d) * 0.001 + 2.2)
        rating[g.home_team] += 20 * m * (y - e)
        rating[g.away_team] -= 20 * m * (y - e)
        total = sum(rating.values())
    assert total == pytest.approx(1500 * 4)


def test_simultaneous_games_do_not_see_each_other(spark, data):
    made = data[0]
    rows = contests.team_games(made.games)
    coach = contests.regime_change(rows).withColumnRenamed("new_coach", "new_head_coach")
    plain = rows.select("game_id", "team", "opponent", "season", "kickoff_utc").join(coach, ["game_id", "team"])
    values = ratings.both_sides(made.team_epa, "epa_sum", "plays")
    windowed = {(r.game_id, r.team): r for r in ratings.shrunk(plain, values).collect()}
    # a plain walk, moment by moment
    known = {(r.game_id, r.team): (r["off"], r["def"]) for r in values.collect()}
    every = sorted(plain.collect(), key=lambda r: (r.kickoff_utc, r.game_id, r.team))
    league_mean, team_mean = {}, {}
    for r in every:
        if (r.game_id, r.team) in known:
            league_mean.setdefault(r.season, []).append(known[r.game_id, r.team][0])
            team_mean.setdefault((r.team, r.season), []).append(known[r.game_id, r.team])
    mean = lambda x: sum(x) / len(x)
    for adjust in (False, True):
        state, rated = {}, {}
        for at in sorted({r.kickoff_utc for r in every}):
            now = [r for r in every if r.kickoff_utc == at]
            for r in now:
                k = 2.0 if r.new_head_coach else 4.0
                prior = (0.0, 0.0)
                if r.season - 1 in league_mean:
                    past = team_mean[r.team, r.season - 1]
                    prior = tuple(0.6 * (mean([p[i] for p in past]) - mean(league_mean[r.season - 1])) for i in (0, 1))
                s = state.get((r.team, r.season), (0, 0, 0))
                rated[r.game_id, r.team] = tuple((k * prior[i] + s[i]) / (k + s[2]) for i in (0, 1))
            for r in now:
                c = mean(league_mean[r.season - 1]) if r.season - 1 in league_mean else 0.0
                o, d = (v - c for v in known[r.game_id, r.team])
                if adjust:
                    o, d = o - rated[r.game_id, r.opponent][1], d - rated[r.game_id, r.opponent][0]
                s = state.get((r.team, r.season), (0, 0, 0))
                state[r.team, r.season] = (s[0] + o, s[1] + d, s[2] + 1)
        got = windowed if not adjust else {(r.game_id, r.team): r for r in ratings.shrunk(plain, values, ratings.RatingParams(opponent_adjust=True)).collect()}
        assert len(got) == len(rated)
        for key, (o, d) in rated.items():
            assert (got[key].off_rating, got[key].def_rating) == pytest.approx((o, d))


def test_totals_from_plays(spark):
    s = "game_id string, season long, posteam string, defteam string, play_type string, epa double, qb_dropback int, passer_id string, qb_epa double, cpoe double, two_point_attempt int, pass int, rush int, success double, fumble int"
    rows = [
        ("g", 2020, "OAK", "X", "pass", 1.0, 1, "q", 1.0, 5.0, 0, 1, 0, 1.0, 0), ("g", 2020, "OAK", "X", "pass", 3.0, 1, "q", 3.0, None, None, 1, 0, None, 1),
        ("g", 2020, "OAK", "X", "run", -0.5, 0, None, None, None, 0, 0, 1, 0.0, 0), ("g", 2020, None, "X", "run", 9.0, 0, None, None, None, 0, 0, 1, 1.0, 0),
        ("g", 2020, "OAK", "X", "pass", 2.0, 1, "q", None, None, 1, 1, 0, 1.0, 0), ("g", 2020, "OAK", "X", "punt", 0.4, 0, None, None, None, 0, 0, 0, 0.0, 1),
        ("g", 2020, "X", "OAK", "run", None, 0, None, None, None, 0, 0, 1, 1.0, 0), ("g", 2020, "X", "OAK", "run", 0.1, 0, None, None, None, 0, 0, 1, 1.0, 0),
    ]
    plays = spark.createDataFrame(rows, s)
    t = rows_of(ratings.team_totals(plays), "team")
    assert t["LV"]["epa_sum"] == pytest.approx(1.0 - 2.69 - 0.5) and t["LV"]["plays"] == 3 and t["LV"]["pass_plays"] == 2
    assert t["LV"]["st_epa_sum"] == pytest.approx(0.4) and t["LV"]["st_plays"] == 1 and t["X"]["opponent"] == "LV"
    assert t["X"]["pass_epa_sum"] == 0.0 and t["X"]["st_epa_sum"] == 0.0
    assert rows_of(ratings.team_totals(plays, None), "team")["LV"]["epa_sum"] == pytest.approx(3.5)
    q = ratings.passer_totals(plays).collect()
    assert [(r.team, r.qb_id, r.dropbacks, r.qb_epa_sum, r.cpoe_sum, r.cpoe_n) for r in q] == [("LV", "q", 2, 4.0, 5.0, 1)]


def test_passers_games_are_summed_along_one_line(spark):
    """No join pairs a passer's games with those who ask: sums over seasons that overlap in time, for known, unknown and no passers."""
    kick = lambda k: datetime(2020, 1, 1) + timedelta(days=7 * k)
    seasons = [2020, 2021, 2020, 2022, 2021, 2023, 2020, 2023]
    games = [(f"g{k}", s, kick(k), "A", "B", "q" if k % 3 else None, None) for k, s in enumerate(seasons)]
    games = spark.createDataFrame(games, "game_id string, season long, kickoff_utc timestamp, home_team string, away_team string, home_qb_id string, away_qb_id string")
    thrown = [(f"g{k}", s, "A", "q", 10 + k, float(k), 1.0, 2) for k, s in enumerate(seasons)]
    thrown = spark.createDataFrame(thrown, "game_id string, season long, team string, qb_id string, dropbacks long, qb_epa_sum double, cpoe_sum double, cpoe_n long")
    players = spark.createDataFrame([("q", 2, 2000), ("other", 1, 2000)], "gsis_id string, draft_round long, rookie_season long")
    out = passers.passer_features(games, thrown, players, passers.PasserParams(100.0, 2))
    assert not [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if re.search(r"Join .*<.*kickoff_utc", line)]
    got = rows_of(out, "game_id")
    for k, s in enumerate(seasons):
        past = [j for j in range(k) if seasons[j] > s - 2]
        r = got[f"g{k}"]
        assert r["home_qb_epa"] == pytest.approx(sum(past) / (100 + sum(10 + j for j in past))) and r["home_qb_cpoe"] == pytest.approx(len(past) / (100 + 2 * len(past)))
        assert r["home_qb_bucket"] == ("day_2" if k else "day_3_udfa") and r["away_qb_bucket"] == "day_3_udfa" and r["away_qb_epa"] == 0.0


def test_passers_from_earlier_games(spark, data):
    made = data[0]
    got = rows_of(passers.passer_features(made.games, made.qb_games, made.players), "game_id")
    games = sorted(made.games.collect(), key=lambda g: g.kickoff_utc)
    info = {p.gsis_id: p for p in made.players.collect()}
    stats = [(q, next(g for g in games if g.game_id == q.game_id)) for q in made.qb_games.collect()]
    bucket = lambda q: "round_1" if info[q].draft_round == 1 else "day_2" if info[q].draft_round in (2, 3) else "day_3_udfa"
    for g in games[::5]:
        young = [(q, h) for q, h in stats if h.season < g.season and h.season - info[q.qb_id].rookie_season <= 1]
        own = {b: [q for q, _ in young if bucket(q.qb_id) == b] for b in passers.BUCKETS}
        for side, team in (("home", g.home_team), ("away", g.away_team)):
            named = g[f"{side}_qb_id"]
            if named is None:
                last = max((h.kickoff_utc for q, h in stats if q.team == team and h.kickoff_utc < g.kickoff_utc), default=None)
                best = [q for q, h in stats if q.team == team and h.kickoff_utc == last]
                named = max(best, key=lambda q: (q.dropbacks, q.qb_id)).qb_id if best else None
            b = bucket(named) if named else "day_3_udfa"
            base = own[b] if sum(q.dropbacks for q in own[b]) >= 500 else [q for q, _ in young]
            prior = sum(q.qb_epa_sum for q in base) / sum(q.dropbacks for q in base) if base else 0.0
            past = [q for q, h in stats if q.qb_id == named and h.kickoff_utc < g.kickoff_utc and h.season > g.season - 3]
            want = (250 * prior + sum(q.qb_epa_sum for q in past)) / (250 + sum(q.dropbacks for q in past))
            assert got[g.game_id][f"{side}_qb_epa"] == pytest.approx(want) and got[g.game_id][f"{side}_qb_bucket"] == b


@pytest.mark.parametrize("questionable", [False, True])
def test_shares_are_added_up_for_listed_players_only(spark, data, questionable):
    made, kept = data[0], {}
    args = (made.games, made.snaps, made.injuries, made.players, made.player_stats, made.contracts)
    availability.availability(*args, availability.AvailabilityParams(questionable=questionable), keep=lambda name, df: kept.setdefault(name, df)).collect()
    cands = next(df for name, df in kept.items() if name.startswith("candidates"))
    status = ("Out", "Doubtful", "Questionable") if questionable else ("Out", "Doubtful")
    listed = {(r.season, r.week, r.team, r.gsis_id) for r in made.injuries.collect() if r.report_status in status}
    got = cands.join(made.games.select("game_id", "season", "week"), "game_id").collect()
    assert got and {(r.season, r.week, r.team, r.player) for r in got} <= listed


def test_availability_equals_a_plain_walk(spark, data):
    made = data[0]
    args = (made.games, made.snaps, made.injuries, made.players, made.player_stats, made.contracts)
    got = rows_of(availability.availability(*args), "game_id")
    games = {g.game_id: g for g in made.games.collect()}
    ids = {p.pfr_id: p.gsis_id for p in made.players.collect() if p.pfr_id}
    snaps = [(s, games[s.game_id]) for s in made.snaps.collect()]
    reports = made.injuries.collect()
    for g in games.values():
        for side, team in (("home", g.home_team), ("away", g.away_team)):
            week = [r for r in reports if (r.season, r.week, r.team) == (g.season, g.week, team)]
            prior = sorted({h.kickoff_utc for s, h in snaps if s.team == team and h.kickoff_utc < g.kickoff_utc})[-4:]
            value = got[g.game_id][f"{side}_off_out"]
            if g.season < 2013 or not prior or not any(r.report_status for r in week):
                assert value is None
                continue
            lost = 0.0
            for p in {r.gsis_id for r in week if r.report_status in ("Out", "Doubtful")}:
                own = [s.offense_pct for s, h in snaps if s.team == team and h.kickoff_utc in prior and ids.get(s.pfr_player_id) == p]
                if len(own) >= 2 and sum(own) / len(own) >= 0.5:
                    lost += sum(own) / len(own)
            assert value == pytest.approx(lost)
    for mode in availability.MODES:
        out = availability.availability(*args, availability.AvailabilityParams(mode=mode, questionable=True)).collect()
        assert len(out) == len(games) and all((r.home_off_out is None) == (r.home_out_rb is None) for r in out)
    groups = rows_of(availability.availability(*args, availability.AvailabilityParams(mode="groups")), "game_id")
    for k, r in groups.items():
        if r["home_off_out"] is not None:
            assert sum(r[f"home_out_{x}"] for x in availability.OFFENSE) == pytest.approx(got[k]["home_off_out"])
    with pytest.raises(ValueError):
        availability.AvailabilityParams(mode="?")


def test_contract_midrank(spark):
    contracts = spark.createDataFrame([("a", "WR", 2010, 0.1), ("b", "WR", 2010, 0.2), ("c", "TE", 2011, 0.2), ("d", "WR", 2014, 0.9), ("e", "WR", 0, 0.5), ("a", "WR", 2012, 0.2)], "gsis_id string, position string, year_signed long, apy_cap_pct double")
    players = spark.createDataFrame([("z", 1), ("y", None)], "gsis_id string, draft_round long")
    wanted = spark.createDataFrame([("a", "wrte", 2011), ("a", "wrte", 2013), ("z", "wrte", 2013), ("y", "ol", 2013), ("a", "ol", 2013)], "player string, grp string, season long")
    got = {(r.player, r.grp, r.season): r.worth for r in availability.contract_quality(wanted, contracts, players).collect()}
    assert got == {("a", "wrte", 2011): 0.5 + 0.5 / 2, ("a", "wrte", 2013): 0.5 + (1 + 4) / 2 / 4, ("z", "wrte", 2013): 1.1, ("y", "ol", 2013): 0.6, ("a", "ol", 2013): 0.6}


def test_weather_ladder(spark, data):
    made = data[0]
    got = rows_of(weather.game_weather(made.games, made.weather), "game_id")
    games, obs = made.games.collect(), made.weather.collect()
    assert len(got) == len(games)
    for g in games:
        r = got[g.game_id]
        if g.roof in ("dome", "closed"):
            assert (r["temp_f"], r["weather_source"], r["is_indoor"]) == (70.0, "indoor", 1)
            continue
        seen = [o for o in obs if o.stadium_id == g.stadium_id and g.kickoff_utc <= o.time_utc <= g.kickoff_utc + timedelta(hours=3)]
        if seen:
            assert r["weather_source"] == "archive" and r["temp_f"] == pytest.approx(sum(o.temp_f for o in seen) / len(seen))
            assert r["wind_mph"] == pytest.approx(sum(o.wind_mph or 0 for o in seen) / len(seen)) and r["precip_in"] == pytest.approx(sum(o.precip_in for o in seen) * 4 / len(seen))
            continue
        before = [o for o in obs if o.time_utc < g.kickoff_utc and o.time_utc.month == g.kickoff_utc.month]
        own = [o for o in before if o.stadium_id == g.stadium_id] or before
        assert r["weather_source"] == "climatology" and r["temp_f"] == pytest.approx(sum(o.temp_f for o in own) / len(own) if own else 70.0)


def test_as_of_truncation_changes_no_feature(spark):
    """What is known before a game is all that its features say; a second setting makes only the parts that read it; every plan is short."""
    made, venues = league(spark)
    last = sorted(made.games.collect(), key=lambda g: (g.kickoff_utc, g.game_id))[-5]
    full, early = Parts(made, venues), Parts(made.as_of(last.kickoff_utc), venues)
    plans = {}
    for parts in (full, early):
        wrote = parts.store.write_table
        parts.store.write_table = lambda df, name, wrote=wrote: (plans.update({name: df._jdf.queryExecution().executedPlan().toString().count("Exchange")}), wrote(df, name))[1]
    for mode in ("count", "values", "values_contract"):
        params = FeatureParams(available=availability.AvailabilityParams(mode=mode, questionable=True), rating=ratings.RatingParams(opponent_adjust=mode == "values", special_teams=True))
        known = set(full.built)
        rows = rows_of(full.features(params), "game_id")
        assert len(rows) == made.games.count() and [*ID_COLUMNS, *FEATURE_COLUMNS] == list(next(iter(rows.values())))
        assert not known or {k.split("-")[0] for k in set(full.built) - known} <= {"availability", "ratings", "coaches"}
        seen = rows_of(early.features(params).filter(F.col("game_id") == last.game_id), "game_id")[last.game_id]
        for c in [*FEATURE_COLUMNS, "elo_home_pre", "weather_source"]:
            want = rows[last.game_id][c]
            assert seen[c] == (pytest.approx(want, abs=1e-9) if isinstance(want, float) else want), (mode, c)
        assert seen["margin"] is None
    assert max(plans.values()) <= 48, plans
    assert full.features(params)._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 24


def test_change_notes(spark):
    """Two runs of one game that differ in everything, a third like the second, and another game's single run."""
    ddl = "game_id string, run_type string, predicted_at timestamp, p double, margin double, p_vegas double, model_version string, is_final_injury_report boolean, latest_injury_week long, weather struct<source:string,temp_f:double,wind_mph:double,precip_in:double>, top_factors array<struct<feature:string,points:double>>"
    t = datetime(2014, 9, 1)
    first = ("g", "midweek", t, 0.5, 1.0, 0.5, "a", False, 3, ("climatology", 60.0, 5.0, 0.0), [("elo_diff", 2.0), ("rest_diff", -1.0), ("temp_f", 0.5), ("wind_mph", 0.1)])
    second = ("g", "final_injury", t + timedelta(days=1), 0.55, -1.25, 0.53, "b", True, 4, ("forecast", 52.0, 5.5, 0.06), [("elo_diff", 2.1), ("rest_diff", -2.0), ("wind_mph", 0.5), ("primetime", -0.4)])
    third = (*second[:1], "gameday", t + timedelta(days=2), *second[3:])
    other = ("h", *first[1:])
    out = logs.change_notes(spark.createDataFrame([third, first, other, second], ddl), LABELS, CHANGE_THRESHOLDS).orderBy("predicted_at").collect()
    assert [(r.from_run, r.to_run, r.p_delta, r.margin_delta) for r in out] == [("midweek", "final_injury", 5.0, -2.2), ("final_injury", "gameday", 0.0, 0.0)]
    minus, arrow = "\u2212", "\u2192"
    assert out[0].notes == [
        "Final injury report for this week now included", f"{LABELS['rest_diff']} {minus}1.0 {arrow} {minus}2.0 pts", f"{LABELS['temp_f']} dropped out of the top factors", f"{LABELS['primetime']} is now a top factor ({minus}0.4 pts)",
        "Weather now from the forecast (was a monthly average)", f"Temperature 60 {arrow} 52\u00b0F", f"Precipitation 0.00 {arrow} 0.06 in", f"Vegas benchmark 50% {arrow} 53%", "Model retrained (b)",
    ]
    assert out[1].notes == ["No meaningful input changes since the last run."]


def test_labels_cover_features():
    assert set(LABELS) == set(FEATURE_COLUMNS) and len(FEATURE_COLUMNS) == 54 == len(set(FEATURE_COLUMNS))


def test_expected_starters_only_touch_the_future(spark):
    made, _ = league(spark, unplayed_last_week=True)
    now = datetime(2014, 10, 10)
    depth = spark.createDataFrame([("AAA", datetime(2014, 10, 1), "new"), ("AAA", datetime(2014, 10, 12), "late"), ("AAA", datetime(2014, 9, 1), "old")], "team string, dt timestamp, qb_id string")
    before, after = rows_of(made.games, "game_id"), rows_of(contests.expected_starters(made.games, depth, now), "game_id")
    for k, g in after.items():
        for side in ("home", "away"):
            due = g["margin"] is None and g["kickoff_utc"] > now and g[f"{side}_team"] == "AAA"
            assert g[f"{side}_qb_id"] == ("new" if due else before[k][f"{side}_qb_id"])
    assert contests.current_season(made.games, datetime(2013, 9, 2)) == 2013


def test_asof_join_ties_and_strictness(spark):
    left = spark.createDataFrame([(1, 5), (1, 6), (1, 1), (2, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 2, None)], "k int, u int, v string")
    strict = sorted((r.k, r.t, r.v) for r in asof.asof_join(left, right, ["k"], "t", "u", ["v"], ties=["v"]).collect() if r.v)
    assert strict == [(1, 6, "b")]
    loose = sorted((r.k, r.t, r.v) for r in asof.asof_join(left, right, ["k"], "t", "u", ["v"], strict=False, ties=["v"]).collect() if r.v)
    assert loose == [(1, 5, "b"), (1, 6, "b")]


def test_nearest_season_prefers_the_later(spark):
    known = spark.createDataFrame([("a", 2010, "x"), ("a", 2014, "y")], "team string, season int, v string")
    wanted = spark.createDataFrame([("a", s) for s in range(2008, 2017)] + [("b", 2010)], "team string, season int")
    got = {(r.team, r.season): r.v for r in asof.nearest_fill(known, wanted, "team", "season", "v").collect()}
    assert [got["a", s] for s in range(2008, 2017)] == ["x"] * 4 + ["y"] * 5 and got["b", 2010] is None


def test_windows_and_logs(spark):
    ko = datetime(2024, 1, 10, 18)
    moments = [timedelta(days=5), timedelta(days=4), timedelta(days=2), timedelta(hours=24), timedelta(hours=6), timedelta(minutes=75), timedelta(minutes=76)]
    df = spark.createDataFrame([(k, ko - d) for k, d in enumerate(moments)], "k int, now timestamp")
    got = [r.run_type for r in logs.due_windows(df, F.lit(ko).cast("timestamp"), F.col("now")).orderBy("k").collect()]
    assert got == [None, "midweek", None, "final_injury", "gameday", None, "gameday"]
    assert logs.gameday_wait(ko, ko - timedelta(hours=8)) == timedelta(hours=2, minutes=1)
    assert logs.gameday_wait(ko, ko - timedelta(hours=1)) is None and logs.gameday_wait(ko, ko - timedelta(days=2)) is None
    changes = spark.createDataFrame([("g", 1, 60.0), ("g", 2, 66.0), ("g", 3, 67.0)], "game string, at int, temp_f double")
    assert [r.notes for r in logs.run_changes(changes, "game", "at", {"temp_f": 5.0}).orderBy("at").collect()] == [["no change"], ["temp_f"], ["no change"]]
    days = spark.createDataFrame([("v", datetime(2024, 1, d).date()) for d in (1, 10, 14, 15, 28, 30)], "stadium_id string, day date")
    assert [(r.first_day.day, r.last_day.day) for r in weather.request_windows(days).orderBy("first_day").collect()] == [(1, 14), (15, 28), (30, 30)]


def test_seeding_of_a_decided_season(spark):
    teams = [("A", 0, "N", "n1"), ("B", 1, "N", "n1"), ("C", 2, "N", "n2"), ("D", 3, "N", "n2"), ("E", 4, "S", "s1")]
    # A and B split their head to head, C beats everybody, D loses to everybody
    played = [("A", "B", 3), ("B", "A", 7), ("C", "A", 1), ("C", "B", 1), ("C", "D", 5), ("A", "D", 2), ("B", "D", 2), ("E", "D", 0)]
    games = spark.createDataFrame([(k, h, a, m, 0.5, k) for k, (h, a, m) in enumerate(played)] + [(99, "A", "E", None, 1.0, 99)], "game_id long, home_team string, away_team string, margin int, p_home double, game_no long")
    table = spark.createDataFrame(teams, "team string, team_no int, conf string, division string")
    got = {(r.sim, r.team): r for r in simulation.seeding(games, table, 20, conference=F.lit("N")).collect()}
    assert len(got) == 80
    for s in range(20):
        assert got[s, "C"].seed == 1 and got[s, "A"].winner and got[s, "A"].seed == 2 and got[s, "A"].halves == 6
        assert got[s, "B"].wild_card and got[s, "D"].wild_card and got[s, "D"].halves == 1
    one = simulation.summary(simulation.seeding(games, table, 20), F.lit("A")).head()
    assert (one.wins_mean, one.wins_p50, one.p_division, one.p_playoffs) == (3.0, 3.0, 1.0, 1.0)
    assert [(r.wins, r.prob) for r in simulation.win_distribution(simulation.seeding(games, table, 20), F.lit("D")).collect()] == [(1, 1.0)]


def test_expressions(spark):
    one = spark.range(1)
    got = one.select(X.normal_cdf(F.lit(1.3)).alias("a"), X.normal_cdf(F.lit(-2.5)).alias("b"), X.haversine_miles(F.lit(47.6), F.lit(-122.3), F.lit(25.8), F.lit(-80.2)).alias("c"), *[X.digitize(F.lit(p)).alias(f"d{k}") for k, p in enumerate((0.0, 0.3, 0.6, 0.7, 0.95, 1.0))]).head()
    assert got.a == pytest.approx(0.5 * (1 + math.erf(1.3 / 2**0.5)), abs=1e-12) and got.b == pytest.approx(0.5 * (1 + math.erf(-2.5 / 2**0.5)), abs=1e-12)
    assert 2700 < got.c < 2760
    assert [got[f"d{k}"] for k in range(6)] == [0, 2, 5, 6, 9, 9]
    said = spark.createDataFrame([(" Did Not Participate ",), ("LIMITED p",), ("Full",), ("?",), (None,)], "s string").select(X.practice_bucket(F.col("s")).alias("b"))
    assert [r.b for r in said.collect()] == ["dnp", "limited", "full", None, None]
    bad = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double").filter(X.not_finite(["x"])).count()
    assert bad == 3 and TEAMS


def test_archive_is_filled_and_forecast_kept_to_game_hours(spark):
    from datetime import datetime, timedelta

    from fieldmark.operators import weather

    kicks = [("a", 2012, datetime(2012, 9, 2, 17)), ("a", 2012, datetime(2012, 9, 9, 17)), ("a", 2008, datetime(2008, 9, 7, 17)), ("b", 2012, datetime(2012, 12, 30, 17))]
    games = spark.createDataFrame([(f"g{k}", s, y, at, "outdoors") for k, (s, y, at) in enumerate(kicks)], "game_id string, stadium_id string, season int, kickoff_utc timestamp, roof string")
    kept = spark.createDataFrame([("a", datetime(2012, 9, 2, 17), 60.0, 5.0, 0.0, "archive")], "stadium_id string, time_utc timestamp, temp_f double, wind_mph double, precip_in double, source string")
    asked = []

    def fetch(windows):
        asked.extend(windows.collect())
        hours = [("a", datetime(2012, 9, 2, 15) + timedelta(hours=h), None if h == 4 else 50.0 + h, 1.0, 0.0, "archive") for h in range(24 * 9)]
        return spark.createDataFrame(hours, kept.schema)

    filled = weather.fill_archive(games, kept, datetime(2013, 1, 2), fetch).collect()
    assert [(r.stadium_id, r.first_day.day, r.last_day.day) for r in asked] == [("a", 2, 9)]  # one window, nothing of 2008 nor of the last days
    got = {(r.time_utc.day, r.time_utc.hour): r.temp_f for r in filled}
    assert got[2, 17] == 60.0 and (2, 19) not in got and set(got) == {(2, h) for h in (17, 18, 20)} | {(9, h) for h in range(17, 21)}
    assert weather.fill_archive(games.filter("season = 2008"), kept, datetime(2013, 1, 2), None).count() == 1
    told = weather.forecast_rows(games.filter("stadium_id = 'a'"), lambda venues: fetch(venues))
    assert {(r.time_utc.day, r.time_utc.hour) for r in told.collect()} == {(d, h) for d in (2, 9) for h in range(17, 21)}
