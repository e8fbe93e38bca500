"""Append-only prediction logs: what is due, what is pending, which record counts, what changed."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.functions.expressions import not_finite
from fieldmark.models.evaluation import accuracy, brier, cumulative, log_loss
from fieldmark.operators.contests import elo_win_probability

# fixed values: run kinds with how long before the start they open and close
RUN_WINDOWS = (("midweek", timedelta(days=4, hours=12), timedelta(days=2)), ("final_injury", timedelta(hours=24), timedelta(hours=6)), ("gameday", timedelta(hours=6), timedelta(minutes=75)))
RESULT_GRACE, SIM_DAY_HOURS = timedelta(hours=6), 10


def _micros(d: timedelta) -> int:
    return d // timedelta(microseconds=1)


def due_windows(events: DataFrame, start: Column, now: Column) -> DataFrame:
    """events with run_type of the one window that is open: opens <= now < closes, to the microsecond.  Windows do not overlap."""
    ahead = F.unix_micros(start) - F.unix_micros(now)
    kind = F.when(F.lit(False), "")
    for name, opens, closes in RUN_WINDOWS:
        kind = kind.when((ahead <= _micros(opens)) & (ahead > _micros(closes)), name)
    return events.withColumn("run_type", kind)


def due_run(games: DataFrame, done: DataFrame, team: str, now: datetime) -> tuple[str, str] | None:
    """(game_id, run_type) that the team's next game is due for, unless it was run or the previous game began within six hours."""
    at = F.lit(now).cast("timestamp")
    own = games.filter((F.col("home_team") == team) | (F.col("away_team") == team))
    if own.filter((F.col("kickoff_utc") <= at) & (F.col("kickoff_utc") > at - F.expr("INTERVAL 6 HOURS"))).limit(1).collect():
        return None
    following = own.filter(F.col("kickoff_utc") > at).orderBy("kickoff_utc", "game_id").limit(1)
    open_now = due_windows(following, F.col("kickoff_utc"), at).filter("run_type is not null").select("game_id", "run_type")
    row = open_now.join(done.select("game_id", "run_type"), ["game_id", "run_type"], "left_anti").head()
    return (row.game_id, row.run_type) if row else None


def gameday_wait(kickoff: datetime, now: datetime, most: timedelta = timedelta(hours=5, minutes=30)) -> timedelta | None:
    """How long to wait until a minute into the game-day window; nothing if it is open, None if it is closed or too far."""
    opens, closes = kickoff - RUN_WINDOWS[2][1], kickoff - RUN_WINDOWS[2][2]
    if now >= closes:
        return None
    wait = max(timedelta(0), opens + timedelta(minutes=1) - now) if now < opens else timedelta(0)
    return wait if wait <= most else None


def pending_results(predicted: DataFrame, finished: DataFrame, recorded: DataFrame, key: str = "game_id") -> DataFrame:
    """finished rows that were predicted and are not recorded yet."""
    return finished.join(predicted.select(key), key, "left_semi").join(recorded.select(key), key, "left_anti")


def last_before(log: DataFrame, key: str, at: str, limit: Column, order: tuple[str, ...] = ()) -> DataFrame:
    """Each key's last record before its limit; of several at one moment the first in `order`."""
    w = W.partitionBy(key).orderBy(F.desc(at), *order)
    return log.filter(F.col(at) < limit).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def first_honest(log: DataFrame, key: str, at: str, limit: Column, order: tuple[str, ...] = ()) -> DataFrame:
    """Each key's earliest record that was made before its limit."""
    w = W.partitionBy(key).orderBy(at, *order)
    return log.filter(F.col(at).isNotNull() & (F.col(at) < limit)).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def once_per(log: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """fresh rows whose key is not in the log yet, one for each key."""
    return fresh.join(log.select(*keys), keys, "left_anti").dropDuplicates(keys)


def sim_day(at: Column) -> Column:
    """The day a simulation belongs to: it begins at ten o'clock UTC."""
    return F.to_date(at - F.expr(f"INTERVAL {SIM_DAY_HOURS} HOURS"))


def usable_rows(features: DataFrame, columns: list[str], outputs: tuple[str, ...] = ("p_home", "margin_home")) -> DataFrame:
    """Rows with finite inputs and outputs and a rounded probability strictly between 0 and 1."""
    p = F.bround(outputs[0], 4)
    return features.filter(~not_finite([*columns, *outputs]) & (p > 0) & (p < 1))


def tracked_side(predictions: DataFrame, team: str) -> DataFrame:
    """Predictions from the tracked team's side: probabilities, margin and interval flip when it plays away."""
    home = F.col("home_team") == team

    def flip(c: str) -> Column:
        return F.when(home, F.col(c)).otherwise(1 - F.col(c))

    return predictions.filter(home | (F.col("away_team") == team)).select(
        "game_id", home.alias("tracked_home"), F.when(home, F.col("away_team")).otherwise(F.col("home_team")).alias("opponent"),
        flip("p_home").alias("p"), F.when(home, F.col("margin_home")).otherwise(-F.col("margin_home")).alias("margin"),
        F.when(home, F.col("margin_lo")).otherwise(-F.col("margin_hi")).alias("margin_lo"), F.when(home, F.col("margin_hi")).otherwise(-F.col("margin_lo")).alias("margin_hi"),
        flip("p_vegas").alias("p_vegas"), *[F.transform(c, lambda x: x.withField("points", F.bround(F.when(home, x.points).otherwise(-x.points), 2))).alias(c) for c in ("top_factors",) if c in predictions.columns],
    )


def scorecard(scored: DataFrame, columns: dict[str, str], y: str = "y") -> DataFrame:
    """(method, n, log_loss, brier, accuracy) of each probability column over the rows where all have one (all rows if none has)."""
    common = scored.filter(" and ".join(f"{c} is not null" for c in columns.values()))
    rows = common.unpivot([y], list(columns.values()), "method", "p")
    return rows.groupBy("method").agg(F.count("*").alias("n"), log_loss(F.col("p"), F.col(y)).alias("log_loss"), brier(F.col("p"), F.col(y)).alias("brier"), accuracy(F.col("p"), F.col(y)).alias("accuracy"))


def weekly_loss(scored: DataFrame, p: str, y: str, week: str = "week") -> DataFrame:
    return cumulative(scored, p, y, week)


def largest(points: Mapping[str, Column], k: int = 6) -> Column:
    """The k largest contributions by size as an array of (size, i, feature, points), ties in order of the mapping."""
    given = F.arrays_zip(F.array(*[F.lit(f) for f in points]).alias("feature"), F.array(*points.values()).alias("points"))
    entries = F.transform(given, lambda e, i: F.struct((-F.abs(e.points)).alias("size"), i.alias("i"), e.feature.alias("feature"), e.points.alias("points")))
    return F.slice(F.array_sort(entries), 1, k)


def top_factors(df: DataFrame, key: str, columns: list[str], k: int = 6) -> DataFrame:
    """(key, feature, points, rank): each row's k largest contributions by size, ties in order of the columns.

    Ranked inside the row, so nothing is shuffled.
    """
    best = largest({c: F.col(c) for c in columns}, k)
    return df.select(key, F.posexplode(best).alias("pos", "e")).select(key, "e.feature", "e.points", (F.col("pos") + 1).cast("long").alias("rank"))


def run_changes(log: DataFrame, key: str, at: str, thresholds: dict[str, float], order: tuple[str, ...] = ()) -> DataFrame:
    """log with, for each watched column, its change since the key's previous record, and the array `notes` of those at or above their threshold."""
    w = W.partitionBy(key).orderBy(at, *order)
    out = log.withColumns({f"{c}_change": F.col(c) - F.lag(c).over(w) for c in thresholds})
    noted = [F.when(F.abs(f"{c}_change") >= t, F.lit(c)) for c, t in thresholds.items()]
    notes = F.array_compact(F.array(*noted))
    return out.withColumn("notes", F.when(F.size(notes) == 0, F.array(F.lit("no change"))).otherwise(notes))


def change_notes(log: DataFrame, labels: Mapping[str, str], thresholds: Mapping[str, float]) -> DataFrame:
    """(game_id, predicted_at, from_run, to_run, p_delta, margin_delta, notes): what changed between each prediction of a game and the one before.

    Notes come in this order: the injury report, at most three moves of factors, weather, the market, the model;
    one that says so where nothing did.
    """
    w = W.partitionBy("game_id").orderBy("predicted_at")
    now, before = F.struct(*[F.col(c) for c in log.columns]), F.lag(F.struct(*[F.col(c) for c in log.columns])).over(w)
    pairs = log.select(now.alias("b"), before.alias("a")).filter("a is not null")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))

    def signed(x: Column, form: str = "%.1f") -> Column:
        return F.regexp_replace(F.format_string(form, x), "-", "\u2212")

    final = F.when(b("is_final_injury_report") & ~a("is_final_injury_report"), F.lit("Final injury report for this week now included"))
    newer = F.when(b("latest_injury_week").isNotNull() & ~b("latest_injury_week").eqNullSafe(a("latest_injury_week")), F.format_string("Week %d injury report now included", b("latest_injury_week")))
    named = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])

    def told(m: Column) -> Column:
        name = F.coalesce(F.element_at(named, m.feature), m.feature)
        moved = F.concat(name, F.lit(" "), signed(m.points_before), F.lit(" \u2192 "), signed(m.points_now), F.lit(" pts"))
        entered = F.concat(name, F.lit(" is now a top factor ("), signed(m.points_now, "%+.1f"), F.lit(" pts)"))
        return F.when(m.kind == "moved", moved).when(m.kind == "entered", entered).otherwise(F.concat(name, F.lit(" dropped out of the top factors")))

    def change(c: str, text: str, form: str, unit: str) -> Column:
        x, y = a(f"weather.{c}"), b(f"weather.{c}")
        return F.when(F.abs(y - x) >= thresholds[c], F.format_string(f"{text} {form} \u2192 {form}{unit}", x, y))

    forecast = F.when((a("weather.source") == "climatology") & (b("weather.source") == "forecast"), F.lit("Weather now from the forecast (was a monthly average)"))
    weather = [forecast, change("temp_f", "Temperature", "%.0f", "\u00b0F"), change("wind_mph", "Wind", "%.0f", " mph"), change("precip_in", "Precipitation", "%.2f", " in")]
    market = F.when(F.abs(b("p_vegas") - a("p_vegas")) >= thresholds["p_vegas"] - 1e-12, F.format_string("Vegas benchmark %.0f%% \u2192 %.0f%%", a("p_vegas") * 100, b("p_vegas") * 100))
    model = F.when(b("model_version") != a("model_version"), F.concat(F.lit("Model retrained ("), b("model_version"), F.lit(")")))
    none = F.array().cast("array<string>")
    factors = F.coalesce(F.transform(factor_moves(b("top_factors"), a("top_factors"), thresholds["factor"]), told), none)
    notes = F.concat(F.array_compact(F.array(F.coalesce(final, newer))), factors, F.array_compact(F.array(*weather, market, model)))
    kept = F.when(F.size(notes) > 0, notes).otherwise(F.array(F.lit("No meaningful input changes since the last run.")))
    return pairs.select(
        "b.game_id", "b.predicted_at", a("run_type").alias("from_run"), b("run_type").alias("to_run"), F.bround((b("p") - a("p")) * 100, 1).alias("p_delta"),
        F.bround(b("margin") - a("margin"), 1).alias("margin_delta"), kept.alias("notes"),
    )


def factor_changes(now: Column, before: Column) -> tuple[Column, Column, Column]:
    """Feature names that stayed, came and went between two arrays of factors."""
    a, b = F.transform(now, lambda f: f.feature), F.transform(before, lambda f: f.feature)
    return F.array_intersect(a, b), F.array_except(a, b), F.array_except(b, a)


def factor_moves(now: Column, before: Column, least: float = 0.3, most: int = 3) -> Column:
    """The largest moves between two arrays of (feature, points): (feature, kind, points_before, points_now), largest first, ties by name.

    A factor in both moved if its points did by `least`; one in a single list entered or left, by all its points.
    """
    stayed, came, went = factor_changes(now, before)

    def points(of: Column, feature: Column) -> Column:
        return F.element_at(F.transform(F.filter(of, lambda f: f.feature == feature), lambda f: f.points), 1)

    def move(kind: str, size: Column, feature: Column) -> Column:
        return F.struct((-size).alias("order"), feature.alias("feature"), F.lit(kind).alias("kind"), F.when(F.lit(kind != "entered"), points(before, feature)).alias("points_before"), F.when(F.lit(kind != "left"), points(now, feature)).alias("points_now"))

    moves = F.concat(
        F.filter(F.transform(stayed, lambda f: move("moved", F.abs(points(now, f) - points(before, f)), f)), lambda m: m.order <= -least),
        F.transform(came, lambda f: move("entered", F.abs(points(now, f)), f)),
        F.transform(went, lambda f: move("left", F.abs(points(before, f)), f)),
    )
    return F.transform(F.slice(F.array_sort(moves), 1, most), lambda m: m.dropFields("order"))


def due_league_games(games: DataFrame, done: DataFrame, now: datetime) -> DataFrame:
    """The games whose final-report window is open and that are not in the league's log."""
    at = F.lit(now).cast("timestamp")
    due = due_windows(games, F.col("kickoff_utc"), at).filter(F.col("run_type") == "final_injury").drop("run_type")
    return due.join(done.select("game_id"), "game_id", "left_anti")


def league_predictions(told: DataFrame, columns: list[str], now: datetime, version: str) -> DataFrame:
    """Records of predicted games (elo ratings and predictions beside the features): those with finite inputs, ratings and outputs and probabilities inside (0, 1).  Games left out are due again."""
    elo = elo_win_probability(F.col("elo_home_pre") - F.col("elo_away_pre"), F.col("neutral"))
    inside = F.col("p_vegas_home").isNull() | (F.col("p_vegas_home") > 0) & (F.col("p_vegas_home") < 1)
    kept = usable_rows(told.filter("elo_home_pre is not null and elo_away_pre is not null"), columns)
    return kept.select(
        "game_id", "season", "week", F.lit(now).cast("timestamp").alias("predicted_at"), "kickoff_utc", "home_team", "away_team", F.bround("p_home", 4).alias("p_home"), F.bround("margin_home", 2).alias("margin_home"),
        F.bround("p_vegas", 4).alias("p_vegas_home"), F.bround(elo, 4).alias("p_elo_home"), F.lit(version).alias("model_version"),
    ).filter(inside)


def schedule_gaps(rows: DataFrame, key: str, step: str) -> DataFrame:
    """(key, step) of the numbers missing between two consecutive rows of a key."""
    following = F.lead(step).over(W.partitionBy(key).orderBy(step))
    open_rows = rows.select(key, step).distinct().withColumn("__next", following).filter(F.col("__next") > F.col(step) + 1)
    return open_rows.select(key, F.explode(F.sequence(F.col(step) + 1, F.col("__next") - 1)).alias(step))


def season_log(games: DataFrame, predictions: DataFrame, team: str, now: datetime) -> DataFrame:
    """(week, kind, game_id): the team's season as predicted, unpredicted (missed or upcoming) and bye rows."""
    own = games.filter((F.col("home_team") == team) | (F.col("away_team") == team))
    told = own.join(predictions.select("game_id").distinct().withColumn("__p", F.lit(True)), "game_id", "left")
    kind = F.when(F.col("__p"), "predicted").when(F.col("kickoff_utc") <= F.lit(now).cast("timestamp"), "missed").otherwise("upcoming")
    rows = told.select("season", "week", kind.alias("kind"), "game_id")
    byes = schedule_gaps(own, "season", "week").select("season", "week", F.lit("bye").alias("kind"), F.lit(None).cast("string").alias("game_id"))
    return rows.unionByName(byes)
