"""Commands over a folder of input tables: features, backtest, holdout, retrain, predict, predict-league, simulate, wait-for-gameday, report.

Every command takes its clock from --now; no plan asks what time it is.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable
from dataclasses import asdict, replace
from datetime import UTC, datetime, timedelta
from hashlib import sha1

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.functions.expressions import outcome
from fieldmark.models import production, tuning
from fieldmark.models.regression import ModelConfig
from fieldmark.operators import contests, fold, logs, report, simulation, weather
from fieldmark.operators.availability import AvailabilityParams
from fieldmark.operators.features import FEATURE_COLUMNS, FeatureParams, Parts
from fieldmark.operators.passers import PasserParams
from fieldmark.operators.ratings import RatingParams
from fieldmark.session import session
from fieldmark.sources import tables
from fieldmark.sources.store import Store

TABLES = ("games", "team_epa", "qb_games", "injuries", "snaps", "players", "weather", "player_stats", "contracts")
HORIZON_DAYS = 16
# fixed values: keys of the log records
PREDICTION = "game_id string, run_type string, predicted_at timestamp, kickoff_utc timestamp, opponent string, tracked_home boolean, p double, margin double, margin_lo double, margin_hi double, p_vegas double, model_version string, is_final_injury_report boolean, weather struct<source:string,temp_f:double,wind_mph:double,precip_in:double>, latest_injury_week long, top_factors array<struct<feature:string,points:double>>"
LEAGUE = "game_id string, season long, week long, predicted_at timestamp, kickoff_utc timestamp, home_team string, away_team string, p_home double, margin_home double, p_vegas_home double, p_elo_home double, model_version string"
RESULT = "game_id string, recorded_at timestamp, margin long"
SNAPSHOT = "team string, season long, sim_day date, as_of timestamp, n_sims long, wins_mean double, wins_p10 double, wins_p50 double, wins_p90 double, p_playoffs double, p_division double, p_top_seed double, model_version string"


def clock(text: str | None) -> datetime:
    """An ISO time as naive UTC; now if there is none."""
    at = datetime.fromisoformat(text) if text else datetime.now(UTC)
    return at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at


class Folder:
    """The tables and artifacts under one path, of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str, team: str):
        self.spark, self.path, self.team = spark, path.rstrip("/"), team
        self.store = Store(spark, self.path)
        # projections of all features make inferred constraints grow with the square of the columns and beyond
        spark.conf.set("spark.sql.constraintPropagation.enabled", "false")

    def table(self, name: str) -> DataFrame:
        return tables.shaped(self.spark.read.parquet(f"{self.path}/{name}"), name)

    def weather(self) -> DataFrame:
        """The archive with what fills have committed, and forecasts for hours that it lacks."""
        kept = weather.archive(self.store, self.table("weather"))
        return weather.merged(self.table("forecast"), kept) if self.store.exists("forecast") else kept

    def payloads(self, name: str, source: str) -> Callable[[DataFrame], DataFrame]:
        """A fetch that answers from the table of payloads (stadium_id, payload) of that name."""
        return lambda asked: weather.parse_hourly(self.spark.read.parquet(self.store.path(name)).join(asked.select("stadium_id").distinct(), "stadium_id", "left_semi"), source)

    def fill(self, now: datetime) -> None:
        """Bring the weather archive up to date from the payloads at hand, venue by venue."""
        if self.store.exists("archive_payloads"):
            weather.resume_archive(self.store, self.table("games"), self.table("weather"), now, self.payloads("archive_payloads", "archive"))

    def forecast(self, now: datetime) -> None:
        """Forecast rows for the hours of the games of the next days, from the payloads at hand."""
        if self.store.exists("forecast_payloads"):
            at = F.lit(now).cast("timestamp")
            soon = self.table("games").filter((F.col("kickoff_utc") > at) & (F.col("kickoff_utc") <= at + F.expr(f"INTERVAL {HORIZON_DAYS} DAYS")))
            rows = weather.forecast_rows(soon, self.payloads("forecast_payloads", "forecast")).filter("temp_f is not null")
            self.store.write_table(tables.shaped(rows, "forecast"), "forecast")

    def data(self, now: datetime) -> contests.Dataset:
        data = contests.Dataset(**{t: self.table(t) for t in TABLES})
        games = contests.expected_starters(data.games, self.table("depth_qb"), now) if self.store.exists("depth_qb") else data.games  # no depth chart: the games keep their starters
        return replace(data, games=games, weather=self.weather())

    def parts(self, now: datetime) -> Parts:
        """The parts of the tables as they are, left by earlier commands where no table has changed since; those of other tables are dropped."""
        dated = now.isoformat() if self.store.exists("depth_qb") else ""  # what a chart tells depends on the time
        version = sha1(f"{self.store.version([*TABLES, 'venues', 'depth_qb', 'forecast', 'weather.parts'])} {dated}".encode()).hexdigest()[:16]
        for old in self.store.names("parts"):
            if old != version:
                self.store.delete(f"parts/{old}")
        return Parts(self.data(now), self.table("venues"), Store(self.spark, self.store.path(f"parts/{version}")))

    def feature_params(self) -> FeatureParams:
        return feature_params(self.store.read_json("features.json")) if self.store.exists("features.json") else FeatureParams()

    def features(self, now: datetime) -> DataFrame:
        return self.parts(now).features(self.feature_params())

    def log(self, name: str, ddl: str) -> DataFrame:
        return tables.read_log(self.spark, f"{self.path}/logs/{name}", ddl) if self.store.exists(f"logs/{name}") else self.spark.createDataFrame([], ddl)

    def append(self, df: DataFrame, name: str) -> None:
        tables.append_log(df, f"{self.path}/logs/{name}", df.columns)

    def config(self) -> ModelConfig:
        return ModelConfig.load(self.store) if self.store.exists("config.json") else ModelConfig()

    def model(self) -> production.Model:
        return production.Model.load(self.store, config=self.config())


def feature_params(told: dict) -> FeatureParams:
    """Stored settings of the features; unknown ones are refused, missing ones take their default."""
    kinds = {"rating": RatingParams, "passer": PasserParams, "available": AvailabilityParams, "elo": fold.EloParams}
    return FeatureParams(**{k: kinds[k](**v) if k in kinds else v for k, v in told.items()})


def features(f: Folder, now: datetime, args) -> None:
    f.fill(now)
    f.features(now).write.mode("overwrite").parquet(f"{f.path}/features")


def backtest(f: Folder, now: datetime, args) -> None:
    """Scores of the walk-forward; with --tune-features the stages of the features and the model's settings are tuned first and kept."""
    seasons = args.seasons or production.BACKTEST
    told: dict = {}
    if args.tune_features:
        parts = f.parts(now)
        params, told["feature_trials"] = tuning.tune_features(parts, seasons)
        f.store.write_json("features.json", asdict(params))
        frame = parts.store.write_table(parts.features(params), "frame")
        config, told["trials"] = tuning.tune_model(frame, seasons, {k: v for k, v in tuning.MODELS.items() if k in args.kinds})
        config.save(f.store)
        frame.write.mode("overwrite").parquet(f"{f.path}/features")
    frame, config = f.spark.read.parquet(f"{f.path}/features"), f.config()
    score = production.report(production.walk_forward(frame, seasons, config), f.team)
    f.store.write_json("backtest.json", score | told | {"fingerprint": config.fingerprint()})


def holdout(f: Folder, now: datetime, args) -> None:
    seen = f.store.read_json("holdout.json")["fingerprint"] if f.store.exists("holdout.json") else None
    if seen and not args.force:
        raise SystemExit("the holdout was already looked at; --force looks again and says so")
    frame, config = f.spark.read.parquet(f"{f.path}/features"), f.config()
    score = production.report(production.walk_forward(frame, args.seasons or production.HOLDOUT, config), f.team)
    f.store.write_json("holdout.json", score | {"fingerprint": config.fingerprint(), "previously_viewed": seen})


def retrain(f: Folder, now: datetime, args) -> None:
    """From every finished game, those of the current season among them; the metrics tell what the model was fitted on."""
    frame = f.spark.read.parquet(f"{f.path}/features")
    model = production.fit_model(frame, f.config())
    model.save(f.store)
    f.store.write_json("metrics.json", {"trained_at": now, "model_version": model.config.fingerprint(), "n_games": production.finished(frame).count(), "seasons": model.trained})


def new_results(f: Folder, now: datetime) -> None:
    at = F.lit(now).cast("timestamp")
    finished = f.table("games").filter("margin is not null").select("game_id", at.alias("recorded_at"), "margin")
    f.append(logs.pending_results(f.log("predictions", PREDICTION), finished, f.log("results", RESULT)), "results")


def predict(f: Folder, now: datetime, args) -> None:
    """Cheap questions first: the schedule and the logs say whether anything is due before the tables are read."""
    new_results(f, now)
    games = f.table("games")
    due = logs.due_run(games, f.log("predictions", PREDICTION), f.team, now)
    if due is None or (args.run_type and due[1] != args.run_type):
        return
    model = f.model()
    f.forecast(now)
    parts = f.parts(now)
    row = parts.store.write_table(parts.features(f.feature_params()).filter(F.col("game_id") == due[0]), "frame-one")
    told = model.predict(row).withColumn("__largest", logs.largest(model.contributions()))
    best = F.transform("__largest", lambda x: F.struct(x.feature.alias("feature"), x.points.alias("points")))
    side = logs.tracked_side(told.withColumn("top_factors", best), f.team)
    made = {"run_type": F.lit(due[1]), "predicted_at": F.lit(now).cast("timestamp"), "model_version": F.lit(model.config.fingerprint()), "p": F.bround("p", 4), "margin": F.bround("margin", 2), "margin_lo": F.bround("margin_lo", 2), "margin_hi": F.bround("margin_hi", 2), "p_vegas": F.bround("p_vegas", 4)}
    known = row.select("game_id", "season", F.struct(F.col("weather_source").alias("source"), F.bround("temp_f", 1).alias("temp_f"), F.bround("wind_mph", 1).alias("wind_mph"), F.bround("precip_in", 2).alias("precip_in")).alias("weather"), F.col("week").alias("__week"))
    listed = f.table("injuries").filter(F.col("team") == f.team).groupBy("season").agg(F.max("week").alias("latest_injury_week"))
    made |= {"is_final_injury_report": F.lit(due[1] != logs.RUN_WINDOWS[0][0]) & F.col("latest_injury_week").eqNullSafe(F.col("__week"))}
    rows = side.join(known, "game_id").join(games.select("game_id", "kickoff_utc"), "game_id").join(listed, "season", "left").withColumns(made).select(*tables.names(PREDICTION))
    if rows.count() != 1:
        raise SystemExit("exactly one row has to be predicted")
    f.append(rows, "predictions")


def predict_league(f: Folder, now: datetime, args) -> None:
    """Every game whose final-report window is open, once; games with missing inputs are due again."""
    games, done = f.table("games"), f.log("league_predictions", LEAGUE)
    at = F.lit(now).cast("timestamp")
    finished = games.filter("margin is not null").select("game_id", at.alias("recorded_at"), "margin")
    f.append(logs.pending_results(done, finished, f.log("league_results", RESULT)), "league_results")
    due = logs.due_league_games(games, done, now).select("game_id", "week", "kickoff_utc", "home_team", "away_team")
    if due.isEmpty():
        return
    model = f.model()
    f.forecast(now)
    parts = f.parts(now)
    frame = parts.store.write_table(parts.features(f.feature_params()).drop(*[c for c in due.columns if c != "game_id"]).join(due, "game_id"), "frame-due")
    f.append(logs.league_predictions(model.predict(frame), list(FEATURE_COLUMNS), now, model.config.fingerprint()), "league_predictions")


def simulate(f: Folder, now: datetime, args) -> None:
    """One snapshot for each simulation day, once the season's last game has its result."""
    season = contests.current_season(f.table("games"), now)
    day = (now - timedelta(hours=logs.SIM_DAY_HOURS)).date()
    if f.log("season_sim", SNAPSHOT).filter((F.col("sim_day") == F.lit(day)) & (F.col("team") == f.team)).limit(1).collect():
        return
    games = f.table("games").filter((F.col("season") == season) & (F.col("game_type") == "REG"))
    model = f.model()
    frame = f.features(now).filter(F.col("season") == season)
    told = model.predict(frame).select("game_id", "p_home")
    ratings = fold.elo(f.table("games")).join(games.select("game_id", "neutral"), "game_id").select("game_id", contests.elo_win_probability(F.col("elo_home_pre") - F.col("elo_away_pre"), F.col("neutral")).alias("p_elo"))
    chances = simulation.remaining_probabilities(games, told, ratings)
    ready = games.select("game_id", "home_team", "away_team", "margin").join(chances, "game_id", "left").withColumn("game_no", F.crc32("game_id"))
    teams = f.table("teams").withColumn("team_no", F.crc32("team"))
    conference = teams.filter(F.col("team") == f.team).head().conf
    one = simulation.summary(simulation.seeding(ready, teams, args.sims, conference=F.lit(conference)), F.lit(f.team))
    made = {"team": F.lit(f.team), "season": F.lit(season), "sim_day": F.lit(day), "as_of": F.lit(now).cast("timestamp"), "n_sims": F.lit(args.sims), "model_version": F.lit(model.config.fingerprint())}
    f.append(one.withColumns(made), "season_sim")


def wait_for_gameday(f: Folder, now: datetime, args) -> None:
    own = f.table("games").filter(((F.col("home_team") == f.team) | (F.col("away_team") == f.team)) & (F.col("kickoff_utc") > F.lit(now).cast("timestamp")))
    following = own.agg(F.min("kickoff_utc").alias("k")).head().k
    wait = logs.gameday_wait(following, now, timedelta(hours=args.max_hours)) if following else None
    if wait:
        time.sleep(wait.total_seconds())


def build_report(f: Folder, now: datetime, args) -> None:
    games = f.table("games")
    season = contests.current_season(games, now)
    this = games.filter(F.col("season") == season)
    told, league = f.log("predictions", PREDICTION), f.log("league_predictions", LEAGUE)
    scored = logs.last_before(told, "game_id", "predicted_at", F.col("kickoff_utc")).join(f.log("results", RESULT).select("game_id"), "game_id", "left_semi")
    finished = league.join(f.log("league_results", RESULT).select("game_id", "margin"), "game_id").withColumn("y", outcome(F.col("margin")))
    parts = {
        "record": report.record(this, f.team),
        "season_log": logs.season_log(this, told, f.team, now),
        "changes": logs.change_notes(told, report.LABELS, report.CHANGE_THRESHOLDS),
        "scored": scored,
        "scorecard": logs.scorecard(finished, {"model": "p_home", "elo": "p_elo_home", "vegas": "p_vegas_home"}),
        "weekly": logs.weekly_loss(finished.filter(F.col("season") == season), "p_home", "y"),
        "outlook": report.outlook(f.log("season_sim", SNAPSHOT)),
    }
    report.write_dataset(parts, f"{f.path}/report")


COMMANDS = {"features": features, "backtest": backtest, "holdout": holdout, "retrain": retrain, "predict": predict, "predict-league": predict_league, "simulate": simulate, "wait-for-gameday": wait_for_gameday, "report": build_report}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fieldmark", description=__doc__)
    p.add_argument("--data", required=True, help="folder of the input tables")
    p.add_argument("--team", default="SEA", help="the tracked team")
    p.add_argument("--now", help="ISO time; naive is UTC")
    sub = p.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        c = sub.add_parser(name)
        if name in ("backtest", "holdout"):
            c.add_argument("--seasons", type=int, nargs="*")
        if name == "backtest":
            c.add_argument("--tune-features", action="store_true")
            c.add_argument("--kinds", nargs="*", default=list(tuning.MODELS), help="model families to try")
        if name == "holdout":
            c.add_argument("--force", action="store_true")
        if name == "predict":
            c.add_argument("--run-type", choices=[w[0] for w in logs.RUN_WINDOWS])
        if name == "simulate":
            c.add_argument("--sims", type=int, default=10_000)
        if name == "wait-for-gameday":
            c.add_argument("--max-hours", type=float, default=5.5)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    COMMANDS[args.command](Folder(spark or session(), args.data, args.team), clock(args.now), args)


if __name__ == "__main__":
    main()
