"""Contest tables: preparation, perspectives, truncation in time, and facts known before the start.

A games frame has game_id, season, week, game_type, kickoff_utc, home_team, away_team, home_score, away_score,
margin, neutral, roof, stadium_id, home_rest, away_rest, div_game, home_qb_id, away_qb_id, home_coach, away_coach
and spread_line; margin is null until there is a result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.functions.expressions import flag, haversine_miles, logistic_share, utc_offset_hours
from fieldmark.operators.asof import earliest, every_season, latest, most_common, nearest_fill, per_game

#: Team names that moved, under their present name.
ALIASES = {"OAK": "LV", "SD": "LAC", "STL": "LA"}
FIRST_RATING_SEASON = 2002
PER_GAME = ("team_epa", "qb_games", "snaps", "player_stats")


@dataclass(frozen=True)
class Dataset:
    """The typed input tables of feature building."""

    games: DataFrame
    team_epa: DataFrame
    qb_games: DataFrame
    injuries: DataFrame
    snaps: DataFrame
    players: DataFrame
    weather: DataFrame
    player_stats: DataFrame
    contracts: DataFrame

    def as_of(self, cutoff: datetime) -> Dataset:
        """Only what could be known before the cutoff: later results are null, later per-game rows gone, and reports stay
        for the weeks that have begun by a day after it."""
        at = F.lit(cutoff).cast("timestamp")
        games = truncated(self.games, "kickoff_utc", at, ("home_score", "away_score", "margin"))
        played = self.games.filter(F.col("kickoff_utc") < at).select("game_id")
        return replace(
            self,
            games=games,
            injuries=self.injuries.join(open_weeks(self.games, "kickoff_utc", at + F.expr("INTERVAL 1 DAY")), ["season", "week"], "left_semi"),
            **{t: getattr(self, t).join(played, "game_id", "left_semi") for t in PER_GAME},
        )


def truncated(games: DataFrame, at: str, cutoff: Column, results: Sequence[str]) -> DataFrame:
    """games with the result columns of everything at or after the cutoff nulled."""
    return games.withColumns({c: F.when(F.col(at) < cutoff, F.col(c)) for c in results})


def open_weeks(games: DataFrame, at: str, before: Column) -> DataFrame:
    return games.groupBy("season", "week").agg(F.min(at).alias("start")).filter(F.col("start") < before).select("season", "week")


def current_season(games: DataFrame, now: datetime) -> int | None:
    soon = F.lit(now).cast("timestamp") + F.expr("INTERVAL 7 DAYS")
    return games.filter(F.col("kickoff_utc") <= soon).agg(F.max("season")).head()[0]


def renamed_teams(df: DataFrame, columns: Sequence[str], aliases: Mapping[str, str] = ALIASES) -> DataFrame:
    return df.replace(dict(aliases), subset=list(columns))


def prepare_games(schedule: DataFrame, venues: DataFrame, first_season: int = FIRST_RATING_SEASON) -> DataFrame:
    """The games frame of a schedule with local start times (gameday, gametime in New York) and a result column.

    Raises ValueError where a venue is unknown.
    """
    games = schedule.filter(F.col("season") >= first_season)
    unknown = games.join(venues.select("stadium_id"), "stadium_id", "left_anti").select("stadium_id").distinct().limit(5).collect()
    if unknown:
        raise ValueError(f"unknown venues: {[r.stadium_id for r in unknown]}")
    local = F.to_timestamp(F.concat_ws(" ", "gameday", "gametime"), "yyyy-MM-dd HH:mm")
    fallback = F.when(F.col("roof_default") == "retractable", "closed").otherwise(F.col("roof_default"))
    return (
        games.join(venues.select("stadium_id", "roof_default"), "stadium_id")
        .withColumns({
            "kickoff_utc": F.to_utc_timestamp(local, "America/New_York"),
            "neutral": F.coalesce(F.col("location") == "Neutral", F.lit(False)),
            "roof": F.when(F.length("roof") > 0, F.col("roof")).otherwise(fallback),
            "margin": F.col("result").cast("long"),
            "div_game": F.col("div_game").cast("boolean"),
        })
        .drop("roof_default")
    )


def team_games(games: DataFrame) -> DataFrame:
    """Two rows a game, from either side, by one pass without a shuffle."""

    def side(own: str, other: str, is_home: bool) -> Column:
        return F.struct(
            F.col(f"{own}_team").alias("team"), F.col(f"{other}_team").alias("opponent"), F.lit(is_home).alias("is_home"),
            F.col(f"{own}_score").alias("points_for"), F.col(f"{other}_score").alias("points_against"),
            F.col(f"{own}_coach").alias("coach"), F.col(f"{own}_qb_id").alias("qb_id"),
        )

    return games.select("game_id", "season", "week", "kickoff_utc", F.inline(F.array(side("home", "away", True), side("away", "home", False))))


def home_away(games: DataFrame, per_team: DataFrame, columns: Sequence[str]) -> DataFrame:
    """per_team's columns as home_* and away_* of each game; null where a side has no row.

    The rows of a game meet in one grouped pass instead of a join for each side.
    """
    sides = games.select("game_id", F.explode(F.array(F.struct(F.lit("home").alias("side"), F.col("home_team").alias("team")), F.struct(F.lit("away").alias("side"), F.col("away_team").alias("team")))).alias("s")).select("game_id", "s.side", "s.team")
    joined = sides.join(per_game(per_team.select("game_id", "team", *columns)), ["game_id", "team"], "left")
    return joined.groupBy("game_id").agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in ("home", "away") for c in columns])


def with_regime_change(rows: DataFrame, who: str = "coach", at: str = "kickoff_utc") -> DataFrame:
    """rows with new_<who>: 1 where the team's first <who> of the season is not that of its last game of the season before.

    0 where either is unknown; a first game without a name stays without one.  Null for a row without team or season.  First and
    last come from one grouping; the season before is looked up among a team's seasons.
    """
    order = F.struct(at, "game_id")
    ends = rows.groupBy("team", "season").agg(F.min_by(F.struct(who), order)[who].alias("first_who"), F.max_by(F.struct(who), order)[who].alias("last_who"))
    seasons = W.partitionBy("team").orderBy("season")
    before = F.when(F.lag("season").over(seasons) == F.col("season") - 1, F.lag("last_who").over(seasons))
    flags = ends.select("team", "season", F.coalesce(F.col("first_who") != before, F.lit(False)).cast("long").alias(f"new_{who}"))
    return rows.join(flags, ["team", "season"], "left")


def regime_change(rows: DataFrame, who: str = "coach", at: str = "kickoff_utc") -> DataFrame:
    """(game_id, team, new_<who>) of the rows that have a team and a season."""
    return with_regime_change(rows, who, at).filter(F.col(f"new_{who}").isNotNull()).select("game_id", "team", f"new_{who}")


def elo_win_probability(diff: Column, neutral: Column, home_field: float = 48.0) -> Column:
    return logistic_share(diff + F.when(neutral, 0.0).otherwise(home_field))


def expected_starters(games: DataFrame, depth: DataFrame, now: datetime) -> DataFrame:
    """games whose unplayed future rows name the latest first-choice passer published by `now`, where one is."""
    at = F.lit(now).cast("timestamp")
    best = latest(depth.filter(F.col("dt") <= at), ["team"], ["dt", "qb_id"], ["qb_id"])
    out = games
    for side in ("home", "away"):
        known = best.select(F.col("team").alias(f"{side}_team"), F.col("qb_id").alias("__known"))
        upcoming = F.col("margin").isNull() & (F.col("kickoff_utc") > at) & F.col("__known").isNotNull()
        out = out.join(known, f"{side}_team", "left").withColumn(f"{side}_qb_id", F.when(upcoming, F.col("__known")).otherwise(F.col(f"{side}_qb_id"))).drop("__known")
    return out.select(games.columns)


def season_timing(games: DataFrame) -> DataFrame:
    """(game_id, week_number, is_final_regular_week, is_playoff)."""
    regular = F.col("game_type") == "REG"
    final = games.filter(regular).groupBy("season").agg(F.max("week").alias("__final"))
    joined = games.join(final, "season", "left")
    return joined.select("game_id", F.col("week").alias("week_number"), flag(F.coalesce(regular & (F.col("week") == F.col("__final")), F.lit(False))).alias("is_final_regular_week"), flag(~regular).alias("is_playoff"))


def home_venues(games: DataFrame) -> DataFrame:
    """(team, season, stadium_id): the most common venue of a team's home games that are not neutral, else that of its nearest season."""
    own = games.filter(~F.col("neutral")).select(F.col("home_team").alias("team"), "season", "stadium_id", "kickoff_utc", "game_id")
    known = most_common(own, ["team", "season"], "stadium_id", ["kickoff_utc", "game_id"])
    teams = games.select(F.explode(F.array("home_team", "away_team")).alias("team")).distinct()
    return nearest_fill(known, every_season(teams, games), "team", "season", "stadium_id")


def situational(games: DataFrame, venues: DataFrame, altitude: bool = False) -> DataFrame:
    """Home field, rest, travel, body clock and venue facts of each game."""
    place = venues.select("stadium_id", "lat", "lon", "tz", "elevation_m")
    base = home_venues(games).join(place, "stadium_id")
    out = games.join(place, "stadium_id")
    ko, new_york = F.col("kickoff_utc"), F.lit("America/New_York")
    made: dict[str, Column] = {}
    for side in ("home", "away"):
        own = base.select(F.col("team").alias(f"{side}_team"), "season", *[F.col(c).alias(f"__{side}_{c}") for c in ("lat", "lon", "tz", "elevation_m")])
        out = out.join(own, [f"{side}_team", "season"])
        rest = F.coalesce(f"{side}_rest", F.lit(7))
        zone = F.col(f"__{side}_tz")
        local = F.from_utc_timestamp(ko, zone)
        made |= {
            f"{side}_post_bye": flag(rest >= 13),
            f"{side}_short_week": flag(rest <= 5),
            f"{side}_tz_shift": utc_offset_hours(ko, F.col("tz")) - utc_offset_hours(ko, zone),
            f"{side}_body_clock": F.hour(local) + F.minute(local) / F.lit(60.0),
            f"__{side}_miles": haversine_miles(F.col(f"__{side}_lat"), F.col(f"__{side}_lon"), F.col("lat"), F.col("lon")),
        }
    field = F.when(F.col("neutral"), 0).otherwise(1)
    climb = F.greatest(F.lit(0.0), F.col("elevation_m") - F.col("__away_elevation_m")) / 1000 if altitude else F.lit(0.0)
    made |= {
        "home_field": field.cast("long"),
        "hfa_trend": field * (F.col("season") - 2015) / F.lit(10.0),
        "no_crowd": flag(F.col("season") == 2020),
        "rest_diff": F.coalesce("home_rest", F.lit(7)) - F.coalesce("away_rest", F.lit(7)),
        "primetime": flag(F.hour(F.from_utc_timestamp(ko, new_york)) >= 19),
        "div_game": flag(F.coalesce("div_game", F.lit(False))),
        "away_altitude_gain_km": climb,
    }
    done = out.withColumns(made).withColumn("travel_diff", F.col("__home_miles") - F.col("__away_miles"))
    return done.select("game_id", *[k for k in made if not k.startswith("__")], "travel_diff")


def previous_form(rows: DataFrame, at: str = "kickoff_utc") -> DataFrame:
    """rows with games and margin summed over the team's earlier games of the season."""
    w = W.partitionBy("team", "season").orderBy(at).rangeBetween(W.unboundedPreceding, -1)
    return rows.withColumns({"games_before": F.count("*").over(w), "margin_before": F.coalesce(F.sum("margin").over(w), F.lit(0))})
