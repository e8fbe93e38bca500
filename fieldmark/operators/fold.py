"""Ratings whose state depends on the opponents' state: an ordered fold.

No window expresses these, as each step reads what the last one wrote for both sides.  Leagues are
independent, and ratings that start anew each season are independent between seasons too, so rows are dealt
by these and each is streamed through its own fold in order: state is a number for each team, whatever the
number of contests.  Elo carries over seasons: one league is one fold by nature.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EloParams:
    k: float = 20.0
    home_field: float = 48.0
    revert: float = 1 / 3
    base: float = 1500.0


def ordered_fold(rows: DataFrame, league: str, order: list[str], schema: str, start: Callable[[], Callable[[tuple], tuple | None]]) -> DataFrame:
    """Stream each league's rows in order through a step made by start(); the step's tuples are the output rows."""
    columns = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, step = object(), None
        at = columns.index(league)
        names = [c.split(" ")[0] for c in schema.split(", ")]
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                if row[at] != now:
                    now, step = row[at], start()
                out.append(step(row))
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(league).sortWithinPartitions(league, *order).mapInPandas(run, schema)


def _missing(x) -> bool:
    return x is None or x != x


def elo(games: DataFrame, params: EloParams = EloParams(), league: str | None = None, order: tuple[str, ...] = ("kickoff_utc", "game_id")) -> DataFrame:
    """(game_id, elo_home_pre, elo_away_pre): ratings before each game; a game without a result changes nothing.

    A team starts at base; at its first game of another season it is pulled back to base once.  The winner's
    gain grows with the margin and shrinks with the rating gap.
    """
    kind = games.schema["game_id"].dataType.simpleString()
    rows = games.withColumn("__league", F.col(league).cast("string") if league else F.lit("all")).select("__league", *order, *[c for c in ("game_id",) if c not in order], "season", "home_team", "away_team", "margin", "neutral")
    place = {c: k for k, c in enumerate(rows.columns)}

    def start():
        rating: dict = {}
        seen: dict = {}

        def current(team, season) -> float:
            if team not in rating:
                rating[team] = params.base
            elif seen[team] != season:
                rating[team] = params.base + (rating[team] - params.base) * (1 - params.revert)
            seen[team] = season
            return rating[team]

        def step(row):
            season, home, away, margin = row[place["season"]], row[place["home_team"]], row[place["away_team"]], row[place["margin"]]
            a, b = current(home, season), current(away, season)
            if not _missing(margin):
                gap = a - b + (0.0 if row[place["neutral"]] else params.home_field)
                chance = 1.0 / (1.0 + 10.0 ** min(-gap / 400, 308.0))  # a larger power has no double
                won = 1.0 if margin > 0 else 0.0 if margin < 0 else 0.5
                size = 1.0 if margin == 0 else math.log(abs(margin) + 1) * 2.2 / ((gap if margin > 0 else -gap) * 0.001 + 2.2)
                moved = params.k * size * (won - chance)
                rating[home] += moved
                rating[away] -= moved
            return row[place["game_id"]], a, b

        return step

    return ordered_fold(rows, "__league", list(order), f"game_id {kind}, elo_home_pre double, elo_away_pre double", start)


def adjusted_ratings(rows: DataFrame, league: str | None = None, at: str = "kickoff_utc") -> DataFrame:
    """(game_id, team, off_rating, def_rating) with each result measured against the opponent's rating before the game.

    Every season starts from its priors, so each season of each league is a fold of its own.

    rows: one for each game and team, with season, opponent, k (games the prior is worth), prior_off, prior_def
    and off, def (deviations of this game, null without a result).  All games of one moment are rated before
    any of them counts: the output of a moment is held back until its last row is read.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("game_id", "team")}
    own = F.struct(F.col(league).cast("string") if league else F.lit("all"), "season").cast("string")
    data = rows.withColumn("__league", own).select("__league", at, "game_id", "team", "season", "opponent", "k", "prior_off", "prior_def", "off", "def")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        moment, held, now = None, [], None
        names = ["game_id", "team", "off_rating", "def_rating"]

        def settle() -> list[tuple]:
            rated = {}
            for _, _, game, team, season, _, k, p_off, p_def, _, _ in held:
                o, d, n = state.get((team, season), (0.0, 0.0, 0))
                rated[game, team] = ((k * p_off + o) / (k + n), (k * p_def + d) / (k + n))
            for _, _, game, team, season, opponent, _, _, _, off, allowed in held:
                if _missing(off) or _missing(allowed):
                    continue
                opp_off, opp_def = rated.get((game, opponent), (0.0, 0.0))
                o, d, n = state.get((team, season), (0.0, 0.0, 0))
                state[team, season] = (o + off - opp_def, d + allowed - opp_off, n + 1)
            held.clear()
            return [(g, t, a, b) for (g, t), (a, b) in rated.items()]

        for batch in batches:
            out = []
            for row in chain(batch.itertuples(index=False, name=None)):
                if (row[0], row[1]) != moment:
                    out += settle()
                    if row[0] != now:
                        state.clear()
                    now, moment = row[0], (row[0], row[1])
                held.append(row)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(settle(), columns=names)

    schema = f"game_id {kinds['game_id']}, team {kinds['team']}, off_rating double, def_rating double"
    return data.repartition("__league").sortWithinPartitions("__league", at, "game_id", "team").mapInPandas(run, schema)
