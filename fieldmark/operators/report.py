"""The report dataset: labels, record, outlook, and the JSON that a page is drawn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.operators.features import FEATURE_COLUMNS

CHANGE_THRESHOLDS = {"factor": 0.3, "p_vegas": 0.01, "temp_f": 5.0, "wind_mph": 5.0, "precip_in": 0.05}
_WORDS = {"qb": "QB", "epa": "EPA", "cpoe": "CPOE", "elo": "Elo", "st": "special teams", "def": "defense", "off": "offense", "tz": "time zone", "hfa": "home advantage", "diff": "difference", "div": "division", "mph": "(mph)", "temp": "temperature", "ol": "offensive line", "wrte": "receivers", "rb": "running backs", "dl": "defensive line", "lb": "linebackers", "db": "defensive backs"}


def label(feature: str) -> str:
    """A feature's name in words."""
    said = " ".join(_WORDS.get(w, w) for w in feature.split("_"))
    return said[:1].upper() + said[1:]


LABELS = {f: label(f) for f in FEATURE_COLUMNS}


def record(games: DataFrame, team: str) -> DataFrame:
    """(wins, losses, ties) of a team's finished games."""
    own = games.filter(((F.col("home_team") == team) | (F.col("away_team") == team)) & F.col("margin").isNotNull())
    m = F.when(F.col("home_team") == team, F.col("margin")).otherwise(-F.col("margin"))
    return own.agg(F.count_if(m > 0).alias("wins"), F.count_if(m < 0).alias("losses"), F.count_if(m == 0).alias("ties"))


def outlook(snapshots: DataFrame) -> DataFrame:
    """One snapshot for each team and simulation day: the last."""
    best = F.max_by(F.struct(*[c for c in snapshots.columns if c not in ("team", "sim_day")]), "as_of")
    return snapshots.groupBy("team", "sim_day").agg(best.alias("s")).select("team", "sim_day", "s.*")


def write_dataset(parts: dict[str, DataFrame], path: str) -> None:
    """Each part as a JSON dataset under the path."""
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
