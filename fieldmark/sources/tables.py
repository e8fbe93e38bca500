"""Typed tables: Parquet by season, venue CSV, JSON-lines logs, cached fetches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: columns and types of the input tables, in order
SCHEMAS = {
    "games": "game_id string, season long, week long, game_type string, kickoff_utc timestamp, home_team string, away_team string, home_score long, away_score long, margin long, neutral boolean, roof string, stadium_id string, home_rest long, away_rest long, div_game boolean, home_qb_id string, away_qb_id string, home_coach string, away_coach string, spread_line double",
    "team_epa": "game_id string, season long, team string, opponent string, epa_sum double, plays long, pass_epa_sum double, pass_plays long, rush_epa_sum double, rush_plays long, success_sum double, st_epa_sum double, st_plays long",
    "qb_games": "game_id string, season long, team string, qb_id string, dropbacks long, qb_epa_sum double, cpoe_sum double, cpoe_n long",
    "injuries": "season long, week long, team string, gsis_id string, position string, report_status string, practice_status string",
    "snaps": "game_id string, season long, week long, team string, pfr_player_id string, position string, offense_pct double, defense_pct double",
    "player_stats": "player_id string, game_id string, season long, week long, team string, position_group string, targets long, receiving_epa double, carries long, rushing_epa double",
    "teams": "team string, conf string, division string",
    "players": "gsis_id string, pfr_id string, position string, draft_round long, rookie_season long",
    "contracts": "gsis_id string, position string, year_signed long, apy_cap_pct double",
    "weather": "stadium_id string, time_utc timestamp, temp_f double, wind_mph double, precip_in double, source string",
    "depth_qb": "team string, dt timestamp, qb_id string",
    "forecast": "stadium_id string, time_utc timestamp, temp_f double, wind_mph double, precip_in double, source string",
    "venues": "stadium_id string, name string, lat double, lon double, tz string, roof_default string, elevation_m double",
}
#: First season that a per-season table has.
FIRST_SEASON = {"team_epa": 2002, "qb_games": 2002, "injuries": 2009, "snaps": 2013, "player_stats": 2012}
ROOFS = ("outdoors", "dome", "retractable")


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def names(ddl: str) -> list[str]:
    """The columns of a schema, in order."""
    return T.StructType.fromDDL(ddl).names


def shaped(df: DataFrame, name: str) -> DataFrame:
    """df's columns of the table, cast, in the table's order; others are left out."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema(name).fields])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def has_schema(spark: SparkSession, path: str, name: str) -> bool:
    """Whether there is a table at the path with all columns of `name`; only footers are read."""
    try:
        return {f.name for f in schema(name).fields} <= set(spark.read.parquet(path).columns)
    except AnalysisException:
        return False


def write_seasons(df: DataFrame, path: str) -> None:
    """Replace just the seasons that df has."""
    df.repartition("season").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(path)


def read_seasons(spark: SparkSession, path: str, name: str, seasons: Sequence[int]) -> DataFrame:
    """The seasons of a table; the filter prunes partitions."""
    df = spark.read.schema(schema(name)).parquet(path)
    return shaped(df.filter(F.col("season").isin([s for s in seasons if s >= FIRST_SEASON.get(name, s)])), name)


def read_through(spark: SparkSession, path: str, name: str, fetch: Callable[[], DataFrame], refresh: bool = False, empty_on_error: bool = False) -> DataFrame:
    """The table at the path, fetched and written first if it is missing, outdated or to be refreshed.

    A failed fetch gives an empty table that is not kept, or raises.
    """
    if not refresh and has_schema(spark, path, name):
        return shaped(spark.read.parquet(path), name)
    try:
        shaped(fetch(), name).write.mode("overwrite").parquet(path)
    except Exception:
        if not empty_on_error:
            raise
        return empty(spark, name)
    return shaped(spark.read.parquet(path), name)


def is_stale(written: datetime | None, now: datetime, most: timedelta = timedelta(days=7)) -> bool:
    return written is None or now - written > most


def stale_seasons(written: dict[int, datetime], games_end: dict[int, datetime], current: int, grace: timedelta = timedelta(days=7)) -> list[int]:
    """The seasons to fetch: the current one, those never written, and those written before their last game's corrections were in."""
    return sorted({current, *(s for s, end in games_end.items() if s not in written or written[s] < end + grace)})


def venues(spark: SparkSession, path: str) -> DataFrame:
    """The venue table of a CSV with header; ValueError where a roof is unknown or an elevation is not finite."""
    df = spark.read.schema(schema("venues")).option("header", True).option("mode", "FAILFAST").csv(path)
    bad = df.filter(~F.coalesce(F.col("roof_default").isin(*ROOFS), F.lit(False)) | F.col("elevation_m").isNull() | F.isnan("elevation_m") | (F.abs("elevation_m") == float("inf")))
    if wrong := [r.stadium_id for r in bad.limit(5).collect()]:
        raise ValueError(f"bad venue rows: {wrong}")
    return df


def read_log(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A JSON-lines log.  Blank lines do not count; a broken last line of a file is left out, a broken earlier one raises ValueError.

    A line's place is that of its split in the file and its number among the rows read with it, so a file is not read into one task.
    """
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), place.alias("line")).filter(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", f"{ddl}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    last = lines.groupBy("file").agg(F.max("line").alias("end"))
    broken = parsed.filter("r._corrupt is not null").join(last, "file")
    if bad := broken.filter("line < end").select("file", "value").limit(1).collect():
        raise ValueError(f"broken record in {bad[0].file}: {bad[0].value[:80]}")
    return parsed.filter("r._corrupt is null").select("r.*").drop("_corrupt")


def append_log(records: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append records that have exactly the keys, with sorted keys."""
    if set(records.columns) != set(keys):
        raise ValueError(f"a record needs exactly {sorted(keys)}, got {sorted(records.columns)}")
    records.select(*sorted(keys)).write.mode("append").json(path)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the first in order, nulls first."""
    others = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("__first"))
    return first.select(*keys, "__first.*").select(df.columns)
