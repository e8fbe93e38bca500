"""Feeds as a Spark data source: a partition a season (or any other unit), fetched inside tasks with retries, and the shaping of what they deliver.

`feed` makes a DataSource of a fetch callback, so that loading is spread over executors, a lost task fetches its own
unit again, and what Spark asks of a table (columns, a limit, a join) works on a feed as on any other.  The shaping
functions make the library's typed tables of raw ones.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fieldmark.functions.expressions import practice_bucket
from fieldmark.operators.contests import renamed_teams
from fieldmark.operators.ratings import passer_totals, team_totals
from fieldmark.sources.tables import SCHEMAS, empty, shaped

Fetch = Callable[[object], Iterable[tuple]]


class RateLimited(Exception):
    """Raised by a fetch that was told to come back later."""


@dataclass(frozen=True)
class Retry:
    """Attempts, the pause before the second one (doubled for each further), and the pause where the other side limits its rate."""

    attempts: int = 5
    first: float = 2.0
    limited: float = 65.0

    def pause(self, attempt: int, error: Exception) -> float:
        return self.limited if isinstance(error, RateLimited) else self.first * 2 ** (attempt - 1)

    def call(self, fetch: Fetch, unit: object, sleep: Callable[[float], None] = time.sleep) -> list[tuple]:
        """What fetch gives for a unit; the last error where no attempt gave any."""
        for attempt in range(1, self.attempts + 1):
            try:
                return list(fetch(unit))
            except Exception as error:
                if attempt == self.attempts:
                    raise
                sleep(self.pause(attempt, error) * (1 + random.random() / 10))
        raise ValueError("a retry needs at least one attempt")


@dataclass
class Unit(InputPartition):
    value: object


def feed(name: str, ddl: str, fetch: Fetch, units: Sequence[object], retry: Retry = Retry()) -> type[DataSource]:
    """A data source of that name: one partition for each unit, whose rows (tuples of the schema) fetch gives."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [Unit(u) for u in units]

        def read(self, partition: Unit) -> Iterator[tuple]:
            yield from retry.call(fetch, partition.value)

    class Feed(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ddl

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return Feed


def read_feed(spark: SparkSession, name: str, ddl: str, fetch: Fetch, units: Sequence[object], retry: Retry = Retry()) -> DataFrame:
    """The feed's rows; without units an empty table."""
    if not units:
        return spark.createDataFrame([], ddl)
    spark.dataSource.register(feed(name, ddl, fetch, units, retry))
    return spark.read.format(name).load()


# -- raw tables made into typed ones ------------------------------------------------------------------------


def schedule(raw: DataFrame) -> DataFrame:
    return renamed_teams(raw, ["home_team", "away_team"])


def injuries(raw: DataFrame) -> DataFrame:
    return shaped(renamed_teams(raw, ["team"]).withColumn("practice_status", practice_bucket(F.col("practice_status"))), "injuries")


def snaps(raw: DataFrame) -> DataFrame:
    return shaped(renamed_teams(raw, ["team"]), "snaps")


def player_stats(raw: DataFrame) -> DataFrame:
    return shaped(renamed_teams(raw, ["team"]), "player_stats")


def _identified(raw: DataFrame, name: str) -> DataFrame:
    return shaped(raw.filter("gsis_id is not null"), name)


def players(raw: DataFrame) -> DataFrame:
    return _identified(raw, "players")


def contracts(raw: DataFrame) -> DataFrame:
    return _identified(raw, "contracts")


def play_tables(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Team and passer totals of plays."""
    return shaped(team_totals(raw), "team_epa"), shaped(passer_totals(raw), "qb_games")


def first_passers(raw: DataFrame) -> DataFrame:
    """(team, dt, qb_id): the passer ranked first on each dated chart; of several on one date the lowest id.  Charts without dates give none."""
    if "dt" not in raw.columns:
        return empty(raw.sparkSession, "depth_qb")
    first = raw.filter((F.col("pos_abb") == "QB") & (F.col("pos_rank") == 1) & F.col("gsis_id").isNotNull())
    named = renamed_teams(first, ["team"]).select("team", F.to_timestamp("dt").alias("dt"), F.col("gsis_id").alias("qb_id"))
    return shaped(named.groupBy("team", "dt").agg(F.min("qb_id").alias("qb_id")), "depth_qb")


# fixed values: conference and division of the current teams
DIVISIONS = {
    "AFC East": ("BUF", "MIA", "NE", "NYJ"), "AFC North": ("BAL", "CIN", "CLE", "PIT"),
    "AFC South": ("HOU", "IND", "JAX", "TEN"), "AFC West": ("DEN", "KC", "LAC", "LV"),
    "NFC East": ("DAL", "NYG", "PHI", "WAS"), "NFC North": ("CHI", "DET", "GB", "MIN"),
    "NFC South": ("ATL", "CAR", "NO", "TB"), "NFC West": ("ARI", "LA", "SEA", "SF"),
}


def static_teams(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, d.split(" ")[0], d) for d, ts in DIVISIONS.items() for t in ts], SCHEMAS["teams"])


def teams(spark: SparkSession, raw: Callable[[], DataFrame]) -> DataFrame:
    """The current teams of a raw table (team_abbr, team_conf, team_division) under their present names, the first row of each; the fixed ones where it cannot be had or lacks one."""
    known = static_teams(spark)
    try:
        named = raw().select(F.col("team_abbr").alias("team"), F.col("team_conf").alias("conf"), F.col("team_division").alias("division"), F.monotonically_increasing_id().alias("place"))
        current = renamed_teams(named, ["team"]).join(known.select("team"), "team", "left_semi")
        found = shaped(current.groupBy("team").agg(F.min_by(F.struct("conf", "division"), "place").alias("f")).select("team", "f.*"), "teams")
        rows = found.collect()  # 32 at most
    except Exception:
        return known
    return spark.createDataFrame(rows, SCHEMAS["teams"]) if len(rows) == known.count() else known


