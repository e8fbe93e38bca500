"""Weather at the venue over the hours of a game, with climatology where no hour is known."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.operators.asof import asof_join, hour_grid, per_game
from fieldmark.sources.store import Store

HOURS, ARCHIVE_LAG = 4, timedelta(days=6)
INDOOR = ("dome", "closed")
INDOOR_VALUES = {"temp_f": 70.0, "wind_mph": 0.0, "precip_in": 0.0}
HOURLY = "struct<time:array<string>,temperature_2m:array<double>,wind_speed_10m:array<double>,precipitation:array<double>>"


def parse_hourly(payloads: DataFrame, source: str) -> DataFrame:
    """(stadium_id, time_utc, temp_f, wind_mph, precip_in, source) of JSON payloads with parallel hourly arrays."""
    hourly = F.from_json("payload", f"struct<hourly:{HOURLY}>").getField("hourly")
    zipped = F.arrays_zip(*[hourly.getField(c).alias(c) for c in ("time", "temperature_2m", "wind_speed_10m", "precipitation")])
    rows = payloads.select("stadium_id", F.explode(zipped).alias("h"))
    return rows.select("stadium_id", F.to_timestamp("h.time").alias("time_utc"), F.col("h.temperature_2m").alias("temp_f"), F.col("h.wind_speed_10m").alias("wind_mph"), F.col("h.precipitation").alias("precip_in"), F.lit(source).alias("source"))


def game_hours(games: DataFrame) -> DataFrame:
    """The distinct (stadium_id, time_utc) hours of outdoor games."""
    return hour_grid(games.filter(~F.col("roof").isin(*INDOOR)), F.col("kickoff_utc"), HOURS, "time_utc").select("stadium_id", "time_utc").distinct()


def missing_hours(needed: DataFrame, kept: DataFrame) -> DataFrame:
    return needed.join(kept, ["stadium_id", "time_utc"], "left_anti")


def merged(kept: DataFrame, fresh: DataFrame) -> DataFrame:
    """Both tables with one row for each (stadium_id, time_utc): fresh rows win."""
    both = kept.withColumn("__p", F.lit(0)).unionByName(fresh.withColumn("__p", F.lit(1)))
    w = W.partitionBy("stadium_id", "time_utc").orderBy(F.desc("__p"), "source")
    return both.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__p", "__r")


def request_windows(days: DataFrame, span: int = 14) -> DataFrame:
    """(stadium_id, first_day, last_day): days greedily grouped into windows of under `span` days from the window's first day.

    A window opens where the last one cannot hold the day, so membership depends on what came before: an
    ordered fold over the distinct days of a venue.
    """
    listed = days.groupBy("stadium_id").agg(F.array_sort(F.collect_set("day")).alias("days"))
    empty = F.expr("cast(array() as array<struct<first_day:date,last_day:date>>)")

    def step(acc, day):
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.date_diff(day, last.first_day) < span)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last.first_day.alias("first_day"), day.alias("last_day"))))
        return F.when(fits, grown).otherwise(F.concat(acc, F.array(F.struct(day.alias("first_day"), day.alias("last_day")))))

    return listed.select("stadium_id", F.inline(F.aggregate("days", empty, step)))


def forecast_rows(games: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Forecast rows for the hours of upcoming outdoor games; fetch gets the venues (stadium_id) and returns what parse_hourly does."""
    hours = game_hours(games)
    return fetch(hours.select("stadium_id").distinct()).join(hours, ["stadium_id", "time_utc"], "left_semi")


def fill_archive(games: DataFrame, kept: DataFrame, now: datetime, fetch: Callable[[DataFrame], DataFrame], first_season: int = 2009) -> DataFrame:
    """kept and the hours of outdoor games that it lacks, of games of first_season on that ended ARCHIVE_LAG ago.

    fetch gets the windows (stadium_id, first_day, last_day) to ask for and returns what parse_hourly does;
    hours nobody asked for and hours without a temperature are not kept.  Without missing hours nothing is fetched.
    """
    old = games.filter((F.col("kickoff_utc") < F.lit(now - ARCHIVE_LAG).cast("timestamp")) & (F.col("season") >= first_season))
    needed = missing_hours(game_hours(old), kept)
    if needed.isEmpty():
        return kept
    windows = request_windows(needed.select("stadium_id", F.to_date("time_utc").alias("day")))
    fresh = fetch(windows).filter("temp_f is not null").join(needed, ["stadium_id", "time_utc"], "left_semi")
    return merged(kept, fresh)


def archive(store: Store, kept: DataFrame) -> DataFrame:
    """kept and what fills have committed since, one row for each (stadium_id, time_utc)."""
    parts = [store.spark.read.schema(kept.schema).parquet(store.path(f"weather.parts/{p}")) for p in store.names("weather.parts") if not p.endswith(".tmp")]
    return reduce(merged, parts, kept) if parts else kept


def resume_archive(store: Store, games: DataFrame, kept: DataFrame, now: datetime, fetch: Callable[[DataFrame], DataFrame], first_season: int = 2009) -> DataFrame:
    """fill_archive venue by venue: each venue's hours are committed as a table before the next is asked for.

    A fetch that fails ends the fill; the venues before it stay, and the next fill asks for the rest only.  Hours
    that came back without a temperature are asked for again.
    """
    old = games.filter((F.col("kickoff_utc") < F.lit(now - ARCHIVE_LAG).cast("timestamp")) & (F.col("season") >= first_season))
    needed = store.write_table(missing_hours(game_hours(old), archive(store, kept)), "weather.needed")
    for row in needed.select("stadium_id").distinct().orderBy("stadium_id").collect():  # as many as venues
        mine = needed.filter(F.col("stadium_id") == row.stadium_id)
        windows = request_windows(mine.select("stadium_id", F.to_date("time_utc").alias("day")))
        fresh = fetch(windows).filter("temp_f is not null").join(mine, ["stadium_id", "time_utc"], "left_semi").select(*kept.columns)
        store.write_table(fresh.dropDuplicates(["stadium_id", "time_utc"]), f"weather.parts/{now:%Y%m%d%H%M%S}-{row.stadium_id}")
    store.delete("weather.needed")
    return archive(store, kept)


def compact_archive(store: Store, kept: DataFrame) -> DataFrame:
    """The archive as one table `weather`, its parts dropped; a failure between leaves hours twice, which reading evens out."""
    whole = store.write_table(archive(store, kept), "weather.whole")
    out = store.write_table(whole, "weather")
    store.delete("weather.parts")
    store.delete("weather.whole")
    return out


def climate_before(games: DataFrame, archive: DataFrame, keys: list[str]) -> DataFrame:
    """games (game_id, kickoff_utc, keys) with s_ and n_ of each variable: sums and counts of the archive's hours of the same keys before the start.

    Days are summed first and carried by an as-of join, so a window holds one row a day and not every hour;
    the hours of the game's own day come by an equality join.
    """
    day = F.to_date("time_utc").alias("day")
    sums = {f"s_{c}": F.coalesce(F.sum(c), F.lit(0.0)) for c in INDOOR_VALUES} | {f"n_{c}": F.count(c) for c in INDOOR_VALUES}
    daily = archive.groupBy(*keys, day).agg(*[v.alias(k) for k, v in sums.items()])
    w = W.partitionBy(*keys).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    upto = daily.select(*keys, "day", *[F.sum(k).over(w).alias(k) for k in sums])
    dated = games.withColumn("__day", F.to_date("kickoff_utc"))
    out = asof_join(dated, upto, keys, "__day", "day", list(sums))
    hours = archive.select(*keys, day, "time_utc", *INDOOR_VALUES)
    own = dated.select("game_id", "kickoff_utc", *keys, F.col("__day").alias("day")).join(per_game(hours), [*keys, "day"]).filter("time_utc < kickoff_utc")
    own = own.groupBy("game_id").agg(*[v.alias(f"__{k}") for k, v in sums.items()])
    both = out.drop("__day").join(per_game(own), "game_id", "left")
    return both.withColumns({k: F.coalesce(k, F.lit(0)) + F.coalesce(f"__{k}", F.lit(0)) for k in sums}).drop(*[f"__{k}" for k in sums])


def game_weather(games: DataFrame, weather: DataFrame) -> DataFrame:
    """(game_id, temp_f, wind_mph, precip_in, is_indoor, weather_source): indoor, observed, else the month's mean before the start
    at the venue, else in the league, else indoor values."""
    outside = games.filter(F.coalesce(~F.col("roof").isin(*INDOOR), F.lit(True))).select("game_id", "stadium_id", "kickoff_utc", F.month("kickoff_utc").alias("month"))
    asked = hour_grid(outside, F.col("kickoff_utc"), HOURS, "time_utc")
    seen = asked.join(per_game(weather.filter("temp_f is not null")), ["stadium_id", "time_utc"])
    observed = seen.groupBy("game_id").agg(
        F.avg("temp_f").alias("o_temp_f"), F.avg(F.coalesce("wind_mph", F.lit(0.0))).alias("o_wind_mph"),
        (F.sum(F.coalesce("precip_in", F.lit(0.0))) * HOURS / F.count("*")).alias("o_precip_in"), F.min_by("source", "time_utc").alias("o_source"),
    )
    archive = weather.filter("source = 'archive'").withColumn("month", F.month("time_utc"))
    out = outside.join(per_game(observed), "game_id", "left")
    for prefix, keys in (("v", ["stadium_id", "month"]), ("l", ["month"])):
        known = climate_before(outside.select("game_id", "kickoff_utc", *keys), archive, keys)
        out = out.join(per_game(known.select("game_id", *[F.col(f"{x}_{c}").alias(f"{prefix}_{x}_{c}") for c in INDOOR_VALUES for x in ("s", "n")])), "game_id", "left")

    def ladder(c: str):
        scale = HOURS if c == "precip_in" else 1

        def mean(p: str):
            return F.when(F.col(f"{p}_n_{c}") > 0, F.col(f"{p}_s_{c}") / F.col(f"{p}_n_{c}")).otherwise(0.0) * scale

        climate = F.when(F.col("v_n_temp_f") > 0, mean("v")).when(F.col("l_n_temp_f") > 0, mean("l")).otherwise(INDOOR_VALUES[c])
        return F.when(F.col("o_source").isNotNull(), F.col(f"o_{c}")).otherwise(climate).alias(c)

    told = out.select("game_id", *map(ladder, INDOOR_VALUES), F.lit(0).cast("long").alias("is_indoor"), F.coalesce("o_source", F.lit("climatology")).alias("weather_source"))
    inside = games.filter(F.col("roof").isin(*INDOOR)).select("game_id", *[F.lit(v).alias(c) for c, v in INDOOR_VALUES.items()], F.lit(1).cast("long").alias("is_indoor"), F.lit("indoor").alias("weather_source"))
    return told.unionByName(inside)
