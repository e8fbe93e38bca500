"""The harness tables as contests: an order is a game between its customer's and its first supplier's nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.operators.asof import per_game
from fieldmark.operators.contests import Dataset, team_games
from fieldmark.sources.tables import empty


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game_id, season, week, kickoff (distinct integers), home_team, away_team, margin, neutral, coach, stadium, chance, rest.

    The first line of an order is a grouped minimum of a struct: one shuffle with map-side combine, no sort of lineitem.
    """
    lines = table(spark, sf_dir, "lineitem")
    first = lines.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate")).alias("f"))
    orders = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    joined = (
        orders.join(per_game(first), orders["o_orderkey"] == first["l_orderkey"])
        .join(per_game(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("f.l_suppkey") == F.col("s_suppkey"))
        .filter("c_nationkey != s_nationkey")
    )
    price = F.floor("o_totalprice").cast("long")
    return joined.select(
        F.col("o_orderkey").alias("game_id"), F.year(at).cast("long").alias("season"), (F.floor((F.dayofyear(at) - 1) / 7) + 1).cast("long").alias("week"),
        at.alias("start"), (F.unix_seconds(at) * 1_000_000 + F.col("o_orderkey")).alias("kickoff"),
        F.col("c_nationkey").cast("long").alias("home_team"), F.col("s_nationkey").cast("long").alias("away_team"),
        (price % 41 - 20).alias("margin"), (F.col("o_orderkey") % 10 == 0).alias("neutral"), F.col("o_orderpriority").alias("coach"),
        ((F.col("c_nationkey") * 3 + F.col("o_orderkey") % 3) % 30).cast("long").alias("stadium"),
        ((price % 97 + 1) / F.lit(99.0)).alias("p_model"), ((price % 89 + 1) / F.lit(91.0)).alias("p_other"),
    )


def sides(games: DataFrame) -> DataFrame:
    """Two rows a game: game_id, season, week, kickoff, start, team, opponent, is_home, margin (own side), coach."""
    wide = games.withColumns({"home_score": F.col("margin"), "away_score": -F.col("margin"), "home_coach": F.col("coach"), "away_coach": F.col("coach"), "home_qb_id": F.lit(None).cast("string"), "away_qb_id": F.lit(None).cast("string"), "kickoff_utc": F.col("kickoff")})
    rows = team_games(wide)
    return rows.select("game_id", "season", "week", F.col("kickoff_utc").alias("kickoff"), "team", "opponent", "is_home", F.col("points_for").alias("margin"), "coach")


ZONES = ("America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles")


def dataset(spark: SparkSession, sf_dir: str) -> tuple[Dataset, DataFrame]:
    """The contests as the library's typed tables, and 30 venues; tables that the harness has nothing for are empty."""
    c = contests(spark, sf_dir)
    gone, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    games = c.select(
        "game_id", "season", "week", F.when(F.col("neutral"), "POST").otherwise("REG").alias("game_type"), F.timestamp_micros("kickoff").alias("kickoff_utc"), "home_team", "away_team",
        F.col("margin").alias("home_score"), (-F.col("margin")).alias("away_score"), "margin", "neutral", F.when(F.col("game_id") % 9 == 0, "dome").otherwise("outdoors").alias("roof"), F.col("stadium").alias("stadium_id"),
        F.when(F.col("game_id") % 5 == 0, gone).otherwise(F.col("game_id") % 16).alias("home_rest"), (F.col("game_id") % 11 + 3).alias("away_rest"), (F.col("game_id") % 4 == 0).alias("div_game"),
        text.alias("home_qb_id"), text.alias("away_qb_id"), F.col("coach").alias("home_coach"), F.col("coach").alias("away_coach"), F.lit(None).cast("double").alias("spread_line"),
    )
    rows = sides(c)
    sums = rows.select("game_id", "season", "team", "opponent", (F.col("margin").cast("double") + 21 + F.col("game_id") % 7).alias("epa_sum"), F.when(F.col("game_id") % 13 == 0, 0).otherwise(10 + F.col("game_id") % 5).alias("plays"))
    typed = {t: empty(spark, t) for t in ("qb_games", "injuries", "snaps", "players", "weather", "player_stats", "contracts")}
    typed = {t: df.withColumns({k: F.col(k).cast("long") for k in ("game_id", "team", "stadium_id") if k in df.columns}) for t, df in typed.items()}
    k = F.col("id")
    venues = spark.range(30).select(k.alias("stadium_id"), (k * 7 % 120 - 60).cast("double").alias("lat"), (k * 13 % 300 - 150).cast("double").alias("lon"), F.element_at(F.array(*map(F.lit, ZONES)), (k % 4 + 1).cast("int")).alias("tz"), F.lit("outdoors").alias("roof_default"), (k * 50.0).alias("elevation_m"))
    return Dataset(games=games, team_epa=sums, **typed), venues


SQL = """
firsts AS (SELECT l_orderkey, l_suppkey FROM (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_quantity, l_shipdate) AS rn FROM lineitem) WHERE rn = 1),
contest AS (SELECT o_orderkey AS game_id, CAST(year(o_orderdate) AS BIGINT) AS season, CAST((dayofyear(o_orderdate) - 1) // 7 + 1 AS BIGINT) AS week, o_orderdate AS start,
  CAST(epoch(o_orderdate) AS BIGINT) * 1000000 + o_orderkey AS kickoff, CAST(c_nationkey AS BIGINT) AS home_team, CAST(s_nationkey AS BIGINT) AS away_team,
  CAST(floor(o_totalprice) AS BIGINT) % 41 - 20 AS margin, o_orderkey % 10 = 0 AS neutral, o_orderpriority AS coach,
  CAST((c_nationkey * 3 + o_orderkey % 3) % 30 AS BIGINT) AS stadium,
  (CAST(floor(o_totalprice) AS BIGINT) % 97 + 1) / CAST(99.0 AS DOUBLE) AS p_model, (CAST(floor(o_totalprice) AS BIGINT) % 89 + 1) / CAST(91.0 AS DOUBLE) AS p_other
  FROM orders JOIN firsts ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey),
side AS (SELECT game_id, season, week, kickoff, home_team AS team, away_team AS opponent, TRUE AS is_home, margin, coach FROM contest
  UNION ALL SELECT game_id, season, week, kickoff, away_team, home_team, FALSE, -margin, coach FROM contest)
"""


def sql(body: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH{' RECURSIVE' * recursive}{SQL.rstrip()}{', ' * bool(more)}{more}\n{body}"
