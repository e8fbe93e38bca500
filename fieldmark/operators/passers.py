"""Starting passers: who is expected, and how good they were before the game."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.functions.expressions import starter_bucket
from fieldmark.operators.asof import asof_join, expanding_before, known_seasons, latest, per_game
from fieldmark.sources.store import Keep, unkept

LEAST_PRIOR = 500
BUCKETS = ("round_1", "day_2", "day_3_udfa")
SUMS = ("qb_epa_sum", "dropbacks", "cpoe_sum", "cpoe_n")


@dataclass(frozen=True)
class PasserParams:
    prior_dropbacks: float = 250.0
    window_seasons: int = 3


def bucket_priors(rows: DataFrame, seasons: DataFrame, least: int = LEAST_PRIOR) -> DataFrame:
    """(season, bucket, prior_epa, prior_cpoe) of strictly earlier seasons; a bucket with few dropbacks takes all buckets together.

    rows: season, bucket and SUMS of the games that count for priors.
    """
    totals = rows.groupBy("season", "bucket").agg(*[F.sum(c).cast("double").alias(c) for c in SUMS])
    buckets = seasons.select("season").distinct().withColumn("bucket", F.explode(F.array(*map(F.lit, BUCKETS))))
    own = expanding_before(totals, ["bucket"], "season", seasons, SUMS)
    own = buckets.join(own, ["season", "bucket"], "left").fillna(0.0, list(SUMS))
    pooled = own.groupBy("season").agg(*[F.sum(c).alias(f"all_{c}") for c in SUMS])

    def rate(prefix: str, num: str, den: str):
        return F.when(F.col(prefix + den) > 0, F.col(prefix + num) / F.col(prefix + den)).otherwise(F.lit(0.0))

    enough = F.col("dropbacks") >= least
    return own.join(pooled, "season").select(
        "season", "bucket",
        F.when(enough, rate("", "qb_epa_sum", "dropbacks")).otherwise(rate("all_", "qb_epa_sum", "dropbacks")).alias("prior_epa"),
        F.when(enough, rate("", "cpoe_sum", "cpoe_n")).otherwise(rate("all_", "cpoe_sum", "cpoe_n")).alias("prior_cpoe"),
    )


def latest_starters(rows: DataFrame) -> DataFrame:
    """(team, game_id, kickoff_utc, qb_id): the passer with most dropbacks of each team game; of equals, the highest id."""
    return latest(rows, ["team", "game_id", "kickoff_utc"], ["dropbacks", "qb_id"], ["qb_id"])


def past_sums(expected: DataFrame, rows: DataFrame, info: DataFrame, window: int, seasons: Sequence[int]) -> DataFrame:
    """expected (game_id, side, season, kickoff_utc, qb_id) with draft_round and SUMS of the passer's games before the start, of the last `window` seasons.

    The passer, the games and who asks stand on one line in time, along which each season is summed by itself: its
    length grows with a passer's games and never with their square.  Who asks for nobody stands alone.
    """
    at = F.unix_micros("kickoff_utc").alias("__t")
    asked = expected.select("qb_id", F.when(F.col("qb_id").isNull(), F.col("game_id")).alias("__apart"), "game_id", "side", "season", at)
    games = rows.select("qb_id", at, F.col("season").alias("__s"), *[F.col(c).cast("double").alias(c) for c in SUMS])
    people = info.filter("qb_id is not null").select("qb_id", "draft_round")
    line = W.partitionBy("qb_id", "__apart").orderBy("__t").rangeBetween(W.unboundedPreceding, -1)  # who the passer is stands first, at no time
    told = {f"__{c}_{k}": F.sum(F.when(F.col("__s") == s, F.col(c))).over(line) for c in SUMS for k, s in enumerate(seasons)}
    stacked = asked.unionByName(games.filter("qb_id is not null and __t is not null"), allowMissingColumns=True).unionByName(people, allowMissingColumns=True)
    summed = stacked.withColumns(told | {"draft_round": F.max("draft_round").over(line)}).filter("side is not null")

    def within(c: str) -> Column:
        return sum((F.when(F.col("season") - window < F.lit(s), F.coalesce(f"__{c}_{k}", F.lit(0.0))).otherwise(0.0) for k, s in enumerate(seasons)), F.lit(0.0))

    return summed.select("game_id", "side", "season", "draft_round", *[within(c).alias(c) for c in SUMS])


def passer_features(games: DataFrame, passer_games: DataFrame, players: DataFrame, params: PasserParams = PasserParams(), keep: Keep = unkept) -> DataFrame:
    """(game_id, {home,away}_qb_{epa,cpoe,bucket}) of the scheduled, else the team's last starter, from games before the start.

    What does not depend on params is passed through keep: the passers' games and the expected passer of each side.
    """
    info = players.select(F.col("gsis_id").alias("qb_id"), "draft_round", "rookie_season")
    rows = keep("passer-games", passer_games.drop("season").join(per_game(games.select("game_id", "season", "kickoff_utc")), "game_id"))
    seasonal = rows.groupBy("qb_id", "season").agg(*[F.sum(c).alias(c) for c in SUMS])
    young = seasonal.join(info, "qb_id").filter(F.col("rookie_season").isNotNull() & (F.col("season") - F.col("rookie_season") <= 1)).withColumn("bucket", starter_bucket(F.col("draft_round")))
    priors = keep("passer-priors", bucket_priors(young.select("season", "bucket", *SUMS), games))
    starts = latest_starters(rows)

    both = F.inline(F.array(*[F.struct(F.lit(side).alias("side"), F.col(f"{side}_team").alias("team"), F.col(f"{side}_qb_id").alias("named")) for side in ("home", "away")]))
    sides = games.select("game_id", "season", "kickoff_utc", both)
    expected = asof_join(sides, starts, ["team"], "kickoff_utc", "kickoff_utc", ["qb_id"], ties=["game_id"])
    expected = keep("expected-passers", expected.withColumn("qb_id", F.coalesce(F.when(F.length("named") > 0, F.col("named")), "qb_id")))

    rated = (
        past_sums(expected, rows, info, params.window_seasons, known_seasons(games))
        .withColumn("bucket", starter_bucket(F.col("draft_round")))
        .join(F.broadcast(priors), ["season", "bucket"])  # three rows a season
    )
    k = params.prior_dropbacks
    rated = rated.select(
        "game_id", "side", F.col("bucket").alias("qb_bucket"),
        ((k * F.col("prior_epa") + F.col("qb_epa_sum")) / (k + F.col("dropbacks"))).alias("qb_epa"),
        ((k * F.col("prior_cpoe") + F.col("cpoe_sum")) / (k + F.col("cpoe_n"))).alias("qb_cpoe"),
    )
    return rated.groupBy("game_id").agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for c in ("qb_epa", "qb_cpoe", "qb_bucket") for s in ("home", "away")])


