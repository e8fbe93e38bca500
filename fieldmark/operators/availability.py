"""Which starters are out, how often doubtful ones miss, and how much each is worth - as known before each game."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.functions.expressions import replaced, roster_bucket
from fieldmark.operators.asof import asof_join, expanding_before, indexed, per_game
from fieldmark.sources.store import OWN, Keep, unkept

FIRST_SNAP_SEASON, LOOKBACK, STARTER_SHARE, LEAST_APPEARANCES, LEAST_CASES, DURABILITY_GAMES = 2013, 4, 0.5, 2, 50, 8
REPLACEMENT_OPPS, REPLACEMENT_QUANTILE = 20, 0.25
MODES = ("count", "groups", "values", "count_diff", "values_pooled", "values_contract")
POOLED = ("values_pooled", "values_contract")
GROUPS, OFFENSE = ("ol", "wrte", "rb", "dl", "lb", "db"), ("ol", "wrte", "rb")
# fixed values: group of each position label
POSITIONS = {
    "T": "ol", "G": "ol", "C": "ol", "OT": "ol", "OG": "ol", "OL": "ol", "WR": "wrte", "TE": "wrte", "RB": "rb", "FB": "rb", "HB": "rb",
    "DE": "dl", "DT": "dl", "NT": "dl", "DL": "dl", "LB": "lb", "OLB": "lb", "ILB": "lb", "MLB": "lb",
    "CB": "db", "S": "db", "SS": "db", "FS": "db", "DB": "db", "SAF": "db",
}
CONTRACT_POSITIONS = POSITIONS | {"LT": "ol", "LG": "ol", "RG": "ol", "RT": "ol", "ED": "dl", "IDL": "dl"}
# fixed values: chance that a doubtful starter misses, by practice, while there are few cases
FALLBACK_MISS = {"dnp": 0.6, "limited": 0.25, "full": 0.05, "none": 0.2}
# fixed values: worth by draft class without a contract, and of linemen and defenders
CONTRACT_DEFAULT = {"round_1": 1.1, "day_2": 0.9, "later": 0.75, "udfa": 0.6}
LINEMAN = {"round_1": 1.3, "day_2": 1.1, "later": 1.0, "udfa": 0.9}


@dataclass(frozen=True)
class AvailabilityParams:
    mode: str = "count"
    prior_opps: float = 60.0
    quality_scale: float = 4.0
    lineman_quality: Mapping[str, float] = field(default_factory=lambda: dict(LINEMAN))
    durability_weight: float = 0.5
    questionable: bool = False

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown availability mode {self.mode!r}")
        if sorted(self.lineman_quality) != sorted(LINEMAN):
            raise ValueError(f"lineman_quality needs exactly {sorted(LINEMAN)}")


def group_of(position: Column, table: Mapping[str, str] = POSITIONS) -> Column:
    """The group of a position, of its first part where it names several; null for others."""
    return replaced(F.substring_index(position, "/", 1), table, F.lit(None).cast("string"))


def snap_rows(games: DataFrame, snaps: DataFrame, players: DataFrame) -> DataFrame:
    """(team, game_id, kickoff_utc, season, week, player, off, def, position): snaps of players who are no passers and whose game and id are known."""
    ids = players.filter(F.col("pfr_id").isNotNull()).groupBy("pfr_id").agg(F.max("gsis_id").alias("player"))
    known = snaps.filter(~F.col("position").eqNullSafe("QB")).join(ids, snaps["pfr_player_id"] == ids["pfr_id"])
    return known.join(per_game(games.select("game_id", "kickoff_utc", F.col("season").alias("__s"), F.col("week").alias("__w"))), "game_id").select(
        "team", "game_id", "kickoff_utc", F.col("__s").alias("season"), F.col("__w").alias("week"), "player",
        F.coalesce("offense_pct", F.lit(0.0)).alias("off"), F.coalesce("defense_pct", F.lit(0.0)).alias("def"), "position",
    )


def team_history(rows: DataFrame) -> DataFrame:
    """(team, game_id, kickoff_utc, idx): the games with snap data, numbered across seasons."""
    return indexed(rows.select("team", "game_id", "kickoff_utc").distinct(), ["team"], ["kickoff_utc", "game_id"])


def games_before(sides: DataFrame, history: DataFrame) -> DataFrame:
    """sides with `prior`, the number of the team's last game with snaps before the start (null: none)."""
    return asof_join(sides, history.withColumnRenamed("idx", "prior"), ["team"], "kickoff_utc", "kickoff_utc", ["prior"], ties=["prior"])


def candidates(sides: DataFrame, rows: DataFrame, history: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """(game_id, team, player, off_avg, def_avg, position) of players seen at least twice in the team's last games; where sides names players, of these only.

    The last games are a range of dense numbers, so each side asks for at most `lookback` of them by equality.
    """
    named = [c for c in ("player",) if c in sides.columns]
    wanted = sides.filter("prior is not null").select("game_id", "team", *named, F.explode(F.sequence(F.greatest(F.col("prior") - lookback + 1, F.lit(1)), F.col("prior"))).alias("idx"))
    wanted = wanted.join(history.select("team", "idx", F.col("game_id").alias("__past")), ["team", "idx"])
    joined = wanted.join(rows.select("team", F.col("game_id").alias("__past"), "player", "off", "def", "position"), ["team", "__past", *named])
    position = F.max_by(F.when(F.col("position").isNotNull(), F.col("position")), F.when(F.col("position").isNotNull(), F.col("idx")))
    return joined.groupBy("game_id", "team", "player").agg(F.avg("off").alias("off_avg"), F.avg("def").alias("def_avg"), position.alias("position"), F.count("*").alias("n")).filter(F.col("n") >= LEAST_APPEARANCES).drop("n")


def report_lists(injuries: DataFrame) -> DataFrame:
    """(season, week, team, player, out, questionable, practice): out beats questionable; of several rows the last by practice counts."""
    out = F.bool_or(F.coalesce(F.col("report_status").isin("Out", "Doubtful"), F.lit(False)))
    asked = F.col("report_status") == "Questionable"
    return injuries.groupBy("season", "week", "team", F.col("gsis_id").alias("player")).agg(out.alias("out"), F.bool_or(F.coalesce(asked, F.lit(False))).alias("questionable"), F.max(F.when(asked, F.col("practice_status"))).alias("practice"))


def reported_weeks(injuries: DataFrame) -> DataFrame:
    return injuries.filter("report_status is not null").select("season", "week", "team").distinct()


def questionable_cases(sides: DataFrame, cands: DataFrame, rows: DataFrame, injuries: DataFrame) -> DataFrame:
    """(season, practice, cases, missed): questionable starters in games with snap data, and how many had no snap."""
    listed = report_lists(injuries).filter("questionable and not out").select("season", "week", "team", "player", F.coalesce("practice", F.lit("none")).alias("practice"))
    starters = cands.filter(F.greatest("off_avg", "def_avg") >= STARTER_SHARE).select("game_id", "team", "player")
    asked = sides.filter(F.col("season") >= FIRST_SNAP_SEASON).join(rows.select("game_id", "team").distinct(), ["game_id", "team"], "left_semi").join(listed, ["season", "week", "team"]).join(starters, ["game_id", "team", "player"])
    took = rows.groupBy("game_id", "team", "player").agg(F.sum(F.col("off") + F.col("def")).alias("share"))
    return asked.join(took, ["game_id", "team", "player"], "left").groupBy("season", "practice").agg(F.count("*").alias("cases"), F.count_if(F.coalesce("share", F.lit(0.0)) == 0).alias("missed"))


def miss_rates(cases: DataFrame, seasons: DataFrame) -> DataFrame:
    """(season, practice, miss_rate) from strictly earlier seasons, the fixed rate while there are under LEAST_CASES cases."""
    before = expanding_before(cases, ["practice"], "season", seasons, ["cases", "missed"])
    buckets = seasons.select("season").distinct().withColumn("practice", F.explode(F.array(*map(F.lit, FALLBACK_MISS))))
    known = buckets.join(before, ["season", "practice"], "left")
    fixed = replaced(F.col("practice"), FALLBACK_MISS, F.lit(FALLBACK_MISS["none"]))
    return known.select("season", "practice", F.when(F.col("cases") >= LEAST_CASES, F.col("missed") / F.col("cases")).otherwise(fixed).alias("miss_rate"))


def skill_baselines(stats: DataFrame, seasons: DataFrame) -> DataFrame:
    """(season, grp, catch, carry, catch_floor, carry_floor, mix) of strictly earlier seasons: mean values, the lower quartile of
    player-seasons with enough opportunities (else the mean), and the share of targets."""
    grp = F.when(F.col("position_group").isin("WR", "TE"), "wrte").when(F.col("position_group") == "RB", "rb")
    usable = stats.withColumn("grp", grp).filter("grp is not null").withColumnRenamed("season", "s")
    per = usable.groupBy("s", "grp", "player_id").agg(*[F.sum(F.coalesce(c, F.lit(0))).cast("double").alias(c) for c in ("targets", "receiving_epa", "carries", "rushing_epa")])
    earlier = seasons.select("season").distinct().join(per, F.col("s") < F.col("season"))

    def rate(num: str, den: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(num), F.sum(den)), F.lit(0.0))

    def floor(num: str, den: str) -> Column:
        own = F.when(F.col(den) >= REPLACEMENT_OPPS, F.col(num) / F.col(den))
        return F.coalesce(F.percentile(own, REPLACEMENT_QUANTILE), rate(num, den))

    return earlier.groupBy("season", "grp").agg(
        rate("receiving_epa", "targets").alias("catch"), rate("rushing_epa", "carries").alias("carry"),
        floor("receiving_epa", "targets").alias("catch_floor"), floor("rushing_epa", "carries").alias("carry_floor"),
        F.coalesce(F.try_divide(F.sum("targets"), F.sum("targets") + F.sum("carries")), F.lit(0.5)).alias("mix"),
    )


def skill_quality(wanted: DataFrame, stats: DataFrame, games: DataFrame, params: AvailabilityParams, keep: Keep = unkept) -> DataFrame:
    """wanted (game_id, player, grp, season, kickoff_utc) with `worth`: value over replacement, shrunk, of this and last season's games before the start."""
    rows = stats.drop("season").join(games.select("game_id", F.col("season").alias("s"), F.col("kickoff_utc").alias("t")), "game_id")
    past = rows.select(F.col("player_id").alias("player"), "s", "t", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("targets", "receiving_epa", "carries", "rushing_epa")])
    near = wanted.join(past, "player").filter("t < kickoff_utc and s >= season - 1")
    sums = near.groupBy("game_id", "player").agg(F.sum("targets").alias("t"), F.sum("carries").alias("c"), F.sum(F.col("receiving_epa") + F.col("rushing_epa")).alias("epa"))
    base = keep("skill-baselines", skill_baselines(stats, games))
    out = wanted.join(sums, ["game_id", "player"], "left").join(base, ["season", "grp"], "left")
    t, c, epa = (F.coalesce(x, F.lit(0.0)) for x in ("t", "c", "epa"))
    mix = F.when(t + c > 0, t / (t + c)).otherwise(F.coalesce("mix", F.lit(0.5)))
    prior = F.coalesce(mix * F.col("catch") + (1 - mix) * F.col("carry"), F.lit(0.0))
    floor = F.coalesce(mix * F.col("catch_floor") + (1 - mix) * F.col("carry_floor"), F.lit(0.0))
    k = F.lit(params.prior_opps)
    value = F.when(k + t + c > 0, (k * prior + epa) / (k + t + c)).otherwise(prior)
    return out.select(*wanted.columns, F.greatest(F.lit(0.0), 1 + params.quality_scale * (value - floor)).alias("worth"))


def mid_ranks(asked: DataFrame, values: DataFrame) -> DataFrame:
    """asked (grp, season, v) with below, upto and of: how many values of the group's earlier seasons are smaller, not larger, and there.

    values: (grp, year_signed, v).  Instead of a theta join, both are put on one line and counted along it.
    The line is cut into ranges of v, counted apart, so that a large group is many windows and a short one
    over the ranges' totals.
    """
    seasons = sorted(r[0] for r in asked.select("season").distinct().collect())
    later = F.filter(F.array(*[F.lit(s).cast("long") for s in seasons]), lambda s: s > F.col("year_signed"))
    pool = values.groupBy("grp", "year_signed", "v").agg(F.count("*").alias("n")).select("grp", "v", "n", F.explode(later).alias("season"))
    wanted = asked.select("grp", "season", "v").distinct()
    line = pool.withColumn("asked", F.lit(0)).unionByName(wanted.select("grp", F.col("season").cast("long").alias("season"), "v", F.lit(0).cast("long").alias("n"), F.lit(1).alias("asked")))
    size = F.floor(F.log2(F.abs(F.col("v").cast("double"))) * 8)
    line = line.groupBy("grp", "season", "v").agg(F.sum("n").alias("n"), F.max("asked").alias("asked")).withColumn("range", F.when(F.col("v") > 0, size + 100_000).when(F.col("v") < 0, -size - 100_000).otherwise(F.lit(0)))
    inside = W.partitionBy("grp", "season", "range").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    placed = line.withColumn("in_range", F.coalesce(F.sum("n").over(inside), F.lit(0))).filter("asked = 1")
    before = W.partitionBy("grp", "season").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = line.groupBy("grp", "season", "range").agg(F.sum("n").alias("r")).select("grp", "season", "range", F.coalesce(F.sum("r").over(before), F.lit(0)).alias("earlier"), F.sum("r").over(W.partitionBy("grp", "season")).alias("of"))
    below = F.col("earlier") + F.col("in_range")
    return placed.join(ranges, ["grp", "season", "range"]).select("grp", "season", "v", below.alias("below"), (below + F.col("n")).alias("upto"), "of")


def contract_quality(wanted: DataFrame, contracts: DataFrame, players: DataFrame, keep: Keep = unkept) -> DataFrame:
    """wanted (player, grp, season, ...) with `worth`: half plus the mid-rank of the player's latest earlier contract among the group's.

    The rank is against the group asked for, which need not be the contract's own.
    """
    usable = contracts.filter("year_signed > 0 and apy_cap_pct is not null and gsis_id is not null")
    signed = usable.select(F.col("gsis_id").alias("player"), F.col("year_signed").alias("__y"), F.col("apy_cap_pct").alias("apy"))
    asked = wanted.select("player", "grp", "season").distinct()
    own = keep(OWN + "contracts", asof_join(asked, signed, ["player"], "season", "__y", ["apy"], ties=["apy"]))
    values = usable.select(group_of(F.col("position"), CONTRACT_POSITIONS).alias("grp"), "year_signed", F.col("apy_cap_pct").alias("v")).filter("grp is not null")
    ranks = mid_ranks(own.filter("apy is not null").select("grp", "season", F.col("apy").alias("v")), values).withColumnRenamed("v", "apy")
    info = players.select(F.col("gsis_id").alias("player"), roster_bucket(F.col("draft_round")).alias("bucket"))
    ranked = own.join(ranks, ["grp", "season", "apy"], "left").join(info, "player", "left")
    fixed = replaced(F.coalesce("bucket", F.lit("udfa")), CONTRACT_DEFAULT, F.lit(CONTRACT_DEFAULT["udfa"]))
    worth = F.when(F.col("of") > 0, 0.5 + (F.col("below") + F.col("upto")) / 2 / F.col("of")).otherwise(fixed)
    return wanted.join(ranked.select("player", "grp", "season", worth.alias("worth")), ["player", "grp", "season"])


def lineman_quality(wanted: DataFrame, sides: DataFrame, rows: DataFrame, history: DataFrame, players: DataFrame, params: AvailabilityParams) -> DataFrame:
    """wanted (game_id, team, player, grp) with `worth`: draft class times durability, the mean share over the team's last games with 0 for a missed one."""
    n = F.least(F.col("prior"), F.lit(DURABILITY_GAMES))
    ranges = sides.filter("prior is not null").select("game_id", "team", n.alias("games"), F.explode(F.sequence(F.col("prior") - n + 1, F.col("prior"))).alias("idx"))
    seen = rows.join(history.select("team", "game_id", "idx"), ["team", "game_id"]).select("team", "idx", "player", "off", "def")
    near = wanted.join(ranges, ["game_id", "team"]).join(seen, ["team", "idx", "player"], "left")
    share = F.when(F.col("grp").isin(*OFFENSE), F.col("off")).otherwise(F.col("def"))
    held = near.groupBy("game_id", "team", "player", "grp").agg((F.sum(F.coalesce(share, F.lit(0.0))) / F.max("games")).alias("durability"))
    info = players.select(F.col("gsis_id").alias("player"), roster_bucket(F.col("draft_round")).alias("bucket"))
    base = replaced(F.coalesce("bucket", F.lit("udfa")), params.lineman_quality, F.lit(params.lineman_quality["udfa"]))
    w = params.durability_weight
    return held.join(info, "player", "left").select("game_id", "team", "player", "grp", F.greatest(F.lit(0.0), base * (1 - w + w * F.col("durability"))).alias("worth"))


def availability(games: DataFrame, snaps: DataFrame, injuries: DataFrame, players: DataFrame, player_stats: DataFrame, contracts: DataFrame, params: AvailabilityParams = AvailabilityParams(), lookback: int = LOOKBACK, keep: Keep = unkept) -> DataFrame:
    """One row a game with {home,away}_{off_out,def_out,out_<group>}; null where the side's week was not reported, it has no
    earlier snaps, or the season has none.

    What does not depend on params is passed through keep: snaps, their games and sides.  Shares are added up only for the
    players that a report lists.
    """
    rows = keep("snap-rows", snap_rows(games, snaps, players))
    history = keep("snap-games", team_history(rows))
    both = F.inline(F.array(F.struct(F.lit("home").alias("side"), F.col("home_team").alias("team")), F.struct(F.lit("away").alias("side"), F.col("away_team").alias("team"))))
    sides = keep("snap-sides", games_before(games.select("game_id", "season", "week", "kickoff_utc", both), history))
    open_ = sides.filter((F.col("season") >= FIRST_SNAP_SEASON) & F.col("prior").isNotNull())
    gated = open_.join(reported_weeks(injuries), ["season", "week", "team"], "left_semi")
    listed = report_lists(injuries).filter("out or questionable" if params.questionable else "out")
    asked = open_.join(per_game(listed), ["season", "week", "team"])  # whoever is listed is reported
    cands = keep(f"candidates-{lookback}-{params.questionable}", candidates(asked, rows, history, lookback))
    out = asked.join(cands, ["game_id", "team", "player"])
    if params.questionable:
        rates = keep("miss-rates", miss_rates(questionable_cases(sides, cands, rows, injuries), games))
        out = out.withColumn("practice", F.coalesce("practice", F.lit("none"))).join(rates, ["season", "practice"], "left")
        out = out.withColumn("weight", F.when(F.col("out"), 1.0).otherwise(F.col("miss_rate")))
    else:
        out = out.withColumn("weight", F.lit(1.0))
    info = players.select(F.col("gsis_id").alias("player"), F.col("position").alias("listed_position")).dropDuplicates(["player"])
    out = out.join(info, "player", "left").withColumn("grp", F.coalesce(group_of(F.col("position")), group_of(F.col("listed_position"))))
    out = keep(f"absent-{params.questionable}", out.withColumn("share", F.when(F.col("grp").isin(*OFFENSE), F.col("off_avg")).otherwise(F.col("def_avg"))))
    if params.mode in ("values", *POOLED):
        wanted = out.filter(F.col("share") >= STARTER_SHARE).select("game_id", "team", "player", "grp", "season", "kickoff_utc")
        if params.mode == "values_contract":
            worth = contract_quality(wanted, contracts, players, keep=keep)
        else:
            worth = skill_quality(wanted.filter(F.col("grp").isin("wrte", "rb")), player_stats, games, params, keep).select("game_id", "team", "player", "worth")
            line = lineman_quality(wanted.filter(~F.col("grp").isin("wrte", "rb")).select("game_id", "team", "player", "grp"), gated, rows, history, players, params)
            worth = worth.unionByName(line.select("game_id", "team", "player", "worth"))
        out = out.join(keep(OWN + "worth", worth.select("game_id", "team", "player", "worth")), ["game_id", "team", "player"], "left")
    else:
        out = out.withColumn("worth", F.lit(1.0))

    def lost(share: str, group: str | None = None) -> Column:
        counts = F.col(share) >= STARTER_SHARE
        value = F.col("weight") * F.col(share)
        return F.sum(F.when(counts, value)) if group is None else F.sum(F.when(counts & (F.col("grp") == group), value * F.col("worth")))

    names = ["off_out", "def_out", *[f"out_{g}" for g in GROUPS]]
    sums = out.groupBy("game_id", "team").agg(lost("off_avg").alias("off_out"), lost("def_avg").alias("def_out"), *[lost("share", g).alias(f"out_{g}") for g in GROUPS])
    per_side = gated.select("game_id", "team", "side").join(sums, ["game_id", "team"], "left").fillna(0.0, names)
    wide = per_side.groupBy("game_id").agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in ("home", "away") for c in names])
    return games.select("game_id").join(wide, "game_id", "left")


def latest_share(rows: DataFrame, keys: list[str], order: str, share: str, n: int = LOOKBACK) -> DataFrame:
    """rows with the mean share over the n rows before each, per key."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-n, -1)
    return rows.withColumn("mean_share", F.avg(share).over(w)).withColumn("seen", F.count(share).over(w))
