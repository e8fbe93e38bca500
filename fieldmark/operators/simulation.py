"""Season simulation: every draw is a row, every ranking a window.

A draw is a hash of (simulation, game, seed), so a run is repeatable and needs no state.  Points are counted
in halves of a game as integers; tied win rates are equal exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RESOLUTION = 1 << 20
WILD_CARDS = 3


def draw(*parts: Column, seed: int = 0) -> Column:
    """An integer below RESOLUTION that the parts and the seed decide: two rounds of multiply and mix in 64-bit arithmetic."""
    x = F.lit(seed + 1).cast("long")
    for p in parts:
        x = F.pmod((x * 1_103_515_245 + p.cast("long") * 69_069 + 12_345), F.lit(2_147_483_647))
        x = F.pmod(x * 48_271, F.lit(2_147_483_647))
    return F.pmod(F.floor(x / 64), F.lit(RESOLUTION)).cast("long")


def outcomes(games: DataFrame, sims: int, seed: int = 0) -> DataFrame:
    """(sim, game_id, home_team, away_team, home_half, away_half): played games keep their result, others are drawn with p_home (0.5 where missing).

    games: game_id, game_no, the teams, margin, p_home, and base, the first number of its simulations, if several seasons are simulated.
    """
    first = F.col("base") if "base" in games.columns else F.lit(0)
    won = draw(F.col("sim"), F.col("game_no"), seed=seed) < F.floor(F.coalesce("p_home", F.lit(0.5)) * RESOLUTION)
    half = F.when(F.col("margin").isNull(), F.when(won, 2).otherwise(0)).when(F.col("margin") > 0, 2).when(F.col("margin") < 0, 0).otherwise(1)
    each = games.withColumn("sim", F.explode(F.sequence(first, first + sims - 1)))
    return each.withColumn("home_half", half).withColumn("away_half", 2 - F.col("home_half"))


def perspectives(results: DataFrame) -> DataFrame:
    """Two rows a result: (sim, team, opponent, half)."""
    pair = F.array(F.struct(F.col("home_team").alias("team"), F.col("away_team").alias("opponent"), F.col("home_half").alias("half")), F.struct(F.col("away_team").alias("team"), F.col("home_team").alias("opponent"), F.col("away_half").alias("half")))
    return results.select("sim", F.inline(pair))


def pairings(results: DataFrame) -> DataFrame:
    """(sim, a, b, half, n): all meetings of a pair added up, which is all that the rankings read; half is that of a, the lesser team."""
    a, b = F.least("home_team", "away_team"), F.greatest("home_team", "away_team")
    own = F.when(F.col("home_team") <= F.col("away_team"), F.col("home_half")).otherwise(F.col("away_half"))
    return results.groupBy("sim", a.alias("a"), b.alias("b")).agg(F.sum(own).alias("half"), F.count("*").alias("n"))


def rate(points: Column, games: Column) -> Column:
    return F.when(games > 0, points / games).otherwise(F.lit(1.0))


def standings(pairs: DataFrame, teams: DataFrame) -> DataFrame:
    """Per sim and team: halves, games, the rates overall, in the division and in the conference, and met, what there was against each opponent.

    Rates are of halves (1 is even).  Rows are laid by sim once; the grouping here and the windows of `ranked` need no further shuffle.
    """
    sides = F.array(
        F.struct(F.col("a").alias("team"), F.col("b").alias("opponent"), F.col("half").alias("half")),
        F.struct(F.col("b").alias("team"), F.col("a").alias("opponent"), (2 * F.col("n") - F.col("half")).alias("half")),
    )
    met = pairs.repartition("sim").select("sim", "n", F.inline(sides))
    a = F.broadcast(teams.select("team", "team_no", "conf", "division"))
    b = F.broadcast(teams.select(F.col("team").alias("opponent"), F.col("conf").alias("o_conf"), F.col("division").alias("o_division")))
    joined = met.join(a, "team").join(b, "opponent")
    in_div, in_conf = F.col("division") == F.col("o_division"), F.col("conf") == F.col("o_conf")

    def part(condition: Column) -> Column:
        return rate(F.coalesce(F.sum(F.when(condition, F.col("half"))), F.lit(0)), F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)))

    return joined.groupBy("sim", "team", "team_no", "conf", "division").agg(
        F.sum("half").alias("halves"), F.sum("n").alias("games"), rate(F.sum("half"), F.sum("n")).alias("pct"),
        part(in_div).alias("div_pct"), part(in_conf).alias("conf_pct"), F.collect_list(F.struct("opponent", "half", "n")).alias("met"),
    )


def ranked(table: DataFrame, scope: list[str], seed: int, name: str, chance: Column | None = None) -> DataFrame:
    """table (with met) with rank `name` from 1 within sim and scope: pct, head to head, division, conference, chance.

    Head to head is settled once over the whole tied group: the rate against all teams of the scope with the same pct, 1 where there
    was no such game.  A tied group and a team's opponents are as many as there are teams.
    """
    tied = table.withColumn("__tied", F.collect_set("team").over(W.partitionBy("sim", *scope, "pct")))
    level = F.filter("met", lambda m: (m.opponent != F.col("team")) & F.array_contains("__tied", m.opponent))

    def total(field: str) -> Column:
        return F.aggregate(level, F.lit(0).cast("long"), lambda s, m: s + m[field])

    luck = draw(F.col("sim"), F.col("team_no"), seed=seed + 7) if chance is None else chance
    w = W.partitionBy("sim", *scope).orderBy(F.desc("pct"), F.desc("__h2h"), F.desc("div_pct"), F.desc("conf_pct"), F.desc(luck), "team")
    return tied.withColumn("__h2h", rate(total("half"), total("n"))).withColumn(name, F.row_number().over(w)).drop("__tied", "__h2h")


def seeding(games: DataFrame, teams: DataFrame, sims: int, seed: int = 0, conference: Column | None = None) -> DataFrame:
    """Per sim and team: halves, division winner, seed among winners, wild card.

    teams: team, team_no, conf, division.  Only `conference` is ranked, if one is given.
    """
    table = standings(pairings(outcomes(games, sims, seed)), teams)
    if conference is not None:
        table = table.filter(F.col("conf") == conference)
    table = ranked(table, ["conf", "division"], seed, "division_rank").withColumn("winner", F.col("division_rank") == 1)
    # winners and others are ranked apart in each conference
    table = ranked(table, ["conf", "winner"], seed, "conf_rank")
    return table.drop("met").withColumns({"seed": F.when(F.col("winner"), F.col("conf_rank")), "wild_card": ~F.col("winner") & (F.col("conf_rank") <= WILD_CARDS)})


def summary(seeded: DataFrame, team: Column) -> DataFrame:
    """One row: mean, p10, p50, p90 of wins, chances of playoffs, division and top seed."""
    own = seeded.filter(F.col("team") == team)
    wins = F.col("halves") / 2
    return own.agg(
        F.avg(wins).alias("wins_mean"), *[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY halves / 2)").alias(n) for n, q in (("wins_p10", 0.1), ("wins_p50", 0.5), ("wins_p90", 0.9))],
        F.avg((F.col("winner") | F.col("wild_card")).cast("double")).alias("p_playoffs"), F.avg(F.col("winner").cast("double")).alias("p_division"), F.avg((F.coalesce(F.col("seed"), F.lit(0)) == 1).cast("double")).alias("p_top_seed"),
    )


def win_distribution(seeded: DataFrame, team: Column) -> DataFrame:
    """(wins, prob): half a win rounds up."""
    own = seeded.filter(F.col("team") == team).groupBy(F.floor(F.col("halves") / 2 + 0.5).alias("wins")).agg(F.count("*").alias("n"))
    return own.select("wins", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("prob"))


def remaining_probabilities(games: DataFrame, model: DataFrame, elo: DataFrame) -> DataFrame:
    """(game_id, p_home) of games without a result: the model's, else the rating's, else even."""
    left = games.filter("margin is null").select("game_id")
    known = left.join(model.select("game_id", F.col("p_home").alias("__m")), "game_id", "left").join(elo.select("game_id", F.col("p_elo").alias("__e")), "game_id", "left")
    return known.select("game_id", F.coalesce("__m", "__e", F.lit(0.5)).alias("p_home"))
