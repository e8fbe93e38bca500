"""Point-in-time building blocks: what was known strictly before, or at, a moment.

Every operator partitions by an equality key first and orders inside it, so range conditions never become
a nested loop over two tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def per_game(df: DataFrame) -> DataFrame:
    """df, whose rows grow with the games, as a side of a join that is shuffled.

    Spark takes the size of stored columns packed in files for their size in memory: millions of rows whose columns are
    constant would look small enough to be sent whole through the driver.
    """
    return df.hint("merge")


def running_before(df: DataFrame, keys: Sequence[str], order: str, sums: Mapping[str, Column]) -> DataFrame:
    """df with running sums over the rows of the same keys whose `order` (an integer) is strictly smaller; 0 where there is none.

    Rows at the same moment never see each other.
    """
    w = W.partitionBy(*keys).orderBy(order).rangeBetween(W.unboundedPreceding, -1)
    return df.withColumns({k: F.coalesce(F.sum(c).over(w), F.lit(0).cast("double")) for k, c in sums.items()})


def known_seasons(seasons: DataFrame, season: str = "season") -> list[int]:
    """The seasons, which are few."""
    return sorted(r[0] for r in seasons.select(season).distinct().filter(F.col(season).isNotNull()).collect())


def every_season(keys: DataFrame, seasons: DataFrame, season: str = "season") -> DataFrame:
    """keys with a row for each of the seasons, which are few and go with the plan."""
    return keys.withColumn(season, F.explode(F.array(*map(F.lit, known_seasons(seasons, season))).cast(f"array<{seasons.schema[season].dataType.simpleString()}>")))


def expanding_before(totals: DataFrame, keys: Sequence[str], season: str, seasons: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For each key and each of `seasons`: the totals of all strictly earlier seasons, 0 where there is none."""
    dense = every_season(totals.select(*keys).distinct(), seasons, season) if keys else seasons.select(season).distinct()
    dense = dense.join(totals, [*keys, season], "left")
    w = W.partitionBy(*keys).orderBy(season).rangeBetween(W.unboundedPreceding, -1)
    return dense.select(*keys, season, *[F.coalesce(F.sum(c).over(w), F.lit(0).cast("double")).alias(c) for c in columns])


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, values: Sequence[str], strict: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    """left with `values` of the latest right row of the same keys before left_time (at or before it, if not strict).

    One shuffle on the keys: both sides are stacked and the last right row is carried forward.  Right rows of
    one moment are taken in order of `ties`, the last wins.
    """
    entry = F.struct(*[F.col(v).alias(v) for v in values])
    stacked_left = left.select(*on, F.col(left_time).alias("__t"), F.lit(1 - strict).alias("__side"), *[F.lit(None).cast(right.schema[t].dataType).alias(f"__k{i}") for i, t in enumerate(ties)], F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(entry.alias("e")).schema["e"].dataType).alias("__right"))
    stacked_right = right.select(*on, F.col(right_time).alias("__t"), F.lit(int(strict)).alias("__side"), *[F.col(t).alias(f"__k{i}") for i, t in enumerate(ties)], F.lit(None).cast(stacked_left.schema["__left"].dataType).alias("__left"), entry.alias("__right"))
    w = W.partitionBy(*on).orderBy("__t", "__side", *[f"__k{i}" for i in range(len(ties))]).rowsBetween(W.unboundedPreceding, 0)
    carried = stacked_left.unionByName(stacked_right).withColumn("__last", F.last("__right", ignorenulls=True).over(w))
    return carried.filter(F.col("__left").isNotNull()).select("__left.*", *[F.col(f"__last.{v}").alias(v) for v in values])


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The values of each key's last row, by one aggregate with map-side combine (nulls of that row stay null)."""
    best = F.max_by(F.struct(*values), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__b")).select(*keys, "__b.*")


def earliest(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    best = F.min_by(F.struct(*values), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__b")).select(*keys, "__b.*")


def indexed(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "idx") -> DataFrame:
    """df with a dense number from 1 within the keys."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def last_n(df: DataFrame, keys: Sequence[str], order: str, n: int, aggregates: Mapping[str, Column]) -> DataFrame:
    """df with aggregates over the n rows before each row of the same keys."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-n, -1)
    return df.withColumns({k: c.over(w) for k, c in aggregates.items()})


def nearest_fill(known: DataFrame, wanted: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, at, value) for each wanted (key, at): the value of the nearest known `at` of the key, the later one of two as near.

    Two carried values (the last at or before, the first at or after) replace a join on distance.
    """
    both = wanted.select(key, at).distinct().join(known.select(key, at, value), [key, at], "full")
    entry = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("at"), F.col(value).alias("v")))
    before = F.last(entry, ignorenulls=True).over(W.partitionBy(key).orderBy(at).rowsBetween(W.unboundedPreceding, 0))
    after = F.first(entry, ignorenulls=True).over(W.partitionBy(key).orderBy(at).rowsBetween(0, W.unboundedFollowing))
    found = both.withColumn("__b", before).withColumn("__a", after)
    nearer = F.when(F.col("__b").isNull(), F.col("__a.v")).when(F.col("__a").isNull(), F.col("__b.v")).when(F.col("__a.at") - F.col(at) <= F.col(at) - F.col("__b.at"), F.col("__a.v")).otherwise(F.col("__b.v"))
    return found.select(key, at, nearer.alias(value)).join(wanted.select(key, at).distinct(), [key, at], "left_semi")


def hour_grid(df: DataFrame, at: Column, hours: int, name: str = "hour") -> DataFrame:
    """A row for each of the `hours` hours from the hour of `at` on: a range join becomes an equality join."""
    start = F.date_trunc("hour", at)
    return df.withColumn(name, F.explode(F.sequence(start, start + F.expr(f"INTERVAL '{hours - 1}' HOUR"), F.expr("INTERVAL '1' HOUR"))))


def most_common(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Each key's most frequent value; of equally frequent ones that seen first in `order`."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("__n"), F.min(F.struct(*order)).alias("__first"))
    w = W.partitionBy(*keys).orderBy(F.desc("__n"), "__first")
    return counted.withColumn("__r", F.row_number().over(w)).filter("__r = 1").select(*keys, value)
