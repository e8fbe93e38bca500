"""Probability metrics as aggregates, and walk-forward evaluation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.functions.expressions import clip, digitize


def log_loss_of(p: Column, y: Column) -> Column:
    q = clip(p, 1e-12, 1 - 1e-12)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def log_loss(p: Column, y: Column) -> Column:
    return F.avg(log_loss_of(p, y))


def brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y, 2))


def accuracy(p: Column, y: Column) -> Column:
    """Ties do not count; an even chance is worth half a hit; null where nothing is left."""
    hit = F.when(p == 0.5, 0.5).otherwise(((p > 0.5) == (y > 0.5)).cast("double"))
    return F.avg(F.when(y != 0.5, hit))


def mean_absolute_error(predicted: Column, actual: Column) -> Column:
    return F.avg(F.abs(predicted - actual))


def summary(df: DataFrame, p: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    a, b = F.col(p), F.col(y)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), log_loss(a, b).alias("log_loss"), brier(a, b).alias("brier"), accuracy(a, b).alias("accuracy"))


def calibration(df: DataFrame, p: str, y: str) -> DataFrame:
    """(bin, n, mean_p, mean_y) of the ten bins that are not empty."""
    return df.groupBy(digitize(F.col(p)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))


def cumulative(df: DataFrame, p: str, y: str, order: str) -> DataFrame:
    """(order, n, log_loss) of all rows up to each value of `order`: totals for each value first, then one short running sum."""
    per = df.groupBy(order).agg(F.sum(log_loss_of(F.col(p), F.col(y))).alias("s"), F.count("*").alias("c"))
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return per.select(order, F.sum("c").over(w).alias("n"), (F.sum("s").over(w) / F.sum("c").over(w)).alias("log_loss"))


def bootstrap(df: DataFrame, losses: Mapping[str, Column], key: str, draws: int = 300, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(metric, low, high) of each mean loss under a Poisson bootstrap: a row counts in a draw as often as a hash of (row, draw) says.

    One pass keeps every draw's weighted sums for all losses; no row is repeated.  A task hands on as many rows
    as there are draws and losses.
    """
    names = list(losses)
    ready = df.select(F.xxhash64(key).alias("h"), *[losses[n].cast("double").alias(f"l{i}") for i, n in enumerate(names)])
    cuts = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])  # Poisson(1) by its distribution function

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weighted, count = np.zeros((draws, len(names))), np.zeros((draws, len(names)))
        salt = (np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
        for b in batches:
            for at in range(0, len(b), 4096):
                some = b.iloc[at : at + 4096]
                x = some["h"].to_numpy(np.int64).astype(np.uint64)[None, :] ^ salt
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                times = np.searchsorted(cuts, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53), side="right")
                values = some[[f"l{i}" for i in range(len(names))]].to_numpy(float)
                known = ~np.isnan(values)
                weighted += times @ np.where(known, values, 0.0)
                count += times @ known
        d, m = np.indices(weighted.shape)
        yield pd.DataFrame({"draw": d.ravel(), "metric": m.ravel(), "s": weighted.ravel(), "n": count.ravel()})

    per = ready.mapInPandas(run, "draw int, metric int, s double, n double").groupBy("metric", "draw").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0.0))).alias("value"))
    named = F.element_at(F.array(*map(F.lit, names)), F.col("metric") + 1)
    return per.groupBy(named.alias("metric")).agg(F.percentile("value", low).alias("low"), F.percentile("value", high).alias("high"))


def home_rate(df: DataFrame) -> DataFrame:
    """(season, p_home): the share of home wins on non-neutral ground in strictly earlier seasons."""
    per = df.filter(~F.col("neutral") & F.col("margin").isNotNull()).groupBy("season").agg(F.sum(F.when(F.col("margin") > 0, 1.0).when(F.col("margin") == 0, 0.5).otherwise(0.0)).alias("s"), F.count("*").alias("c"))
    w = W.orderBy("season").rangeBetween(W.unboundedPreceding, -1)
    return per.select("season", (F.sum("s").over(w) / F.sum("c").over(w)).alias("p_home"))
