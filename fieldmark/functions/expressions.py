"""Column expressions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_MILES = 3958.8
PPF_90 = 1.2815515655446004  # the standard normal's 0.9 quantile
#: Ten equal bins of [0, 1] by their exact double edges; k / 10 is not the same as k * 0.1.
BIN_EDGES = tuple(k * 0.1 for k in range(11))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for a row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def flag(condition: Column) -> Column:
    """1 / 0, null where the condition is null."""
    return condition.cast("long")


def outcome(margin: Column) -> Column:
    """1 for a win, 0 for a loss, 0.5 for a tie; null for no result."""
    return F.when(margin > 0, 1.0).when(margin < 0, 0.0).when(margin == 0, 0.5)


def logistic_share(diff: Column, scale: float = 400.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), -diff / F.lit(scale)))


def normal_cdf(x: Column, terms: int = 100) -> Column:
    """The standard normal distribution function by its power series, for |x| clamped at 8."""
    x = clip(x.cast("double"), -8.0, 8.0)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.struct(x.alias("s"), x.alias("t")),
        lambda a, k: F.struct((a.s + a.t * x * x / (2 * k + 1)).alias("s"), (a.t * x * x / (2 * k + 1)).alias("t")),
        lambda a: a.s,
    )
    return F.lit(0.5) + F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * series


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_MILES * F.asin(F.sqrt(a))


def digitize(p: Column, edges: Iterable[float] = BIN_EDGES) -> Column:
    """How many edges are at or below p, less one, kept inside the bins."""
    edges = list(edges)
    below = reduce(lambda a, b: a + b, [F.when(p >= e, 1).otherwise(0) for e in edges])
    return F.greatest(F.least(below, F.lit(len(edges) - 1)), F.lit(1)) - 1


def not_finite(columns: Iterable[str]) -> Column:
    """Whether any of the columns is null, NaN or infinite."""

    def bad(name: str) -> Column:
        c = F.col(name).cast("double")
        return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))

    return reduce(lambda a, b: a | b, map(bad, columns))


def sum_ignoring_nulls(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])


def replaced(value: Column, mapping: Mapping[str, object], default: Column | None = None) -> Column:
    """mapping's value, else default, else the value itself."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.element_at(table, value), value if default is None else default)


def practice_bucket(status: Column) -> Column:
    """dnp / limited / full by how a practice report starts, else null."""
    s = F.lower(F.trim(status))
    return F.when(s.startswith("did not"), "dnp").when(s.startswith("limited"), "limited").when(s.startswith("full"), "full")


def starter_bucket(draft_round: Column) -> Column:
    """Three draft classes of a first-choice passer; an unknown round is the last."""
    return F.when(draft_round == 1, "round_1").when(draft_round.isin(2, 3), "day_2").otherwise("day_3_udfa")


def roster_bucket(draft_round: Column) -> Column:
    """Four draft classes of the other players."""
    return F.when(draft_round.isNull(), "udfa").when(draft_round == 1, "round_1").when(draft_round.isin(2, 3), "day_2").otherwise("later")


def utc_offset_hours(at: Column, zone: Column) -> Column:
    """The zone's offset from UTC at a UTC instant."""
    return (F.unix_seconds(F.from_utc_timestamp(at, zone)) - F.unix_seconds(at)) / F.lit(3600.0)


def recency_weight(season: Column, reference: int, half_life: float) -> Column:
    return F.pow(F.lit(0.5), (F.lit(reference) - season) / F.lit(float(half_life)))


def differences(names: Iterable[str], first: str = "home_", second: str = "away_") -> list[Column]:
    """first minus second for each name."""
    return [(F.col(first + n) - F.col(second + n)).alias(f"{n}_diff") for n in names]
