"""Weighted ridge regression from per-season moments, and logistic regressions.

A recency weight depends on the season alone, so one aggregate of moments per season is enough to fit every
walk-forward fold: folds are weighted sums of at most a few dozen blocks, and the rows are read once.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from hashlib import sha1

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.functions.expressions import recency_weight
from fieldmark.sources.store import Store


def gram(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str] = ("season",)) -> DataFrame:
    """Per key: n, sum of y and y*y, and arrays of the sums of x, x*y and the upper triangle of x*x'; one pass, partial sums on the map side."""
    x = [F.col(c).cast("double") for c in features]
    y = F.col(target).cast("double")
    pairs = [x[i] * x[j] for i in range(len(x)) for j in range(i, len(x))]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), F.array(*map(F.sum, x)).alias("sx"), F.array(*[F.sum(a * y) for a in x]).alias("sxy"), F.array(*map(F.sum, pairs)).alias("sxx"))


@dataclass
class Moments:
    """The moments of one season; additive."""

    n: float
    sy: float
    syy: float
    sx: np.ndarray
    sxy: np.ndarray
    sxx: np.ndarray

    @staticmethod
    def of(row, k: int) -> Moments:
        full = np.zeros((k, k))
        full[np.triu_indices(k)] = row.sxx
        return Moments(row.n, row.sy, row.syy, np.array(row.sx), np.array(row.sxy), full + np.triu(full, 1).T)

    def scaled(self, w: float) -> Moments:
        return Moments(self.n * w, self.sy * w, self.syy * w, self.sx * w, self.sxy * w, self.sxx * w)

    def __add__(self, o: Moments) -> Moments:
        return Moments(self.n + o.n, self.sy + o.sy, self.syy + o.syy, self.sx + o.sx, self.sxy + o.sxy, self.sxx + o.sxx)


def season_moments(df: DataFrame, features: Sequence[str], target: str) -> dict[int, Moments]:
    return {r.season: Moments.of(r, len(features)) for r in gram(df, features, target).collect()}


@dataclass
class Ridge:
    """intercept + sum of (x - mean) / scale * coefficient."""

    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    coefficient: np.ndarray
    intercept: float

    def predict(self) -> Column:
        """One product of arrays; a sum of as many terms as features makes Catalyst's constraints grow without bound."""
        b = self.coefficient / self.scale
        x = F.array(*[F.col(f).cast("double") for f in self.features])
        given = F.array(*[F.lit(float(v)) for v in b])
        return F.aggregate(F.zip_with(given, x, lambda c, v: c * v), F.lit(float(self.intercept - b @ self.mean)), lambda a, v: a + v)

    def contributions(self) -> dict[str, Column]:
        """Each feature's scaled value times its coefficient."""
        return {f: (F.col(f).cast("double") - float(m)) / float(s) * float(c) for f, m, s, c in zip(self.features, self.mean, self.scale, self.coefficient, strict=True)}

    def squared_error(self, m: Moments) -> float:
        """The sum of squared errors over the rows behind moments, without the rows."""
        b = self.coefficient / self.scale
        a = self.intercept - float(b @ self.mean)
        return m.syy - 2 * (a * m.sy + b @ m.sxy) + a * a * m.n + 2 * a * b @ m.sx + b @ m.sxx @ b


def fit_ridge(seasons: dict[int, Moments], features: Sequence[str], alpha: float, half_life: float | None, reference: int) -> Ridge:
    """Ridge with recency weights; columns are scaled by unweighted population deviations, the intercept is not penalised."""
    plain = sum(list(seasons.values())[1:], list(seasons.values())[0])
    mean = plain.sx / plain.n
    var = np.maximum(np.diag(plain.sxx) / plain.n - mean**2, 0)
    scale = np.where(var > 1e-12 * np.maximum(1, mean**2), np.sqrt(var), 1.0)
    parts = [m.scaled(1.0 if half_life is None else 0.5 ** ((reference - s) / half_life)) for s, m in seasons.items()]
    m = sum(parts[1:], parts[0])
    # moments of z = (x - mean) / scale
    sz = (m.sx - m.n * mean) / scale
    szz = (m.sxx - np.outer(mean, m.sx) - np.outer(m.sx, mean) + m.n * np.outer(mean, mean)) / np.outer(scale, scale)
    szy = (m.sxy - mean * m.sy) / scale
    zc, yc = sz / m.n, m.sy / m.n
    a = szz - m.n * np.outer(zc, zc) + alpha * np.eye(len(scale))
    w = np.linalg.solve(a, szy - m.n * zc * yc)
    return Ridge(list(features), mean, scale, w, float(yc - zc @ w))


def walk_forward_ridge(df: DataFrame, features: Sequence[str], target: str, seasons: Sequence[int], alpha: float = 300.0, half_life: float | None = 12.0) -> tuple[DataFrame, dict[int, Ridge]]:
    """Predictions of each season's rows by a model of all earlier seasons; rows are read for the moments and for scoring only."""
    moments = season_moments(df.filter(F.col(target).isNotNull()), features, target)
    models = {s: fit_ridge({k: m for k, m in moments.items() if k < s}, features, alpha, half_life, s - 1) for s in seasons if any(k < s for k in moments)}
    predicted = F.when(F.lit(False), F.lit(0.0))
    for s, model in models.items():
        predicted = predicted.when(F.col("season") == s, model.predict())
    return df.filter(F.col("season").isin(list(models))).withColumn("predicted_margin", predicted), models


def weighted_quantile(weights: DataFrame, key: str, value: str, weight: str, q: float) -> DataFrame:
    """(key, quantile): the first value in order whose cumulative weight reaches the share q."""
    per = weights.groupBy(key, value).agg(F.sum(weight).alias("w"))
    run = F.sum("w").over(W.partitionBy(key).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("w").over(W.partitionBy(key))
    return per.withColumn("cdf", run / total).filter(F.col("cdf") >= q).groupBy(key).agg(F.min(value).alias("quantile"))


def expanded_outcomes(df: DataFrame, y: str, weight: str | None = None) -> DataFrame:
    """Each row as (label 1, weight * y) and (label 0, weight * (1 - y)), without weight 0: soft outcomes for a hard classifier."""
    w = F.col(weight) if weight else F.lit(1.0)
    pair = F.array(F.struct(F.lit(1.0).alias("label"), (w * F.col(y)).alias("w")), F.struct(F.lit(0.0).alias("label"), (w * (1 - F.col(y))).alias("w")))
    return df.select("*", F.inline(pair)).filter("w > 0")


@dataclass
class Logistic:
    """A logistic regression on scaled features."""

    features: list[str]
    mean: list[float]
    scale: list[float]
    coefficient: list[float]
    intercept: float

    def column(self, values: dict[str, Column] | None = None) -> Column:
        """The probability; values has the features that are no columns of that name."""
        x = values or {f: F.col(f).cast("double") for f in self.features}
        b = np.array(self.coefficient) / np.array(self.scale)
        given = F.array(*[F.lit(float(v)) for v in b])
        start = F.lit(float(self.intercept - b @ np.array(self.mean)))
        return 1 / (1 + F.exp(-F.aggregate(F.zip_with(given, F.array(*[x[f] for f in self.features]), lambda c, v: c * v), start, lambda a, v: a + v)))


def fit_logistic(df: DataFrame, features: Sequence[str] | dict[str, Column], y: str, c: float = 1.0, weight: str | None = None) -> Logistic:
    """L2 logistic regression on soft outcomes with penalty 1 / (c * total weight).

    Features are columns or named expressions of df, scaled beforehand by their population deviations.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    x = features if isinstance(features, dict) else {f: F.col(f) for f in features}
    stats = df.agg(*[F.avg(v).alias(f"m_{f}") for f, v in x.items()], *[F.stddev_pop(v).alias(f"s_{f}") for f, v in x.items()]).head()
    mean, scale = [float(stats[f"m_{f}"]) for f in x], [float(stats[f"s_{f}"]) or 1.0 for f in x]
    scaled = {f"__{f}": (v - m) / s for (f, v), m, s in zip(x.items(), mean, scale, strict=True)}
    rows = expanded_outcomes(df, y, weight).withColumns(scaled)
    total = rows.agg(F.sum("w")).head()[0]
    vectors = VectorAssembler(inputCols=list(scaled), outputCol="__x").transform(rows)
    model = LogisticRegression(featuresCol="__x", labelCol="label", weightCol="w", regParam=1 / (c * total), standardization=False).fit(vectors)
    return Logistic(list(x), mean, scale, [float(k) for k in model.coefficients], float(model.intercept))


def fit_classifier(df: DataFrame, features: Sequence[str] | dict[str, Column], y: str, c: float = 1.0, weight: str | None = None) -> Column:
    """The probability of fit_logistic as a column."""
    return fit_logistic(df, features, y, c, weight).column(features if isinstance(features, dict) else None)


def logit(p: Column) -> Column:
    clipped = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(clipped / (1 - clipped))


def newton_logistic(rows: DataFrame, c: float, rounds: int = 30, tolerance: float = 1e-10) -> dict[int, Logistic]:
    """For each fold of (fold, x, y): a logistic regression of y on x, scaled, with penalty 1 / (c * rows), by Newton's method.

    Every round is one grouping by fold, whatever the number of folds; five sums a fold reach the driver.
    """
    stats = {r.fold: r for r in rows.groupBy("fold").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count("*").alias("n")).collect()}
    fit = {k: np.zeros(2) for k in stats}
    scale = {k: float(r.s) or 1.0 for k, r in stats.items()}
    for _ in range(rounds):
        table = F.create_map(*[F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)) for k in fit for v in (int(k), [float(fit[k][0]), float(fit[k][1]), float(stats[k].m), scale[k]])])
        given = rows.withColumn("__b", F.element_at(table, F.col("fold").cast("int")))
        z = (F.col("x") - F.col("__b")[2]) / F.col("__b")[3]
        p = 1 / (1 + F.exp(-(F.col("__b")[0] + F.col("__b")[1] * z)))
        told = given.select("fold", z.alias("z"), (p - F.col("y")).alias("e"), (p * (1 - p)).alias("v"))
        got = told.groupBy("fold").agg(F.sum("e").alias("g0"), F.sum(F.col("e") * F.col("z")).alias("g1"), F.sum("v").alias("h00"), F.sum(F.col("v") * F.col("z")).alias("h01"), F.sum(F.col("v") * F.col("z") * F.col("z")).alias("h11")).collect()
        moved = 0.0
        for r in got:
            penalty = 1 / c
            g = np.array([r.g0, r.g1 + penalty * fit[r.fold][1]])
            step = np.linalg.lstsq(np.array([[r.h00, r.h01], [r.h01, r.h11 + penalty]]), g, rcond=None)[0]
            step *= min(1.0, 5.0 / max(1e-300, float(np.abs(step).max())))
            fit[r.fold] = fit[r.fold] - step
            moved = max(moved, float(np.abs(step).max()))
        if moved < tolerance:
            break
    return {k: Logistic(["logit"], [float(stats[k].m)], [scale[k]], [float(fit[k][1])], float(fit[k][0])) for k in fit}


def fit_platt(df: DataFrame, p: str, y: str) -> Column:
    """A logistic rescaling of a probability's logit; the fitted probability as a column."""
    return fit_classifier(df, {"logit": logit(F.col(p))}, y, c=1e6)


def weighted_mean(value: str, season: str, reference: int, half_life: float) -> Column:
    w = recency_weight(F.col(season), reference, half_life)
    return F.sum(w * F.col(value)) / F.sum(w)


@dataclass(frozen=True)
class ModelConfig:
    """What identifies a model; unknown keys of a stored one are refused, missing ones take their default."""

    kind: str = "ridge"
    alpha: float = 300.0
    half_life: float = 12.0
    distribution: str = "gaussian"
    platt: bool = False
    inner_folds: int = 6
    features: dict = field(default_factory=dict)
    bandwidth: float = 2.0
    ensemble_weight: float = 0.0
    classifier_c: float = 0.1
    trees: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in ("ridge", "trees") or self.distribution not in ("gaussian", "kernel"):
            raise ValueError(f"unknown kind or distribution: {self.kind}, {self.distribution}")

    def fingerprint(self) -> str:
        return sha1(json.dumps(self.__dict__, sort_keys=True).encode()).hexdigest()[:8]

    def save(self, store: Store, name: str = "config.json") -> None:
        store.write_json(name, self.__dict__)

    @staticmethod
    def load(store: Store, name: str = "config.json") -> ModelConfig:
        return ModelConfig(**store.read_json(name))


def coordinate_descent(grids: dict[str, Sequence], score, start: dict, margin: float = 3e-4) -> tuple[dict, list[tuple[dict, float]]]:
    """Tune one parameter after another; a challenger has to win by `margin`.  score(params) is a loss."""
    best, loss = dict(start), score(start)
    trials = [(dict(best), loss)]
    for name, values in grids.items():
        for value in values:
            if value == best[name]:
                continue
            tried = best | {name: value}
            got = score(tried)
            trials.append((tried, got))
            if got < loss - margin:
                best, loss = tried, got
    return best, trials
