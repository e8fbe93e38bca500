"""The production model: recency-weighted ridge or trees, a margin distribution from out-of-fold errors, a classifier's share, Platt scaling; walk-forward scores.

A fold is told by its cutoff, the first season it does not know.  What an outer fold predicts is what later folds
call out of fold, so a walk-forward fits one model for each cutoff, predicts each season once into a stored table,
and reads every distribution and scaling off that table.  Plans do not grow with the number of folds: coefficients,
widths and trees are looked up by season.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.expressions import outcome
from fieldmark.models import evaluation
from fieldmark.models.margins import GaussianMargin, KernelMargin, Margin, answers, kernel_cells, margin_of
from fieldmark.models.regression import Logistic, ModelConfig, Moments, Ridge, fit_logistic, fit_ridge, logit, newton_logistic, season_moments
from fieldmark.models.trees import TreeParams, Trees, fit_folds
from fieldmark.operators.contests import elo_win_probability
from fieldmark.operators.features import FEATURE_COLUMNS
from fieldmark.operators.logs import scorecard
from fieldmark.sources.store import Store

FIRST_TRAIN, BACKTEST, HOLDOUT, LEAST_SEASONS = 2009, tuple(range(2012, 2024)), (2024, 2025), 2


def recency(config: ModelConfig, reference: int) -> Column:
    return F.pow(F.lit(0.5), (F.lit(reference) - F.col("season")) / F.lit(float(config.half_life)))


def tree_params(config: ModelConfig) -> TreeParams:
    return TreeParams(**config.trees)


@dataclass
class Model:
    """What a fit leaves: the regressor, the distribution of margins around it, and what adjusts the probability."""

    regressor: Ridge | Trees
    dist: Margin
    vegas: Margin | None
    config: ModelConfig
    features: list[str]
    last_season: int
    classifier: Logistic | None = None
    platt: Logistic | None = None
    trained: list[int] = field(default_factory=list)

    def predict(self, features: DataFrame) -> DataFrame:
        """features with margin, probability, an 80 % interval, and the market's probability (null without a spread)."""
        told = features.withColumn("margin_home", self.regressor.predict())
        told = told.withColumn("__a", answers({0: self.dist}, F.lit(0), F.col("margin_home")))
        p, w = F.col("__a.p"), self.config.ensemble_weight
        if self.classifier:
            p = (1 - w) * p + w * self.classifier.column()
        told = told.withColumn("p_home", p)
        if self.platt:
            told = told.withColumn("p_home", self.platt.column({"logit": logit(F.col("p_home"))}))
        vegas = answers({0: self.vegas}, F.lit(0), F.col("spread_line")).getField("p") if self.vegas else F.lit(None).cast("double")
        return told.withColumns({"margin_lo": F.col("__a.low"), "margin_hi": F.col("__a.high"), "p_vegas": vegas}).drop("__a")

    def contributions(self) -> dict[str, Column]:
        """Each feature's points, from the mean game of the training rows."""
        return self.regressor.contributions()

    def to_dict(self) -> dict:
        kept = {"config": asdict(self.config), "features": self.features, "last_season": self.last_season, "trained": self.trained, "fingerprint": self.config.fingerprint()}
        kept |= {k: v and v.to_dict() for k, v in (("dist", self.dist), ("vegas", self.vegas))} | {k: v and asdict(v) for k, v in (("classifier", self.classifier), ("platt", self.platt))}
        r = self.regressor
        if isinstance(r, Ridge):
            return kept | {"ridge": {"mean": r.mean.tolist(), "scale": r.scale.tolist(), "coefficient": r.coefficient.tolist(), "intercept": r.intercept}}
        return kept | {"trees": r.to_dict()}

    def save(self, store: Store, name: str = "model.json") -> None:
        store.write_json(name, self.to_dict())

    @staticmethod
    def load(store: Store, name: str = "model.json", config: ModelConfig | None = None, features: Sequence[str] = FEATURE_COLUMNS) -> Model:
        """The stored model; SystemExit where it was fitted under another config or feature list."""
        k = store.read_json(name)
        own = ModelConfig(**k["config"])
        if (config is not None and config != own) or list(features) != k["features"]:
            raise SystemExit("the stored model does not match the configuration or the features; retrain")
        parts = {p: k[p] and margin_of(k[p]) for p in ("dist", "vegas")} | {p: k[p] and Logistic(**k[p]) for p in ("classifier", "platt")}
        r = k.get("ridge")
        regressor = Ridge(k["features"], np.array(r["mean"]), np.array(r["scale"]), np.array(r["coefficient"]), r["intercept"]) if r else Trees.of(k["trees"])
        return Model(regressor, parts["dist"], parts["vegas"], own, k["features"], k["last_season"], parts["classifier"], parts["platt"], k["trained"])


def inner_seasons(known: Sequence[int], before: int, config: ModelConfig) -> list[int]:
    """The seasons whose out-of-fold predictions a fold with that cutoff looks at."""
    return sorted(s for s in known if s < before)[LEAST_SEASONS:][-config.inner_folds :]


@dataclass
class Folds:
    """Regressors and classifiers by cutoff."""

    regressor: dict[int, Ridge | Trees]
    classifier: dict[int, Logistic]
    features: list[str]

    def told(self, rows: DataFrame) -> DataFrame:
        """rows of the cutoffs' seasons with margin_home and p_class by the fold that ends just before them."""
        season = F.col("season").cast("int")
        kept = rows.filter(season.isin([int(s) for s in self.regressor]))
        if all(isinstance(r, Ridge) for r in self.regressor.values()):
            margin = linear({s: (r.coefficient / r.scale, r.intercept - float((r.coefficient / r.scale) @ r.mean)) for s, r in self.regressor.items()}, season, self.features)
        else:
            margin = F.lit(None).cast("double")
            for s, r in self.regressor.items():
                margin = F.when(season == int(s), r.predict()).otherwise(margin)
        chance = F.lit(0.0)
        if self.classifier:
            score = linear({s: (np.array(c.coefficient) / c.scale, c.intercept - float((np.array(c.coefficient) / c.scale) @ np.array(c.mean))) for s, c in self.classifier.items()}, season, self.features)
            chance = 1 / (1 + F.exp(-score))
        return kept.withColumns({"margin_home": margin, "p_class": chance})


def linear(models: Mapping[int, tuple[np.ndarray, float]], key: Column, features: Sequence[str]) -> Column:
    """intercept + coefficients x features, of the model that the key names; one expression whatever the number of models."""
    table = F.create_map(*[F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)) for k, (b, a) in models.items() for v in (int(k), [float(a), *map(float, b)])])
    x = F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features])
    return F.aggregate(F.zip_with(F.element_at(table, key), x, lambda b, v: b * v), F.lit(0.0), lambda a, v: a + v)


def fit_cutoffs(rows: DataFrame, moments: Mapping[int, Moments], config: ModelConfig, cutoffs: Sequence[int], features: Sequence[str] = FEATURE_COLUMNS) -> Folds:
    """A regressor and, where it counts, a classifier of the rows before each cutoff, weighed from the season before it."""
    references = {c: max((s for s in moments if s < c), default=c - 1) if c > max(moments) else c - 1 for c in cutoffs}
    if config.kind == "ridge":
        regressor = {c: fit_ridge({s: m for s, m in moments.items() if s < c}, features, config.alpha, config.half_life, references[c]) for c in cutoffs}
    else:
        weights = F.array(*[F.when(F.col("season") < c, recency(config, references[c])).otherwise(0.0) for c in cutoffs])
        regressor = dict(zip(cutoffs, fit_folds(rows, features, "margin", weights, len(cutoffs), tree_params(config)), strict=True))
    classifier = {}
    if config.ensemble_weight > 0:
        for c in cutoffs:
            weighed = rows.filter(F.col("season") < c).withColumns({"__w": recency(config, references[c]), "__y": outcome(F.col("margin"))})
            classifier[c] = fit_logistic(weighed, features, "__y", config.classifier_c, "__w")
    return Folds(regressor, classifier, list(features))


def distributions(rows: DataFrame, predicted: str, spans: Mapping[int, Sequence[int]], config: ModelConfig) -> dict[int, Margin]:
    """For each key, the distribution of the margins around `predicted` over the seasons of its span; keys without rows are left out."""
    known = rows.filter(F.col(predicted).isNotNull() & F.col("margin").isNotNull())
    if config.distribution == "kernel":
        cells = kernel_cells(known, predicted, "margin", config.bandwidth, ("season",)).collect()  # as many as margins and cells, not rows
        own = {k: [r for r in cells if r.season in set(span)] for k, span in spans.items()}
        return {k: KernelMargin.from_rows(r, config.bandwidth) for k, r in own.items() if r}
    error = F.pow(F.col("margin") - F.col(predicted), 2)
    per = {r.season: r for r in known.groupBy("season").agg(F.sum(error).alias("e"), F.count("*").alias("n")).collect()}
    out = {}
    for k, span in spans.items():
        e, n = sum(per[s].e for s in span if s in per), sum(per[s].n for s in span if s in per)
        if n and e > 0:
            out[k] = GaussianMargin(float(np.sqrt(e / n)))
    return out


def scalings(told: DataFrame, dists: Mapping[int, Margin], spans: Mapping[int, Sequence[int]], config: ModelConfig) -> dict[int, Logistic]:
    """Platt scaling of each key's probability over its span, all keys at once."""
    pairs = F.explode(F.array(*[F.struct(F.lit(int(k)).alias("fold"), F.array(*map(F.lit, map(int, span))).alias("span")) for k, span in spans.items()])).alias("s")
    rows = told.select("season", "margin", "margin_home", "p_class", pairs).filter(F.array_contains("s.span", F.col("season").cast("int")))
    p = answers(dists, F.col("s.fold"), F.col("margin_home")).getField("p")
    w = config.ensemble_weight
    x = logit((1 - w) * p + w * F.col("p_class"))
    return newton_logistic(rows.select(F.col("s.fold").alias("fold"), x.alias("x"), outcome(F.col("margin")).alias("y")), c=1e6)


def finished(df: DataFrame) -> DataFrame:
    return df.filter((F.col("season") >= FIRST_TRAIN) & F.col("margin").isNotNull())


def _check(known: Sequence[int]) -> None:
    if len(known) <= LEAST_SEASONS:
        raise ValueError("a model needs more than two seasons")


def fit_model(df: DataFrame, config: ModelConfig = ModelConfig(), features: Sequence[str] = FEATURE_COLUMNS) -> Model:
    """A model of all finished rows from FIRST_TRAIN on."""
    own = Store.temporary(df.sparkSession, "fit")
    rows = own.write_table(finished(df), "rows")
    moments = season_moments(rows, features, "margin")
    _check(list(moments))
    end = max(moments) + 1
    inner = inner_seasons(list(moments), end, config)
    folds = fit_cutoffs(rows, moments, config, [*inner, end], features)
    told = own.write_table(folds.told(rows), "told")
    spans = {0: inner}
    dists = distributions(told, "margin_home", spans, config)
    vegas = distributions(rows, "spread_line", {0: list(moments)}, config) if "spread_line" in rows.columns else {}
    platt = scalings(told, dists, spans, config) if config.platt else {}
    own.delete()
    return Model(folds.regressor[end], dists[0], vegas.get(0), config, list(features), max(moments), folds.classifier.get(end), platt.get(0), sorted(moments))


def walk_forward(df: DataFrame, seasons: Sequence[int] = BACKTEST, config: ModelConfig = ModelConfig(), features: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """Finished rows of the seasons, each predicted by a model of the seasons before, with p_home, p_elo, p_rate and p_vegas."""
    own = Store.temporary(df.sparkSession, "walk")
    rows = own.write_table(finished(df), "rows")
    moments = season_moments(rows, features, "margin")
    wanted = [s for s in sorted(set(seasons)) if s in moments and len([k for k in moments if k < s]) > LEAST_SEASONS]
    if not wanted:
        raise ValueError("no season has more than two seasons before it")
    spans = {s: inner_seasons(list(moments), s, config) for s in wanted}
    cutoffs = sorted({*wanted, *(k for span in spans.values() for k in span)})
    folds = fit_cutoffs(rows, moments, config, cutoffs, features)
    told = own.write_table(folds.told(rows), "told")
    dists = distributions(told, "margin_home", spans, config)
    vegas = distributions(rows, "spread_line", {s: [k for k in moments if k < s] for s in wanted}, config)
    season = F.col("season").cast("int")
    at = told.filter(season.isin(wanted)).withColumn("__a", answers(dists, season, F.col("margin_home")))
    w = config.ensemble_weight
    at = at.withColumn("p_home", (1 - w) * F.col("__a.p") + w * F.col("p_class") if w else F.col("__a.p"))
    if config.platt:
        fitted = scalings(told, dists, spans, config)
        scaled = linear({s: (np.array(m.coefficient) / m.scale, m.intercept - float((np.array(m.coefficient) / m.scale) @ np.array(m.mean))) for s, m in fitted.items()}, season, ["__x"])
        at = at.withColumn("__x", logit(F.col("p_home"))).withColumn("p_home", 1 / (1 + F.exp(-scaled))).drop("__x")
    market = answers(vegas, season, F.col("spread_line")).getField("p") if vegas else F.lit(None).cast("double")
    rate = evaluation.home_rate(rows).withColumnRenamed("p_home", "__rate")
    elo = elo_win_probability(F.col("elo_home_pre") - F.col("elo_away_pre"), F.col("neutral"))
    made = {"margin_lo": F.col("__a.low"), "margin_hi": F.col("__a.high"), "p_vegas": market, "p_elo": elo, "p_rate": F.when(F.col("neutral"), 0.5).otherwise(F.col("__rate")), "y": outcome(F.col("margin"))}
    return at.join(rate, "season", "left").withColumns(made).drop("__a", "__rate").filter("p_home is not null")


def walk_forward_loss(df: DataFrame, seasons: Sequence[int], config: ModelConfig, features: Sequence[str] = FEATURE_COLUMNS) -> float:
    return float(walk_forward(df, seasons, config, features).agg(evaluation.log_loss(F.col("p_home"), F.col("y")).alias("l")).head().l)


METHODS = {"model": "p_home", "elo": "p_elo", "home": "p_rate", "vegas": "p_vegas"}


def report(predictions: DataFrame, team: str | None = None, draws: int = 300) -> dict:
    """Metrics of the four methods over the rows that all have, each with a 90 % interval of its log loss and its calibration; per season; of one team's games."""
    known = predictions if predictions.filter("p_vegas is not null").limit(1).collect() else predictions.withColumn("p_vegas", F.col("p_home"))
    common = known.filter(" and ".join(f"{c} is not null" for c in METHODS.values()))
    cards = {r.method: r.asDict() for r in scorecard(common, {c: c for c in METHODS.values()}).collect()}
    losses = {c: evaluation.log_loss_of(F.col(c), F.col("y")) for c in METHODS.values()}
    spread = {r.metric: (r.low, r.high) for r in evaluation.bootstrap(common, losses, "game_id", draws).collect()}
    methods = {}
    for name, c in METHODS.items():
        bins = [r.asDict() for r in evaluation.calibration(common, c, "y").orderBy("bin").collect()]
        methods[name] = {k: v for k, v in cards[c].items() if k != "method"} | {"log_loss_ci90": spread[c], "calibration": bins}
    error = evaluation.mean_absolute_error(F.col("margin_home"), F.col("margin")).alias("margin_mae")
    methods["model"]["margin_mae"] = common.agg(error).head().margin_mae
    kept = evaluation.summary(common, "p_home", "y", ("season",)).join(common.groupBy("season").agg(error), "season").orderBy("season")
    out = {"methods": methods, "seasons": {r.season: r.asDict() for r in kept.collect()}, "margin_mae": methods["model"]["margin_mae"]}
    if team is not None:
        home = F.col("home_team") == team
        own = common.filter(home | (F.col("away_team") == team)).select(F.when(home, F.col("p_home")).otherwise(1 - F.col("p_home")).alias("p"), F.when(home, F.col("y")).otherwise(1 - F.col("y")).alias("y"))
        out["team"] = evaluation.summary(own, "p", "y").head().asDict()
    return out
