"""Tuning by walk-forward log loss: stages of feature settings over stored parts, then the model's settings.

A feature trial makes the parts that its setting changes and joins them to the stored others, so a stage costs its
own part for each challenger.  Candidates come simplest first: a later one has to win by its margin.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame

from fieldmark.models.production import walk_forward_loss
from fieldmark.models.regression import ModelConfig
from fieldmark.operators.features import FeatureParams, Parts

# fixed values: what a challenger has to win by, of features and of trees against a ridge
TIE, LINEAR = 3e-4, 0.002
# fixed values: the settings that each stage tries, in order
RATINGS = [
    *[{"prior_regression": 0.6, "prior_games": 6.0, "prior_games_new_coach": 2.0, "opponent_adjust": a, "extra_stats": e} for a in (False, True) for e in (False, True)],
    {"prior_regression": 0.5, "prior_games": 4.0, "prior_games_new_coach": 2.0, "opponent_adjust": True, "extra_stats": True},
    {"prior_regression": 0.7, "prior_games": 6.0, "prior_games_new_coach": 3.0, "opponent_adjust": True, "extra_stats": True},
    {"prior_regression": 0.6, "prior_games": 4.0, "prior_games_new_coach": 2.0, "opponent_adjust": True, "extra_stats": True},
    {"prior_regression": 0.6, "prior_games": 6.0, "prior_games_new_coach": 2.0, "opponent_adjust": False, "extra_stats": True, "special_teams": True},
]
PASSERS = [{"prior_dropbacks": k} for k in (150.0, 250.0, 400.0)]
FLAT_LINE = {"round_1": 1.0, "day_2": 1.0, "later": 1.0, "udfa": 1.0}
AVAILABILITY = [
    {"mode": "count_diff"},
    {"mode": "values_pooled", "prior_opps": 90.0, "quality_scale": 2.0},
    {"mode": "values_pooled", "prior_opps": 90.0, "quality_scale": 6.0},
    {"mode": "values_pooled", "prior_opps": 30.0, "quality_scale": 4.0},
    {"mode": "values_pooled", "lineman_quality": FLAT_LINE, "durability_weight": 0.0},
    {"mode": "groups"},
    {"mode": "values", "prior_opps": 90.0, "quality_scale": 2.0},
    {"mode": "count_diff", "questionable": True},
    {"mode": "values_contract"},
    {"mode": "values_contract", "questionable": True},
]
MODELS = {
    "ridge": [{"kind": "ridge", "alpha": a} for a in (10.0, 100.0, 300.0, 1000.0)],
    "trees": [
        {"kind": "trees", "trees": {"leaves": 4, "trees": 200, "rate": 0.03, "least": 50, "l2": 5.0}},
        {"kind": "trees", "trees": {"leaves": 8, "trees": 300, "rate": 0.02, "least": 80, "l2": 10.0}},
    ],
}
HALF_LIVES = (3.0, 6.0, 12.0)
DISTRIBUTIONS = [{"distribution": "gaussian", "bandwidth": 2.0}, *[{"distribution": "kernel", "bandwidth": h} for h in (1.0, 2.0, 4.0)]]
ENSEMBLES, PLATT = (0.0, 0.3, 0.5), (False, True)


@dataclass(frozen=True)
class Stage:
    """A group of settings and its candidates; without `fresh` the incumbent stays unless one wins by a margin."""

    name: str
    group: str
    candidates: Sequence[dict]
    fresh: bool = False

    def margin(self, settings: dict) -> float:
        """What a candidate has to win by: nothing among ratings but for special teams, TIE elsewhere."""
        return TIE if self.group != "rating" or settings.get("special_teams") else 0.0


STAGES = [
    Stage("ratings", "rating", RATINGS, fresh=True),
    Stage("passers", "passer", PASSERS, fresh=True),
    Stage("availability", "available", AVAILABILITY),
    Stage("altitude", "altitude", [{"altitude": True}]),
]


def changed(params: FeatureParams, stage: Stage, settings: dict) -> FeatureParams:
    if stage.group == "altitude":
        return replace(params, **settings)
    kind = type(getattr(params, stage.group))
    return replace(params, **{stage.group: kind(**settings)})


def tune_features(parts: Parts, seasons: Sequence[int], start: FeatureParams = FeatureParams(), config: ModelConfig = ModelConfig(), stages: Sequence[Stage] = STAGES, loss: Callable[[DataFrame], float] | None = None) -> tuple[FeatureParams, list[dict]]:
    """The best settings, one stage after the other, and every trial with its loss."""
    measure = loss or (lambda frame: walk_forward_loss(frame, seasons, config))
    trials: list[dict] = []
    known: dict[str, float] = {}

    def tried(stage: Stage, params: FeatureParams) -> float:
        key = str(params)
        if key not in known:
            known[key] = measure(parts.features(params))
        value = getattr(params, stage.group)
        trials.append({"stage": stage.name, "settings": asdict(value) if not isinstance(value, bool) else value, "log_loss": known[key]})
        return known[key]

    best = start
    for stage in stages:
        least = None if stage.fresh else tried(stage, best)
        for settings in stage.candidates:
            challenger = changed(best, stage, settings)
            got = tried(stage, challenger)
            if least is None or got < least - stage.margin(settings):
                best, least = challenger, got
    return best, trials


def tune_model(frame: DataFrame, seasons: Sequence[int], models: dict[str, Sequence[dict]] = MODELS, half_lives: Sequence[float] = HALF_LIVES, loss: Callable[[ModelConfig], float] | None = None, start: ModelConfig = ModelConfig()) -> tuple[ModelConfig, list[dict]]:
    """Family, its settings and half-life; then distribution, the classifier's share and Platt scaling.  Trees have to beat a ridge by LINEAR."""
    measure = loss or (lambda config: walk_forward_loss(frame, seasons, config))
    trials: list[dict] = []

    def tried(config: ModelConfig) -> float:
        got = measure(config)
        trials.append({"config": asdict(config), "log_loss": got})
        return got

    first: dict[str, tuple[ModelConfig, float]] = {}
    for kind, grid in models.items():
        for settings in grid:
            for half_life in half_lives:
                config = replace(start, half_life=half_life, distribution="gaussian", bandwidth=2.0, platt=False, ensemble_weight=0.0, **settings)
                got = tried(config)
                if kind not in first or got < first[kind][1]:
                    first[kind] = config, got
    best, least = first["ridge"] if "ridge" in first else next(iter(first.values()))
    if "trees" in first and "ridge" in first and first["trees"][1] < least - LINEAR:
        best, least = first["trees"]
    stages = [DISTRIBUTIONS, [{"ensemble_weight": w} for w in ENSEMBLES], [{"platt": p} for p in PLATT]]
    for candidates in stages:
        at = best
        for settings in candidates:
            config = replace(at, **settings)
            if config == at:
                continue
            got = tried(config)
            if got < least:
                best, least = config, got
    return best, trials
