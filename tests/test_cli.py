import json
from dataclasses import fields

import pytest
from pyspark.sql import functions as F

from fieldmark import cli
from fieldmark.models import production, tuning
from fieldmark.operators.features import PARTS
from fieldmark.sources.store import Store
from tests.synthetic import TEAMS, league


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("league"))
    data, venues = league(spark, seasons=(2010, 2011, 2012, 2013, 2014), unplayed_last_week=True)
    for f in fields(data):
        getattr(data, f.name).coalesce(1).write.parquet(f"{path}/{f.name}")
    venues.coalesce(1).write.parquet(f"{path}/venues")
    rows = [(t, "N" if k < 2 else "S", f"d{k}") for k, t in enumerate(TEAMS)]
    spark.createDataFrame(rows, "team string, conf string, division string").write.parquet(f"{path}/teams")
    return path


def test_commands_from_features_to_report(spark, folder):
    def run(*argv, now="2014-10-12T18:00:00"):
        cli.main(["--data", folder, "--team", "AAA", "--now", now, *argv], spark)

    store, lost = Store(spark, folder), "2014-09-08T17:00"  # an hour that the archive lacks
    asked = json.dumps({"hourly": {"time": [lost], "temperature_2m": [41.5], "wind_speed_10m": [3.0], "precipitation": [0.0]}})
    kept = store.write_table(spark.read.parquet(f"{folder}/weather").filter("time_utc not between timestamp'2014-09-08' and timestamp'2014-09-09'"), "weather")
    spark.createDataFrame([("V0", asked)], "stadium_id string, payload string").write.parquet(f"{folder}/archive_payloads")
    run("features")
    assert kept.filter("temp_f = 41.5").isEmpty() and spark.read.parquet(f"{folder}/features").filter("temp_f = 41.5 and weather_source = 'archive'").count() == 1
    assert spark.read.parquet(f"{folder}/features").count() == 60
    run("backtest", "--seasons", "2013", "2014")
    made = json.loads(open(f"{folder}/backtest.json").read())
    assert set(made["methods"]) == {"model", "home", "elo", "vegas"} and set(made["seasons"]) == {"2013", "2014"} and made["margin_mae"] > 0
    run("holdout", "--seasons", "2014")
    with pytest.raises(SystemExit):
        run("holdout", "--seasons", "2014")
    run("holdout", "--seasons", "2014", "--force")
    assert json.loads(open(f"{folder}/holdout.json").read())["previously_viewed"]
    run("retrain")
    for _ in range(2):  # a second run within the window adds nothing
        run("predict")
    told = spark.read.schema(cli.PREDICTION).json(f"{folder}/logs/predictions").collect()
    assert len(told) == 1 and told[0].run_type == "final_injury" and 0 < told[0].p < 1 and len(told[0].top_factors) == 6
    assert told[0].is_final_injury_report == (told[0].latest_injury_week == 6) and told[0].weather.source in ("archive", "climatology", "indoor") and (told[0].latest_injury_week or 1) >= 1
    for _ in range(2):
        run("predict-league")
    league = spark.read.schema(cli.LEAGUE).json(f"{folder}/logs/league_predictions").collect()
    assert len(league) == len({r.game_id for r in league}) > 0 and all(0 < r.p_home < 1 and 0 < r.p_elo_home < 1 and r.week for r in league)
    for _ in range(2):
        run("simulate", "--sims", "30")
    sims = spark.read.schema(cli.SNAPSHOT).json(f"{folder}/logs/season_sim").collect()
    assert len(sims) == 1 and sims[0].n_sims == 30 and 0 <= sims[0].p_playoffs <= 1
    run("wait-for-gameday", now="2014-10-14T00:00:00")
    run("report")
    assert spark.read.json(f"{folder}/report/scorecard").count() == 0 and set(store.names("report")) >= {"changes", "scorecard", "weekly", "outlook", "season_log"}
    record = spark.read.json(f"{folder}/report/record").head()
    assert record.wins + record.losses + record.ties == 5
    with pytest.raises(SystemExit):
        production.Model.load(Store(spark, folder), config=cli.ModelConfig(alpha=1.0))


def test_walk_forward_uses_only_the_past(spark, folder):
    frame = spark.read.parquet(f"{folder}/features")
    whole = {r.game_id: r.p_home for r in production.walk_forward(frame, [2013]).collect()}
    changed = frame.withColumn("margin", F.when(F.col("season") >= 2013, -F.col("margin")).otherwise(F.col("margin")))
    assert {r.game_id: pytest.approx(r.p_home) for r in production.walk_forward(changed, [2013]).collect()} == whole


@pytest.mark.parametrize("config", [{"distribution": "kernel", "platt": True, "ensemble_weight": 0.3}, {"kind": "trees", "trees": {"trees": 3, "leaves": 3, "least": 5}}])
def test_every_setting_of_the_config_counts(spark, folder, tmp_path, config):
    """Against a plain ridge the settings change what is predicted; a stored model predicts as the fitted one; contributions add up."""
    frame = spark.read.parquet(f"{folder}/features").filter("season < 2014").cache()
    config = cli.ModelConfig(inner_folds=1, **config)
    model = production.fit_model(frame, config)
    usual = {r.game_id: r.p_home for r in production.fit_model(frame).predict(frame).collect()}
    got = {r.game_id: (r.p_home, r.margin_lo, r.margin_hi, r.p_vegas or 0.5) for r in model.predict(frame).collect()}
    assert all(0 < p < 1 and lo <= hi and 0 < v < 1 for p, lo, hi, v in got.values()) and any(abs(got[g][0] - p) > 1e-6 for g, p in usual.items())
    store = Store(spark, str(tmp_path))
    model.save(store)
    again = production.Model.load(store, config=config)
    assert {r.game_id: pytest.approx((r.p_home, r.margin_lo, r.margin_hi, r.p_vegas or 0.5)) for r in again.predict(frame).collect()} == got
    base = again.regressor.expected() if config.kind == "trees" else again.regressor.intercept
    parts = again.predict(frame).limit(4).select("margin_home", sum(again.contributions().values(), F.lit(0.0)).alias("sum")).collect()
    assert all(r.margin_home == pytest.approx(base + r.sum) for r in parts)
    with pytest.raises(ValueError):
        cli.ModelConfig(kind="forest")


def test_folds_at_once_equal_single_fits(spark, folder):
    """What a walk-forward predicts of a season is what a model of the seasons before predicts, with every part of the model in use."""
    frame = spark.read.parquet(f"{folder}/features")
    config = cli.ModelConfig(inner_folds=2, distribution="kernel", platt=True, ensemble_weight=0.3)
    walked = {r.game_id: (r.p_home, r.margin_home, r.p_vegas or 0.5) for r in production.walk_forward(frame, [2014], config).collect()}
    single = production.fit_model(frame.filter("season < 2014"), config).predict(frame.filter("season = 2014 and margin is not null"))
    assert {r.game_id: pytest.approx((r.p_home, r.margin_home, r.p_vegas or 0.5), abs=1e-4) for r in single.collect()} == walked
    score = production.report(production.walk_forward(frame, [2013, 2014]), "AAA", draws=50)
    assert score["team"]["n"] == 11 and all(lo <= m["log_loss"] <= hi for m in score["methods"].values() for lo, hi in [m["log_loss_ci90"]])
    assert sum(b["n"] for b in score["methods"]["model"]["calibration"]) == score["methods"]["model"]["n"]


def test_feature_stages_build_only_what_they_change(spark, folder):
    f = cli.Folder(spark, folder, "AAA")
    f.store.delete("parts")  # those that earlier commands left
    parts = f.parts(cli.clock("2014-10-12T18:00:00"))
    stages = [tuning.Stage("passers", "passer", tuning.PASSERS[:2], fresh=True), tuning.Stage("altitude", "altitude", [{"altitude": True}])]
    seen = []

    def loss(frame):
        seen.append(frame.columns)
        return 0.7 - 0.1 * (len(seen) == 2) - 0.0001 * (len(seen) == 3)

    best, trials = tuning.tune_features(parts, [2013], stages=stages, loss=loss)
    assert best.passer.prior_dropbacks == 250.0 and not best.altitude and [t["stage"] for t in trials] == ["passers", "passers", "altitude", "altitude"] and len(seen) == 3
    assert sorted(k.split("-")[0] for k in parts.built) == sorted([*PARTS, "passers", "situation"])
    frame = parts.features(best)
    assert frame.select("away_altitude_gain_km").distinct().count() == 1
    f.store.write_json("features.json", cli.asdict(best))
    assert f.feature_params() == best
    f.store.delete("features.json")


def test_model_stages():
    def loss(c):
        return 0.6 + (c.kind == "ridge") * 0.0015 + abs(c.alpha - 300) * 1e-7 + abs(c.half_life - 6) * 1e-5 - 0.001 * (c.distribution == "kernel" and c.bandwidth == 2.0) - 0.001 * (c.ensemble_weight == 0.3) + 0.001 * c.platt

    best, trials = tuning.tune_model(None, [2013], loss=loss)
    assert (best.kind, best.alpha, best.half_life, best.distribution, best.bandwidth, best.ensemble_weight, best.platt) == ("ridge", 300.0, 6.0, "kernel", 2.0, 0.3, False)
    assert len(trials) == 18 + 3 + 2 + 1
    assert tuning.tune_model(None, [2013], loss=lambda c: 0.6 - 0.01 * (c.kind == "trees"))[0].kind == "trees"


def test_clock():
    assert cli.clock("2024-01-01T10:00:00").hour == 10 and cli.clock("2024-01-01T10:00:00+02:00").hour == 8
