import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.models import evaluation as E
from fieldmark.models import margins as M
from fieldmark.models import regression as R
from fieldmark.sources import tables as T
from fieldmark.sources.store import Store
from fieldmark.streaming import logs as stream_logs


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(0)
    rows = []
    for s in range(2009, 2016):
        for k in range(80):
            x = rng.normal(size=3)
            rows.append((f"{s}_{k}", s, float(x[0]), float(x[1] * 5 + 100), 1.0, float(round(4 * x[0] + 3 * x[1] + rng.normal() * 6)), bool(k % 9 == 0)))
    return spark.createDataFrame(rows, "game_id string, season int, a double, b double, c double, margin double, neutral boolean").cache()


def plain_ridge(rows, alpha, half_life, reference):
    x = np.array([[r.a, r.b, r.c] for r in rows])
    y = np.array([r.margin for r in rows])
    w = 0.5 ** ((reference - np.array([r.season for r in rows])) / half_life)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-12] = 1
    z = (x - mean) / scale
    zc, yc = (w[:, None] * z).sum(0) / w.sum(), (w * y).sum() / w.sum()
    coef = np.linalg.solve(((z - zc) * w[:, None]).T @ (z - zc) + alpha * np.eye(3), ((z - zc) * w[:, None]).T @ (y - yc))
    return lambda r: float(((np.array([r.a, r.b, r.c]) - mean) / scale) @ coef + yc - zc @ coef)


def test_walk_forward_ridge_equals_the_closed_form(frame):
    out, _ = R.walk_forward_ridge(frame, ["a", "b", "c"], "margin", [2012, 2015], alpha=30.0, half_life=4.0)
    rows = frame.collect()
    for s in (2012, 2015):
        f = plain_ridge([r for r in rows if r.season < s], 30.0, 4.0, s - 1)
        for r in out.filter(F.col("season") == s).collect():
            assert r.predicted_margin == pytest.approx(f(r), abs=1e-7)


def test_errors_from_moments(frame):
    m = R.season_moments(frame, ["a", "b", "c"], "margin")
    model = R.fit_ridge({s: v for s, v in m.items() if s < 2014}, ["a", "b", "c"], 10.0, 6.0, 2013)
    want = sum((r.margin - r.p) ** 2 for r in frame.filter("season = 2014").withColumn("p", model.predict()).collect())
    assert model.squared_error(m[2014]) == pytest.approx(want, rel=1e-7)


def test_classifier_and_platt(spark, frame):
    df = frame.withColumn("y", F.when(F.col("margin") > 0, 1.0).when(F.col("margin") < 0, 0.0).otherwise(0.5))
    p = df.withColumn("p", R.fit_classifier(df, ["a", "b"], "y", c=0.5)).select("a", "b", "y", "p").toPandas()
    x = p[["a", "b"]].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    w, b = np.zeros(2), 0.0
    for _ in range(60):  # Newton's method on the same objective
        q = 1 / (1 + np.exp(-(z @ w + b)))
        a = np.c_[z, np.ones(len(z))]
        g = a.T @ (q - p.y.to_numpy()) + np.r_[w / 0.5, 0]
        h = (a * (q * (1 - q))[:, None]).T @ a + np.diag([2.0, 2.0, 0])
        step = np.linalg.solve(h, g)
        w, b = w - step[:2], b - step[2]
    assert np.allclose(p.p, 1 / (1 + np.exp(-(z @ w + b))), atol=1e-4)
    scaled = df.withColumn("p", F.lit(1) / (1 + F.exp(-F.col("a") * 3)))
    better = scaled.withColumn("q", R.fit_platt(scaled, "p", "y")).agg(E.log_loss(F.col("p"), F.col("y")).alias("before"), E.log_loss(F.col("q"), F.col("y")).alias("after")).head()
    assert better.after <= better.before + 1e-9


def test_kernel_and_quantile(spark):
    train = spark.createDataFrame([(0.0, 3), (0.0, -3), (0.0, 0), (0.0, 7)], "predicted double, margin int")
    test = spark.createDataFrame([("g", 0.0)], "game_id string, predicted double")
    assert M.kernel_probability(test, train, 5.0).head().p_win == pytest.approx(0.625)
    w = spark.createDataFrame([("t", 1, 1.0), ("t", 2, 1.0), ("t", 3, 2.0)], "k string, v int, w double")
    assert [R.weighted_quantile(w, "k", "v", "w", q).head().quantile for q in (0.25, 0.5, 0.51, 1.0)] == [1, 2, 3, 3]


@pytest.mark.parametrize("bandwidth", [1.0, 2.5])
def test_kernel_equals_all_weights(spark, bandwidth):
    """Every training row weighed, with predictions between, beside and far outside the known ones."""
    rng = np.random.default_rng(4)
    pred = np.r_[rng.normal(2, 6, 500), 30.0, 30.0]
    actual = np.round(pred + rng.normal(0, 12, 502))
    train = spark.createDataFrame([(float(p), int(a)) for p, a in zip(pred, actual, strict=True)] + [(1.0, None), (None, 3)], "predicted double, margin int")
    x = [0.0, 0.05, -7.3, 11.0, 24.0, 35.0, -40.0, None]
    z2 = ((pred[None] - np.array(x[:-1])[:, None]) / bandwidth) ** 2
    w = np.exp(-0.5 * (z2 - z2.min(1, keepdims=True)))
    w /= w.sum(1, keepdims=True)
    order = np.argsort(actual, kind="stable")
    cdf = np.cumsum(w[:, order], axis=1)
    want = [(float(w[k] @ (actual > 0) + 0.5 * w[k] @ (actual == 0)), float(actual[order][np.argmax(cdf[k] >= 0.1)]), float(actual[order][np.argmax(cdf[k] >= 0.9)])) for k in range(len(x) - 1)]
    dist = M.margin_of(json.loads(json.dumps(M.KernelMargin.of(train, "predicted", "margin", bandwidth).to_dict())))
    test = spark.createDataFrame([(k, v, 5 + k % 2) for k, v in enumerate(x)], "k int, x double, season int")
    got = {r.k: r.a for r in test.select("k", M.answers({5: dist, 6: dist}, F.col("season"), F.col("x")).alias("a")).collect()}
    assert [pytest.approx(tuple(got[k]), abs=1e-10) for k in range(len(want))] == want and got[7].p is None
    mixed = test.select("k", M.answers({5: dist}, F.col("season"), F.col("x")).alias("a")).collect()
    assert all((r.a.p is None) == (r.k % 2 == 1 or r.k == 7) for r in mixed)


def test_newton_equals_the_estimator(spark, frame):
    rows = frame.select(F.col("season").alias("fold"), (F.col("a") * 2 + 1).alias("x"), F.when(F.col("margin") > 0, 1.0).when(F.col("margin") < 0, 0.0).otherwise(0.5).alias("y"))
    got = R.newton_logistic(rows, 10.0)
    assert set(got) == set(range(2009, 2016))
    one = R.fit_logistic(rows.filter("fold = 2012"), {"v": F.col("x")}, "y", 10.0)
    assert (got[2012].coefficient[0], got[2012].intercept) == pytest.approx((one.coefficient[0], one.intercept), abs=1e-4)


def test_metrics(spark):
    df = spark.createDataFrame([(0.5, 1.0), (0.9, 1.0), (0.2, 0.5), (0.3, 0.0)], "p double, y double")
    r = E.summary(df, "p", "y").head()
    assert r.accuracy == pytest.approx((0.5 + 1 + 1) / 3) and r.brier == pytest.approx((0.25 + 0.01 + 0.09 + 0.09) / 4)
    only = E.summary(df.filter("y = 0.5"), "p", "y").head()
    assert only.accuracy is None
    with_id = df.withColumn("id", F.monotonically_increasing_id())
    b = E.bootstrap(with_id, {"brier": F.pow(F.col("p") - F.col("y"), 2)}, "id", 50).head()
    assert b.metric == "brier" and 0 <= b.low <= b.high <= 0.25


def test_bootstrap_draws_like_resampling(spark):
    """Against numpy's resampling of the same losses; nothing is repeated in the plan, and parts of the rows add up."""
    rng = np.random.default_rng(1)
    loss = rng.exponential(size=3000)
    df = spark.createDataFrame([(f"g{k}", float(v), float(2 * v)) for k, v in enumerate(loss)], "game_id string, a double, b double").repartition(3)
    out = E.bootstrap(df, {"a": F.col("a"), "b": F.col("b")}, "game_id", 400)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.metric: (r.low, r.high) for r in out.collect()}
    means = [loss[rng.integers(0, 3000, 3000)].mean() for _ in range(400)]
    assert got["a"] == pytest.approx(tuple(np.quantile(means, [0.05, 0.95])), abs=0.01) and got["b"] == pytest.approx(tuple(2 * v for v in got["a"]))
    assert {r.metric: pytest.approx((r.low, r.high)) for r in E.bootstrap(df.coalesce(1), {"a": F.col("a"), "b": F.col("b")}, "game_id", 400).collect()} == got


def test_config_round_trip(spark, tmp_path):
    c, store = R.ModelConfig(alpha=10.0), Store(spark, str(tmp_path / "deep" / "er"))
    c.save(store)
    assert R.ModelConfig.load(store) == c and len(c.fingerprint()) == 8 and c.fingerprint() != R.ModelConfig().fingerprint()
    best, trials = R.coordinate_descent({"x": [0, 1, 2], "y": [0, 5]}, lambda p: abs(p["x"] - 2) + abs(p["y"] - 4), {"x": 0, "y": 0})
    assert best == {"x": 2, "y": 5} and len(trials) == 4


def test_store_writes_whole_or_not_at_all(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write_text("a.json", "{}")
    store.write_json("a.json", {"x": "é"})
    assert store.read_json("a.json") == {"x": "é"} and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["a.json"]
    with pytest.raises(FileNotFoundError):
        store.read_text("b.json")
    bad = spark.range(3).select(F.assert_true(F.col("id") < 2, "broken").alias("x"))
    with pytest.raises(Exception, match="broken"):
        store.keep("t", bad)
    assert not store.exists("t")
    kept = store.keep("t", spark.range(3))
    assert kept.count() == 3 and store.keep("t", spark.range(9)).count() == 3
    assert store.write_table(spark.range(5), "t").count() == 5
    store.delete("t")
    assert not store.exists("t")


def test_venues_are_checked(spark, tmp_path):
    head = "stadium_id,name,lat,lon,tz,roof_default,elevation_m\n"
    (tmp_path / "ok.csv").write_text(head + "A,a,1,2,UTC,dome,3\n")
    assert T.venues(spark, str(tmp_path / "ok.csv")).count() == 1
    (tmp_path / "bad.csv").write_text(head + "A,a,1,2,UTC,tent,3\n")
    with pytest.raises(ValueError):
        T.venues(spark, str(tmp_path / "bad.csv"))


def test_season_tables_and_cache(spark, tmp_path):
    path = str(tmp_path / "qb")
    rows = [("g", s, "T", "q", 1, 1.0, 1.0, 1) for s in (2001, 2012, 2013)]
    df = spark.createDataFrame(rows, T.schema("qb_games"))
    T.write_seasons(df, path)
    T.write_seasons(df.filter("season = 2013").withColumn("dropbacks", F.lit(9).cast("long")), path)
    got = {r.season: r.dropbacks for r in T.read_seasons(spark, path, "qb_games", [2001, 2012, 2013]).collect()}
    assert got == {2012: 1, 2013: 9}

    def fail():
        raise OSError("no network")

    new = str(tmp_path / "new")
    assert T.read_through(spark, new, "teams", fail, empty_on_error=True).count() == 0 and not T.has_schema(spark, new, "teams")
    with pytest.raises(OSError):
        T.read_through(spark, new, "teams", fail)
    T.read_through(spark, new, "teams", lambda: spark.createDataFrame([("A", "N", "n", 1)], "team string, conf string, division string, more int"))
    assert T.read_through(spark, new, "teams", fail).columns == ["team", "conf", "division"]
    from datetime import datetime as D

    assert T.stale_seasons({2012: D(2013, 3, 1), 2013: D(2014, 1, 2)}, {2012: D(2013, 2, 1), 2013: D(2014, 1, 1)}, 2014) == [2013, 2014]


def test_logs_tolerate_only_a_broken_last_line(spark, tmp_path):
    ok = tmp_path / "ok.jsonl"
    ok.write_text('{"game_id": "a", "p": 0.5}\n\n{"game_id": "b", "p": 0.25}\n{"game_id": "c", "p"')
    assert sorted((r.game_id, r.p) for r in T.read_log(spark, str(ok), "game_id string, p double").collect()) == [("a", 0.5), ("b", 0.25)]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"game_id": "a"\n{"game_id": "b", "p": 0.25}\n')
    with pytest.raises(ValueError):
        T.read_log(spark, str(bad), "game_id string, p double").collect()
    df = spark.createDataFrame([("a", 1)], "b string, a int")
    T.append_log(df, str(tmp_path / "log"), ["a", "b"])
    T.append_log(df, str(tmp_path / "log"), ["a", "b"])
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    with pytest.raises(ValueError):
        T.append_log(df, str(tmp_path / "log"), ["a"])


def test_stream_keeps_first_records(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [{"game_id": "a", "at": "2024-01-01T00:00:00Z"}, {"game_id": "a", "at": "2024-01-01T01:00:00Z"}, {"game_id": "b", "at": "2024-01-02T00:00:00Z"}]
    (source / "1.json").write_text("\n".join(map(json.dumps, rows)))
    stream = stream_logs.first_records(stream_logs.log_stream(spark, str(source), "game_id string, at timestamp"), ["game_id"], "at")
    q = stream_logs.append_to(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert sorted(r.game_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
