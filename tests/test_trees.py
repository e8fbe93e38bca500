import itertools
import json
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.models import trees as T

NAMES = ["a", "b", "c", "d"]
PARAMS = T.TreeParams(leaves=4, trees=5, rate=0.2, least=8, l2=1.0, rows=0.8, columns=0.75, bins=16)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=400), rng.integers(0, 5, 400), rng.normal(size=400), rng.integers(0, 2, 400)])
    y = 3 * x[:, 0] + 2 * (x[:, 1] > 2) * x[:, 3] + rng.normal(size=400)
    data = [(f"g{k}", int(2000 + k % 8), float(y[k]), *[None if k % 37 == 0 and j == 2 else float(v) for j, v in enumerate(x[k])]) for k in range(400)]
    return spark.createDataFrame(data, "game_id string, season long, margin double, a double, b double, c double, d double").repartition(3).cache()


def plain_fit(bins, y, w, hashes, params, fold):
    """Best-first boosting by sums over masks, one leaf after the other."""
    base = float((w * y).sum() / w.sum())
    pred, out = np.full(len(y), base), []
    for t in range(params.trees):
        bag = T.drawn(hashes, t, params) & (w > 0)
        allowed = T.columns_of(t, fold, bins.shape[1], params)
        leaves = {0: np.ones(len(y), bool)}
        made, nxt = [], 1

        def best(mask):
            m = mask & bag
            g, h = (w * (pred - y))[m], w[m]
            found = None
            for f in allowed:
                for cut in range(bins.max() + 1):
                    low = bins[m, f] <= cut
                    if low.sum() < params.least or (~low).sum() < params.least:
                        continue
                    s = lambda k: g[k].sum() ** 2 / (h[k].sum() + params.l2)
                    gain = s(low) + s(~low) - s(np.ones(len(g), bool))
                    if gain > 1e-12 and (found is None or gain > found[0] + 1e-9):
                        found = (gain, f, cut)
            return found

        known = {0: best(leaves[0])}
        while len(leaves) < params.leaves and any(known[k] for k in leaves):
            node = max((k for k in leaves if known[k]), key=lambda k: known[k][0])
            _, f, cut = known[node]
            mask = leaves.pop(node)
            leaves[nxt], leaves[nxt + 1] = mask & (bins[:, f] <= cut), mask & (bins[:, f] > cut)
            known[nxt], known[nxt + 1] = best(leaves[nxt]), best(leaves[nxt + 1])
            made.append((int(f), int(cut)))
            nxt += 2
        step = np.zeros(len(y))
        for mask in leaves.values():
            m = mask & bag
            step[mask] = -(w * (pred - y))[m].sum() / (w[m].sum() + params.l2) * params.rate
        pred = pred + (step if made else 0)
        out.append(made)
    return pred, out


def test_equals_a_plain_version_bin_for_bin(spark, rows):
    weights = F.array(F.lit(1.0), F.when(F.col("season") < 2005, F.pow(F.lit(0.5), (2004 - F.col("season")) / 3)).otherwise(0.0))
    held, T.REWRITE = T.REWRITE, 4
    try:
        models = T.fit_folds(rows, NAMES, "margin", weights, 2, PARAMS)
    finally:
        T.REWRITE = held
    edges = T.bin_edges(rows, NAMES, PARAMS.bins)
    got = T.binned(rows, NAMES, edges, "margin", "game_id", weights).collect()
    bins = np.array([list(r.bins) for r in got])
    for f, m in enumerate(models):
        pred, made = plain_fit(bins, np.array([r.y for r in got]), np.array([r.weights[f] for r in got]), np.array([r.hash for r in got]), PARAMS, f)
        grown = []
        for t in m.trees:
            order = [k for k in range(len(t.feature)) if t.feature[k] >= 0]
            grown.append(sorted((t.feature[k], t.cut[k]) for k in order))
        assert grown == [sorted(t) for t in made if t]
        told = {r.game_id: r.p for r in rows.select("game_id", m.predict().alias("p")).collect()}
        own = {r.game_id: r.hash for r in rows.select("game_id", F.xxhash64("game_id").alias("hash")).collect()}
        by_hash = {r.hash: p for r, p in zip(got, pred, strict=True)}
        assert all(told[g] == pytest.approx(by_hash[own[g]]) for g in told)


def value_of(model, row, known):
    """The prediction when only the known features are looked at; others pass a split by the share of rows."""
    total = model.base
    for t in model.trees:

        def walk(node, t=t):
            f = t.feature[node]
            if f < 0:
                return t.value[node]
            x = -np.inf if row[model.features[f]] is None else row[model.features[f]]
            if model.features[f] in known:
                return walk(t.left[node] if x <= model.edges[f][t.cut[node]] else t.right[node])
            return sum(t.rows[c] / t.rows[node] * walk(c) for c in (t.left[node], t.right[node]))

        total += walk(0)
    return total


def test_contributions_are_shapley_values_and_add_up(spark, rows):
    model = T.fit_trees(rows.withColumn("w", F.lit(1.0)), NAMES, "margin", "w", PARAMS)
    again = T.Trees.of(json.loads(json.dumps(model.to_dict())))
    told = rows.select("*", again.predict().alias("p"), *[c.alias(f"c_{k}") for k, c in again.contributions().items()]).limit(12).collect()
    n = len(NAMES)
    for r in told:
        assert r.p == pytest.approx(again.expected() + sum(r[f"c_{k}"] for k in NAMES)) == pytest.approx(value_of(model, r, set(NAMES)))
        assert again.expected() == pytest.approx(value_of(model, r, set()))
        for k in NAMES:
            others = [o for o in NAMES if o != k]
            shap = sum(factorial(s) * factorial(n - s - 1) / factorial(n) * (value_of(model, r, {*c, k}) - value_of(model, r, set(c))) for s in range(n) for c in itertools.combinations(others, s))
            assert r[f"c_{k}"] == pytest.approx(shap, abs=1e-9)


def test_learns_and_odd_rows(spark, rows):
    model = T.fit_trees(rows.withColumn("w", F.lit(1.0)), NAMES, "margin", "w", T.TreeParams(trees=14, rate=0.4, least=10, l2=1.0))
    errors = rows.select(F.avg(F.pow(F.col("margin") - model.predict(), 2)).alias("e"), F.var_pop("margin").alias("v")).head()
    assert errors.e < 0.4 * errors.v
    same = rows.select("game_id", "margin", F.lit(1.0).alias("a"), F.lit(None).cast("double").alias("b"), F.lit(1.0).alias("w"))
    flat = T.fit_trees(same, ["a", "b"], "margin", "w", PARAMS)
    assert flat.trees == [] and flat.expected() == flat.base == pytest.approx(rows.agg(F.avg("margin")).head()[0])
    assert same.select(flat.predict().alias("p"), *flat.contributions().values()).head()[0] == pytest.approx(flat.base)
