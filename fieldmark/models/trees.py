"""Boosted regression trees, grown best leaf first from histograms, with additive contributions.

Rows are binned once and stored.  A step of growth needs the sums of gradients, weights and rows for each (fold,
feature, bin) of one new leaf a fold: every task adds up its own rows, one grouping adds up the tasks, and the driver
gets a table whose size depends on folds, features and bins but not on rows.  The other child is its parent's
histogram less that one.  All folds, which differ in the rows' weights, grow in lockstep, so a walk-forward over many
seasons takes as many jobs as a single fit.

A leaf is a box: an interval for each feature on its path.  Scoring and contributions are column expressions over
the boxes.  Contributions are Shapley values of the path-dependent game: a feature outside the coalition passes
each of its splits with the share of the training rows that did; their sum and the expected value give the
prediction.

Defined results: a missing value is below every edge; rows of weight 0 are outside the fold; ties between splits go
to the first feature, then the lowest edge; a fold without a split that gains predicts its mean.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field
from itertools import combinations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.sources.store import Store


@dataclass(frozen=True)
class TreeParams:
    leaves: int = 4
    trees: int = 200
    rate: float = 0.03
    least: int = 50
    l2: float = 5.0
    rows: float = 0.8
    columns: float = 0.8
    bins: int = 64
    seed: int = 0


@dataclass
class Tree:
    """Nodes in order of making; node 0 is the root.  feature is -1 in a leaf; x <= edge (bin <= cut) goes left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        n = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, n, n + 1
        for _ in range(2):
            for name, empty in (("feature", -1), ("cut", 0), ("left", 0), ("right", 0), ("value", 0.0), ("rows", 0)):
                getattr(self, name).append(empty)
        return n, n + 1

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of bins stands in."""
        at = np.zeros(len(bins), np.int64)
        feature, cut, left, right = (np.array(v) for v in (self.feature, self.cut, self.left, self.right))
        while True:
            f = feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return at
            down = bins[inner, f[inner]] <= cut[at[inner]]
            at[inner] = np.where(down, left[at[inner]], right[at[inner]])


@dataclass
class Box:
    """A leaf: an interval of each feature on its path, the share of training rows that those splits let through, and the value."""

    features: list[int]
    low: list[float]
    high: list[float]
    share: list[float]
    value: float


def shapley_table(share: Sequence[float], value: float) -> np.ndarray:
    """[pattern, feature]: each feature's contribution when the bits of pattern tell which intervals hold the row."""
    m = len(share)
    out = np.zeros((1 << m, m))
    for pattern in range(1 << m):
        held = [pattern >> j & 1 for j in range(m)]
        for i in range(m):
            others = [j for j in range(m) if j != i]
            total = 0.0
            for size in range(m):
                weight = factorial(size) * factorial(m - size - 1) / factorial(m)
                for inside in combinations(others, size):
                    total += weight * float(np.prod([held[j] if j in inside else share[j] for j in others]))
            out[pattern, i] = value * total * (held[i] - share[i])
    return out


@dataclass
class Trees:
    """A fitted ensemble: prediction = base + the boxes that hold the row."""

    features: list[str]
    edges: list[list[float]]
    base: float
    trees: list[Tree]

    def boxes(self) -> list[Box]:
        out = []
        for t in self.trees:
            stack = [(0, {})]
            while stack:
                node, known = stack.pop()
                f = t.feature[node]
                if f < 0:
                    if known:
                        out.append(Box([*known], [v[0] for v in known.values()], [v[1] for v in known.values()], [v[2] for v in known.values()], t.value[node]))
                    continue
                edge = self.edges[f][t.cut[node]]
                low, high, share = known.get(f, (-np.inf, np.inf, 1.0))
                for child, a, b in ((t.left[node], low, min(high, edge)), (t.right[node], max(low, edge), high)):
                    stack.append((child, known | {f: (a, b, share * t.rows[child] / max(1, t.rows[node]))}))
        return out

    def expected(self) -> float:
        """The mean prediction over the training rows as the boxes share them out."""
        return self.base + sum(b.value * float(np.prod(b.share)) for b in self.boxes())

    def _x(self) -> Column:
        return F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("-inf"))) for f in self.features])

    def predict(self) -> Column:
        leaves = [{"v": b.value, "i": intervals(b)} for b in self.boxes()]
        if not leaves:
            return F.lit(float(self.base))
        given = literal(leaves, f"array<struct<v:double,i:{INTERVALS}>>")
        x = self._x()
        return F.aggregate(given, F.lit(float(self.base)), lambda total, leaf: total + F.when(F.forall(leaf.i, lambda k: holds(x, k)), leaf.v).otherwise(0.0))

    def contributions(self) -> dict[str, Column]:
        """Each feature's part of prediction - expected()."""
        per: dict[int, list[dict]] = {k: [] for k in range(len(self.features))}
        for b in self.boxes():
            table = shapley_table(b.share, b.value)
            for j, f in enumerate(b.features):
                per[f].append({"s": table[:, j].tolist(), "i": intervals(b)})
        x = self._x()

        def part(leaves: list[dict]) -> Column:
            if not leaves:
                return F.lit(0.0)
            given = literal(leaves, f"array<struct<s:array<double>,i:{INTERVALS}>>")

            def of(leaf: Column) -> Column:
                pattern = F.aggregate(leaf.i, F.lit(0), lambda p, k: p + F.when(holds(x, k), k.b).otherwise(0))
                return F.element_at(leaf.s, pattern + 1)

            return F.aggregate(given, F.lit(0.0), lambda total, leaf: total + of(leaf))

        return {self.features[f]: part(leaves) for f, leaves in per.items()}

    def to_dict(self) -> dict:
        return {"features": self.features, "edges": self.edges, "base": self.base, "trees": [asdict(t) for t in self.trees]}

    @staticmethod
    def of(told: dict) -> Trees:
        return Trees(told["features"], told["edges"], told["base"], [Tree(**t) for t in told["trees"]])


INTERVALS = "array<struct<f:int,lo:double,hi:double,b:int>>"


def intervals(box: Box) -> list[dict]:
    """The box for an expression: unbounded sides are left out; b is the interval's bit."""
    return [{"f": f, "lo": None if low == -np.inf else low, "hi": None if high == np.inf else high, "b": 1 << j} for j, (f, low, high) in enumerate(zip(box.features, box.low, box.high, strict=True))]


def literal(value: list[dict], ddl: str) -> Column:
    """A nested constant, read once when the plan is made."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def holds(x: Column, k: Column) -> Column:
    v = F.element_at(x, k.f + 1)
    return (k.lo.isNull() | (v > k.lo)) & (k.hi.isNull() | (v <= k.hi))


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Upper edges of each feature's bins but the last: quantiles of its values, or the values where they are few."""
    share = [k / bins for k in range(1, bins)]
    got = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), share, 20_000).alias(f) for f in features]).head()
    top = rows.agg(*[F.max(F.col(f).cast("double")).alias(f) for f in features]).head()
    return [sorted({float(v) for v in got[f] or [] if v < top[f]}) for f in features]


def binned(rows: DataFrame, features: Sequence[str], edges: list[list[float]], target: str, key: str, weights: Column) -> DataFrame:
    """(hash, y, weights, bins): one byte a feature."""
    ready = rows.select(F.xxhash64(key).alias("hash"), F.col(target).cast("double").alias("y"), weights.cast("array<double>").alias("weights"), F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("-inf"))) for f in features]).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(edges))
            out = np.empty(x.shape, np.uint8)
            for j, e in enumerate(edges):
                out[:, j] = np.searchsorted(np.array(e), x[:, j], side="left")
            yield pa.RecordBatch.from_pydict({"hash": batch.column("hash"), "y": batch.column("y"), "weights": batch.column("weights"), "bins": pa.array([r.tobytes() for r in out], pa.binary())})

    return ready.mapInArrow(run, "hash long, y double, weights array<double>, bins binary")


def drawn(hashes: np.ndarray, tree: int, params: TreeParams) -> np.ndarray:
    """Whether each row is in a tree's bag: by its hash, so that every task and every rerun agree."""
    if params.rows >= 1:
        return np.ones(len(hashes), bool)
    x = hashes.astype(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (tree + 1 + 1009 * params.seed)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) < np.uint64(int(params.rows * (1 << 53)))


def columns_of(tree: int, fold: int, features: int, params: TreeParams) -> np.ndarray:
    """The features that a tree may split, in order."""
    n = max(1, round(features * params.columns))
    return np.sort(np.random.default_rng([params.seed, tree, fold]).permutation(features)[:n])


def sums_of(bins: np.ndarray, y: np.ndarray, w: np.ndarray, leaf: np.ndarray, width: int) -> np.ndarray:
    """[feature, bin, (gradient, weight, rows)] over the rows that leaf marks; the gradient of squared error is w (prediction - y), y being what is left to explain."""
    b = bins[leaf].astype(np.int64)
    n = bins.shape[1]
    at = (b + np.arange(n) * width).ravel()
    each = [np.bincount(at, weights=np.repeat(v[leaf], n), minlength=n * width) for v in (-w * y, w)]
    return np.stack([*each, np.bincount(at, minlength=n * width)], -1).reshape(n, width, 3)


@dataclass
class Growing:
    """A fold's tree under way: its leaves' histograms and best splits."""

    tree: Tree
    allowed: np.ndarray
    hist: dict[int, np.ndarray] = field(default_factory=dict)
    best: dict[int, tuple[float, int, int]] = field(default_factory=dict)
    asked: int | None = 0

    def know(self, node: int, hist: np.ndarray, params: TreeParams) -> None:
        self.hist[node] = hist
        g, h, n = hist[0].sum(0)
        self.tree.value[node] = float(-g / (h + params.l2) * params.rate) if h > 0 else 0.0
        self.tree.rows[node] = int(n)
        found = best_split(hist, self.allowed, params)
        if found:
            self.best[node] = found

    def grow(self) -> None:
        """Split the leaf that gains most and ask for its left child's histogram; done where none is left or the tree is full."""
        self.asked = None
        if not self.best:
            return
        node = max(self.best, key=lambda k: (self.best[k][0], -k))
        _, feature, cut = self.best.pop(node)
        left, _ = self.tree.split(node, feature, cut)
        self.asked = left

    def receive(self, hist: np.ndarray, params: TreeParams) -> None:
        node = self.asked
        if node == 0:
            self.know(0, hist, params)
        else:
            parent = self.tree.left.index(node)
            self.know(node, hist, params)
            self.know(self.tree.right[parent], self.hist.pop(parent) - hist, params)


def best_split(hist: np.ndarray, allowed: np.ndarray, params: TreeParams) -> tuple[float, int, int] | None:
    """(gain, feature, cut) of the best split; None where none gains and leaves both sides enough rows."""
    left = np.cumsum(hist[allowed], axis=1)[:, :-1]
    total = hist[allowed[0]].sum(0)
    right = total - left
    ok = (left[..., 2] >= params.least) & (right[..., 2] >= params.least)
    if not ok.any():
        return None

    def score(s: np.ndarray) -> np.ndarray:
        return s[..., 0] ** 2 / (s[..., 1] + params.l2)

    gain = np.where(ok, score(left) + score(right) - score(total), -np.inf)
    k = int(gain.argmax())
    f, cut = divmod(k, gain.shape[1])
    return (float(gain.flat[k]), int(allowed[f]), int(cut)) if gain.flat[k] > 1e-12 else None


#: Trees after which the rows' residuals are written anew; until then tasks add them up.
REWRITE = 20


def fit_folds(rows: DataFrame, features: Sequence[str], target: str, weights: Column, folds: int, params: TreeParams = TreeParams(), key: str = "game_id", store: Store | None = None) -> list[Trees]:
    """One ensemble for each fold; weights is an array column of the row's weight in each."""
    spark = rows.sparkSession
    own = store or Store.temporary(spark, "trees")
    edges = bin_edges(rows, features, params.bins)
    width = max((len(e) for e in edges), default=0) + 1
    data = own.write_table(binned(rows, features, edges, target, key, weights), "rows-0")
    mean = data.select(F.posexplode("weights").alias("fold", "w"), "y").groupBy("fold").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("m")).collect()
    base = {r.fold: float(r.m or 0.0) for r in mean}
    models = [Trees(list(features), edges, base.get(k, 0.0), []) for k in range(folds)]
    data = own.write_table(residuals(data, [[] for _ in range(folds)], [m.base for m in models]), "rows-start")
    written = 0
    for t in range(params.trees):
        growing = [Growing(Tree(), columns_of(t, k, len(features), params)) for k in range(folds)]
        recent = [m.trees[written:] for m in models]
        for _ in range(params.leaves):
            asked = {k: (g.tree, g.asked) for k, g in enumerate(growing) if g.asked is not None}
            if not asked:
                break
            for k, hist in histograms(data, recent, asked, t, params, len(features), width).items():
                growing[k].receive(hist, params)
            for k in asked:
                g = growing[k]
                full = sum(f < 0 for f in g.tree.feature) >= params.leaves
                g.asked = None
                if not full:
                    g.grow()
        for m, g in zip(models, growing, strict=True):
            if len(g.tree.feature) > 1:
                m.trees.append(g.tree)
            else:
                m.trees.append(Tree())
        if (t + 1) % REWRITE == 0 and t + 1 < params.trees:
            data = own.write_table(residuals(data, [m.trees[written:] for m in models], None), f"rows-{t + 1}")
            written = t + 1
    for m in models:
        m.trees = [t for t in m.trees if len(t.feature) > 1]
    if store is None:
        own.delete()
    return models


def _matrices(batch: pa.RecordBatch, features: int, folds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, features)
    w = batch.column("weights").flatten().to_numpy().reshape(-1, folds)
    left = batch.column("left").flatten().to_numpy().reshape(-1, folds)
    return bins, w, left, batch.column("hash").to_numpy()


def residuals(data: DataFrame, trees: list[list[Tree]], base: list[float] | None) -> DataFrame:
    """data with `left`, what each fold has yet to explain: y less the base at first, then less the trees' values."""
    folds = len(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if base is not None:
                left = batch.column("y").to_numpy()[:, None] - np.array(base)
                bins = None
            else:
                n = len(batch.column("bins")[0].as_py()) if batch.num_rows else 1
                bins, _, left, _ = _matrices(batch, n, folds)
                left = left.copy()
                for k, some in enumerate(trees):
                    for tree in some:
                        left[:, k] -= np.array(tree.value)[tree.place(bins)]
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in ("hash", "y", "weights", "bins")}, "left": pa.array(list(left), pa.list_(pa.float64()))})

    return data.select("hash", "y", "weights", "bins", *(["left"] if base is None else [])).mapInArrow(run, "hash long, y double, weights array<double>, bins binary, left array<double>")


def histograms(data: DataFrame, recent: list[list[Tree]], asked: dict[int, tuple[Tree, int]], tree: int, params: TreeParams, features: int, width: int) -> dict[int, np.ndarray]:
    """The histogram of each fold's asked leaf: one grouping by (fold, feature, bin) over what every task has added up."""
    folds = len(recent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros((features, width, 3)) for k in asked}
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, w, left, hashes = _matrices(batch, features, folds)
            bag = drawn(hashes, tree, params)
            for k, (grown, node) in asked.items():
                inside = np.flatnonzero(bag & (w[:, k] > 0))
                inside = inside[grown.place(bins[inside]) == node]
                y = left[inside, k].copy()
                for before in recent[k]:
                    y -= np.array(before.value)[before.place(bins[inside])]
                total[k] += sums_of(bins[inside], y, w[inside, k], np.arange(len(inside)), width)
        for k, t in total.items():
            f, b = np.nonzero(t[..., 2])
            g, h, n = t[f, b].T
            yield pa.RecordBatch.from_pydict({"fold": np.full(len(f), k, np.int32), "feature": f.astype(np.int32), "bin": b.astype(np.int32), "g": g, "h": h, "n": n.astype(np.int64)})

    parts = data.mapInArrow(run, "fold int, feature int, bin int, g double, h double, n long")
    got = parts.groupBy("fold", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toPandas()
    out = {k: np.zeros((features, width, 3)) for k in asked}
    for k in asked:
        mine = got[got.fold == k]
        out[k][mine.feature.to_numpy(), mine.bin.to_numpy()] = mine[["g", "h", "n"]].to_numpy(float)
    return out


def fit_trees(rows: DataFrame, features: Sequence[str], target: str, weight: str, params: TreeParams = TreeParams(), key: str = "game_id") -> Trees:
    """One ensemble over rows with a weight column."""
    return fit_folds(rows, features, target, F.array(F.col(weight).cast("double")), 1, params, key)[0]
