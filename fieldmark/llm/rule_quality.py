"""Quality classifier as a sparse rule ensemble.

Trees are grown over document statistics, every root-to-node path becomes a conjunctive rule, an
L1-penalised logistic regression keeps a few of the rules, and those are compiled into one Spark
column expression.  Statistics and scoring are built-in functions over the whole text; only the
fit on a bounded labelled sample (SAMPLE_ROWS rows at most) happens in numpy.

Defined results: a null text scores as the empty text; empty texts get the score of all-zero
statistics; repeated rows are scored each; without labelled rows of both classes, every score is the
share of label 1 (0.5 without any label).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.shared import held_out

#: Labelled rows that the fit sees at most (those of least hash): a documented bound.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3


#: Names of the statistics, in the order of the fit's matrix.
STATISTICS = (
    "log_chars", "log_words", "word_chars", "letter_share", "upper_share", "digit_share", "symbol_share", "pipe_share",
    "bang_share", "stop_share", "distinct_share", "adjacent_share", "repeated_line_share",
)


def with_statistics(documents: DataFrame) -> DataFrame:
    """documents with one column __<name> for each of STATISTICS, over the whole text.

    The strings that several statistics count in (letters, marks, words) are made once.  Shares are
    0 where there is nothing to divide by.
    """

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0)).cast("double")

    t, letters, marks, words, lines = (F.col(f"__{c}") for c in ("text", "letters", "marks", "words", "lines"))
    n, size = F.length(t), F.when(F.length(F.trim(t)) > 0, F.size(words)).otherwise(0)
    made = {
        "log_chars": F.log1p(n.cast("double")),
        "log_words": F.log1p(F.col("__size").cast("double")),
        "word_chars": share(F.length(letters), F.col("__size")),
        "letter_share": share(F.length(letters), n),
        "upper_share": share(F.length(F.regexp_replace(letters, r"[^\p{Lu}]+", "")), F.length(letters)),
        "digit_share": share(F.length(F.regexp_replace(marks, r"[^0-9]+", "")), n),
        "symbol_share": share(F.length(F.regexp_replace(marks, r"[0-9.,;:'\"()-]+", "")), n),
        "pipe_share": share(F.length(marks) - F.length(F.replace(marks, F.lit("|"), F.lit(""))), F.col("__size")),
        "bang_share": share(F.length(F.regexp_replace(marks, r"[^!?]+", "")), F.col("__size")),
        "stop_share": share(F.length(F.regexp_replace(marks, r"[^.,;:]+", "")), F.col("__size")),
        "distinct_share": share(F.size(F.array_distinct(words)), F.sqrt(F.col("__size").cast("double"))),
        "adjacent_share": share(F.regexp_count(t, F.lit(r"(?<!\S)(\S++)\s++\1(?!\S)")), F.col("__size")),
        "repeated_line_share": share(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
    }
    return (
        documents.withColumn("__text", F.coalesce(F.col("text"), F.lit("")))
        .withColumns({
            "__letters": F.regexp_replace("__text", r"[^\p{L}]+", ""),
            "__marks": F.regexp_replace("__text", r"[\p{L}\s]+", ""),
            "__words": F.split(F.trim("__text"), r"\s+"),
            "__lines": F.split("__text", "\n"),
        })
        .withColumn("__size", size)
        .withColumns({f"__{k}": made[k] for k in STATISTICS})
        .drop("__text", "__letters", "__marks", "__words", "__lines", "__size")
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is_above, threshold)."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self, stats: dict[str, Column]) -> Column:
        return reduce(lambda a, b: a & b, [(stats[s] > v) if above else (stats[s] <= v) for s, above, v in self.terms])

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for s, above, v in self.terms:
            out &= (x[:, names.index(s)] > v) == above
        return out


@dataclass
class RuleModel:
    intercept: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self, stats: dict[str, Column]) -> Column:
        z = F.lit(float(self.intercept))
        for rule, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(rule.column(stats), F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def predict(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            z += w * rule.holds(x, names)
        return 1 / (1 + np.exp(-z))


def _best_split(x, y, rows, features, edges, least):
    """The (feature, threshold) with the least Gini impurity over quantile thresholds, or None."""
    best, chosen = 1e-9, None
    ys = y[rows]
    n, p = len(rows), ys.mean()
    base = p * (1 - p)
    for f in features:
        if not len(edges[f]):
            continue
        place = np.searchsorted(edges[f], x[rows, f], side="left")  # x <= edges[k] in bins 0..k
        size = np.bincount(place, minlength=len(edges[f]) + 1).cumsum()[:-1]
        ones = np.bincount(place, weights=ys, minlength=len(edges[f]) + 1).cumsum()[:-1]
        right, right_ones = n - size, ys.sum() - ones
        ok = (size >= least) & (right >= least)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = base - (ones * (size - ones) / size + right_ones * (right - right_ones) / right) / n
        gain = np.where(ok, gain, 0)
        k = int(gain.argmax())
        if gain[k] > best:
            best, chosen = gain[k], (f, float(edges[f][k]))
    return chosen


def grow_rules(x, y, names, trees=60, depth=3, bins=48, least=8, seed=11) -> list[Rule]:
    """The paths to all nodes of bagged trees over random thirds of the statistics, without repeats."""
    rng = np.random.default_rng(seed)
    quantiles = np.linspace(0, 1, bins + 2)[1:-1]
    edges = [np.unique(np.quantile(x[:, f], quantiles)) for f in range(x.shape[1])]
    # tails matter for shares that are nearly always 0
    edges = [np.unique(np.concatenate([e, np.quantile(x[x[:, f] > 0, f], [0.05, 0.25, 0.5, 0.75])])) if (x[:, f] > 0).any() else e for f, e in enumerate(edges)]
    found: dict[Rule, None] = {}

    def grow(rows, terms, left):
        if left == 0 or len(rows) < 2 * least or y[rows].min() == y[rows].max():
            return
        features = rng.choice(x.shape[1], max(2, x.shape[1] // 3), replace=False)
        if (cut := _best_split(x, y, rows, features, edges, least)) is None:
            return
        f, v = cut
        for above in (False, True):
            path = (*terms, (names[f], above, v))
            found.setdefault(Rule(path))
            grow(rows[(x[rows, f] > v) == above], path, left - 1)

    for _ in range(trees):
        grow(rng.integers(0, len(x), len(x)), (), depth)
    return list(found)


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for mean logistic loss + penalty * |w|_1; the intercept is free.

    a may be boolean.  The columns are centred inside the products: no centred copy of a is made.
    """
    n, k = a.shape
    a = a.astype(float, copy=False)
    mean = a.mean(0)

    def centred(w: np.ndarray) -> np.ndarray:
        return a @ w - mean @ w

    def against(r: np.ndarray) -> np.ndarray:
        return a.T @ r - mean * r.sum()

    v = np.ones(k) / np.sqrt(max(k, 1))
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = against(centred(v))
        v /= np.linalg.norm(v) + 1e-12
    rate = 1 / (0.25 * max(1.0, float(v @ against(centred(v))) / n) * 1.05)
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    zw, zb, t = w, b, 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-np.clip(centred(zw) + zb, -30, 30))) - y
        new_w = zw - rate * against(g) / n
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - rate * penalty, 0)
        new_b = zb - rate * g.mean()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zw, zb = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return b - float(mean @ w), w


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], penalty: float = 2e-4, most: int = 60) -> RuleModel:
    if len(y) == 0:
        return RuleModel(0.0)
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    if y.min() == y.max():
        return RuleModel(float(np.log(p / (1 - p))))
    rules = grow_rules(x, y, names)
    if not rules:
        return RuleModel(float(np.log(p / (1 - p))))
    distinct: dict[bytes, tuple[Rule, np.ndarray]] = {}
    for r in rules:  # rules that hold for the same rows count once
        held = r.holds(x, names)
        distinct.setdefault(np.packbits(held).tobytes(), (r, held))
    rules, a = [r for r, _ in distinct.values()], np.stack([held for _, held in distinct.values()], 1)
    del distinct
    _, w = lasso_logistic(a, y, penalty)
    kept = np.argsort(-np.abs(w))[:most]
    kept = np.sort(kept[np.abs(w[kept]) > 1e-6])
    b, w = lasso_logistic(a[:, kept], y, penalty)
    used = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(b, [rules[kept[i]] for i in used], [float(w[i]) for i in used])


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Statistics and labels of at most `rows` labelled documents outside the held-out fold.

    The labels are cut to the bound first, by hash, and only then sent to the scan of documents, so
    that neither the texts nor the label table are shuffled.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("labelled_id"), F.col(label).cast("double").alias("y"))
        .filter(F.col("y").isNotNull() & F.col("labelled_id").isNotNull() & ~held_out(F.col("labelled_id")))
        .orderBy(F.xxhash64("labelled_id"), "labelled_id", "y")
        .limit(rows)
    )
    got = (
        with_statistics(documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")))
        .select("y", F.xxhash64("doc_id", "text").alias("h"), *[f"__{k}" for k in STATISTICS])
        .orderBy("h", "y")
        .limit(rows)
        .toPandas()
    )
    return got[[f"__{k}" for k in STATISTICS]].to_numpy(float), got["y"].to_numpy(float), list(STATISTICS)


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> RuleModel:
    x, y, names = labelled_sample(documents, labels, label, rows)
    return fit_rules(x, y, names)


def score(documents: DataFrame, model: RuleModel, threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """documents with the score and the prediction under these names; columns of the same names are replaced."""
    kept = [c for c in documents.columns if c not in names]
    scored = with_statistics(documents.select(*kept)).withColumn(names[0], model.score({k: F.col(f"__{k}") for k in STATISTICS}))
    return scored.withColumn(names[1], (F.col(names[0]) >= threshold).cast("int")).drop(*[f"__{k}" for k in STATISTICS])


def accepted(documents: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents predicted as label 1.

    A filter on a computed column is pushed below its projection, which would repeat every statistic inside
    every rule of the predicate; a row number in the projection, which the filter reads, keeps it above.
    """
    scored = score(documents, model, threshold, ("__score", "__predicted")).withColumn("__row", F.monotonically_increasing_id())
    return scored.filter("__predicted = 1 and __row >= 0").select(documents.columns)
