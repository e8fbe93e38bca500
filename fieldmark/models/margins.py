"""What actual margins to expect around a predicted one: a normal law, or a Gaussian kernel over past predictions.

The kernel is answered from a summary whose size depends on the span of margins and not on rows.  Predictions are
dealt into cells a quarter of a bandwidth wide; of each cell and actual margin the sums of the first TERMS powers of
the places in the cell are kept.  exp(-(u - t)^2 / 2) is the generating function of the Hermite polynomials times
exp(-u^2 / 2), so the weight of a cell's rows at any u is a short sum of those powers, good to about 1e-12 of the
largest weight within REACH bandwidths of a known prediction.  Predictions further out are taken at that distance.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.expressions import PPF_90, normal_cdf

#: Cells in a bandwidth, powers kept, bandwidths beyond which a weight is nothing, and how far out answers go.
FINE, TERMS, NEAR, REACH = 4, 40, 10.0, 60.0


@dataclass
class GaussianMargin:
    """P(margin > 0) and an 80 % interval around a predicted margin."""

    sigma: float

    def probability(self, predicted: Column) -> Column:
        return normal_cdf(predicted / F.lit(float(self.sigma)))

    def interval(self, predicted: Column) -> tuple[Column, Column]:
        return predicted - PPF_90 * float(self.sigma), predicted + PPF_90 * float(self.sigma)

    def to_dict(self) -> dict:
        return {"type": "gaussian"} | asdict(self)


def kernel_cells(df: DataFrame, predicted: str, actual: str, bandwidth: float, keys: Iterable[str] = ()) -> DataFrame:
    """(keys, cell, actual, sums): the sums of powers of t, the predictions' places from their cell's middle in bandwidths."""
    x = F.col(predicted).cast("double") / F.lit(bandwidth)
    cell = F.floor(x * FINE)
    rows = df.filter(F.col(predicted).isNotNull() & F.col(actual).isNotNull()).select(*keys, cell.alias("cell"), F.col(actual).cast("double").alias("actual"), (x - (cell + 0.5) / FINE).alias("t"))
    return rows.groupBy(*keys, "cell", "actual").agg(F.array(F.count("*").cast("double"), *[F.sum(F.pow("t", F.lit(n))) for n in range(1, TERMS)]).alias("sums"))


@dataclass
class KernelMargin:
    """Summed cells: where each lies, the actual margin, and its sums of powers."""

    bandwidth: float
    cell: list[int]
    actual: list[float]
    sums: list[list[float]]
    _ready: tuple | None = field(default=None, repr=False, compare=False)

    @staticmethod
    def of(df: DataFrame, predicted: str, actual: str, bandwidth: float) -> KernelMargin:
        return KernelMargin.from_rows(kernel_cells(df, predicted, actual, bandwidth).collect(), bandwidth)

    @staticmethod
    def from_rows(rows: Iterable, bandwidth: float) -> KernelMargin:
        """Of collected cells, those of one cell and margin added up."""
        total: dict[tuple, np.ndarray] = {}
        for r in rows:
            total[r.cell, r.actual] = total.get((r.cell, r.actual), 0) + np.array(r.sums)
        keys = sorted(total)
        return KernelMargin(bandwidth, [k[0] for k in keys], [k[1] for k in keys], [total[k].tolist() for k in keys])

    def to_dict(self) -> dict:
        return {"type": "kernel", "bandwidth": self.bandwidth, "cell": self.cell, "actual": self.actual, "sums": self.sums}

    def _tables(self) -> tuple:
        """Cells in order, distinct actual margins in order, and sums[cell, power, margin]."""
        if self._ready is None:
            cells, at = np.unique(self.cell, return_inverse=True)
            actual, of = np.unique(self.actual, return_inverse=True)
            sums = np.zeros((len(cells), TERMS, len(actual)))
            sums[at, :, of] = np.array(self.sums)
            self._ready = cells, actual, sums
        return self._ready

    def answer(self, predicted: np.ndarray) -> np.ndarray:
        """(probability of winning, low, high) of each prediction; nan where it is nan."""
        cells, actual, sums = self._tables()
        middle = (cells + 0.5) / FINE
        x = np.clip(np.asarray(predicted, float) / self.bandwidth, middle[0] - REACH, middle[-1] + REACH)
        nearest = np.abs(x[:, None] - middle).min(axis=1) if len(middle) < 2048 else np.minimum.reduce([np.abs(x - middle[np.clip(np.searchsorted(middle, x) + d, 0, len(middle) - 1)]) for d in (-1, 0)])
        weight = np.zeros((len(x), len(actual)))
        for c, s in zip(middle, sums, strict=True):
            u = x - c
            here = np.flatnonzero(np.abs(u) <= nearest + NEAR)
            if not len(here):
                continue
            v = u[here]
            before, now = np.zeros(len(v)), np.exp(-0.5 * (v**2 - nearest[here] ** 2))  # Hermite polynomials over n!, scaled by the nearest cell's weight
            part = np.outer(now, s[0])
            for n in range(1, TERMS):
                before, now = now, (v * now - before) / n
                part += np.outer(now, s[n])
            weight[here] += part
        weight = np.maximum(weight, 0)
        whole = weight.sum(axis=1)
        cdf = np.cumsum(weight, axis=1) / whole[:, None]
        p = (weight[:, actual > 0].sum(axis=1) + 0.5 * weight[:, actual == 0].sum(axis=1)) / whole
        low, high = (actual[np.argmax(cdf >= q - 1e-12, axis=1)] for q in (0.1, 0.9))
        out = np.column_stack([p, low, high])
        out[np.isnan(x)] = np.nan
        return out


Margin = GaussianMargin | KernelMargin


def margin_of(told: dict) -> Margin:
    kinds = {"gaussian": GaussianMargin, "kernel": KernelMargin}
    return kinds[told["type"]](**{k: v for k, v in told.items() if k != "type"})


def answers(dists: Mapping[int, Margin], key: Column, predicted: Column) -> Column:
    """struct<p, low, high> of each row under the distribution that its key names; null where the key has none or nothing is predicted.

    Normal laws are one expression; kernels answer a batch at once from their summaries.
    """
    if all(isinstance(d, GaussianMargin) for d in dists.values()):
        sigma = F.element_at(F.create_map(*[F.lit(v) for k, d in dists.items() for v in (int(k), float(d.sigma))]), key.cast("int"))
        return F.struct(normal_cdf(predicted / sigma).alias("p"), (predicted - PPF_90 * sigma).alias("low"), (predicted + PPF_90 * sigma).alias("high"))
    kernels = {int(k): d for k, d in dists.items()}

    @F.pandas_udf("p double, low double, high double")
    def told(which: pd.Series, x: pd.Series) -> pd.DataFrame:
        out = np.full((len(x), 3), np.nan)
        for k in which.dropna().unique():
            if int(k) in kernels:
                at = np.flatnonzero((which == k).to_numpy() & x.notna().to_numpy())
                out[at] = kernels[int(k)].answer(x.to_numpy(float)[at])
        return pd.DataFrame(out, columns=["p", "low", "high"]).astype(object).where(lambda d: d.notna(), None)

    return told(key.cast("long"), predicted.cast("double"))


def kernel_probability(test: DataFrame, training: DataFrame, bandwidth: float, key: str = "game_id") -> DataFrame:
    """(key, p_win) by the kernel on exact predicted margins; ties of the actual margin count half."""
    dist = KernelMargin.of(training, "predicted", "margin", bandwidth)
    return test.select(key, answers({0: dist}, F.lit(0), F.col("predicted")).alias("a")).select(key, F.col("a.p").alias("p_win"))
