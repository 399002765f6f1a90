"""An autoencoder fitted by data-parallel gradient descent: gradients per task, summed by Spark, one step a round.

Every round is one job over the written rows: each task sums the gradients of its rows, Spark adds the sums up by
parameter, and the driver, which holds the parameters and nothing else, takes the step. Its share is bounded by the net's size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import dropped, written

#: Hidden layers of the billing model.
LAYERS = (64, 32, 16, 32, 64)


@dataclass
class Net:
    """Weights and offsets of a net with rectified hidden layers and a linear output; `losses`: the mean loss before each step."""

    shapes: list[tuple[int, int]]
    flat: np.ndarray
    losses: list[float] = field(default_factory=list)

    @classmethod
    def drawn(cls, width: int, layers: Sequence[int] = LAYERS, seed: int = 42) -> Net:
        """Uniform within sqrt(6 / (in + out)), offsets as well."""
        sizes, rng, parts = [width, *layers, width], np.random.default_rng(seed), []
        for a, b in zip(sizes, sizes[1:], strict=False):
            bound = np.sqrt(6 / (a + b))
            parts.append(rng.uniform(-bound, bound, (a + 1) * b))
        return cls(list(zip(sizes, sizes[1:], strict=False)), np.concatenate(parts))

    def layers(self, flat: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(weights, offsets) of each layer, as views of the flat parameters."""
        flat, at, out = self.flat if flat is None else flat, 0, []
        for a, b in self.shapes:
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + (a + 1) * b]))
            at += (a + 1) * b
        return out

    def outputs(self, x: np.ndarray) -> list[np.ndarray]:
        """What each layer gives, the input first."""
        found, layers = [x], self.layers()
        for i, (w, b) in enumerate(layers):
            y = found[-1] @ w + b
            found.append(y if i == len(layers) - 1 else np.maximum(y, 0))
        return found

    def gradient(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Sums over the rows: of the gradient of half the mean squared error of a row, and of that error."""
        found, layers, out = self.outputs(x), self.layers(), np.zeros_like(self.flat)
        into = self.layers(out)
        delta = (found[-1] - x) / x.shape[1]
        for i in reversed(range(len(layers))):
            into[i][0][:] = found[i].T @ delta
            into[i][1][:] = delta.sum(axis=0)
            if i:
                delta = (delta @ layers[i][0].T) * (found[i] > 0)
        return out, float(((found[-1] - x) ** 2).sum() / (2 * x.shape[1]))

    def errors(self, x: np.ndarray) -> np.ndarray:
        """Each row's mean squared error."""
        return ((self.outputs(x)[-1] - x) ** 2).mean(axis=1)


class Adam:
    """Steps by the means of gradients and of their squares."""

    def __init__(self, size: int, step: float = 1e-3):
        self.step, self.mean, self.square, self.n = step, np.zeros(size), np.zeros(size), 0

    def __call__(self, flat: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.n += 1
        self.mean = 0.9 * self.mean + 0.1 * gradient
        self.square = 0.999 * self.square + 0.001 * gradient**2
        return flat - self.step * (self.mean / (1 - 0.9**self.n)) / (np.sqrt(self.square / (1 - 0.999**self.n)) + 1e-8)


def _stack(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, width))


def _summed(rows: DataFrame, net: Net, features: str) -> tuple[np.ndarray, float, int]:
    """Gradient, loss and number of rows, over all rows."""
    size = len(net.flat)

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, loss, n = np.zeros(size), 0.0, 0
        for part in parts:
            if len(part):
                g, more = net.gradient(_stack(part[features], net.shapes[0][0]))
                total, loss, n = total + g, loss + more, n + len(part)
        if n:
            yield pd.DataFrame({"i": np.arange(size + 2), "v": np.concatenate([total, [loss, n]])})

    found = rows.select(features).mapInPandas(task, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # a row for each parameter
    out = np.zeros(size + 2)
    for r in found:
        out[r["i"]] = r["v"]
    return out[:size], float(out[size]), int(out[size + 1])


def fit(rows: DataFrame, features: str = "x", layers: Sequence[int] = LAYERS, rounds: int = 100, step: float = 1e-2, seed: int = 42, least: float = 0.0, patience: int = 10) -> Net:
    """rows(features array<double>) -> the net after `rounds` steps over all of them.

    Earlier, if the loss hasn't fallen by more than `least` of itself in `patience` rounds. The first net depends on seed and width
    alone, and sums don't depend on how rows are dealt but for rounding.
    """
    held = written(rows.select(features), "fitted")
    width = held.select(F.size(features)).first()
    net = Net.drawn(width[0] if width else 1, layers, seed)
    if width:
        adam, best, since = Adam(len(net.flat), step), np.inf, 0
        for _ in range(rounds):
            g, loss, n = _summed(held, net, features)
            net.losses.append(loss / n)
            since = 0 if loss / n < best * (1 - least) else since + 1
            best = min(best, loss / n)
            if since >= patience:
                break
            net = Net(net.shapes, adam(net.flat, g / n), net.losses)
    dropped(held)
    return net


def reconstruction_errors(rows: DataFrame, net: Net, features: str = "x", out: str = "error") -> DataFrame:
    """rows with each one's mean squared error."""
    width = net.shapes[0][0]

    @F.pandas_udf("double")
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(net.errors(_stack(part, width)))

    return rows.withColumn(out, judged(features))


def usual(df: DataFrame, z: str, at: float = 0.9) -> DataFrame:
    """Rows whose z isn't above its exact percentile `at`; a null z counts as 0. Unusual rows reconstruct badly if the net hasn't met them."""
    from .quantiles import percentiles

    filled = df.withColumn("_z", F.coalesce(F.col(z).cast("double"), F.lit(0.0)))
    cut = percentiles(filled.select(F.lit(1).alias("k"), "_z"), ["k"], "_z", [at]).select(F.get("p", F.lit(0)).alias("_cut"))
    return filled.join(F.broadcast(cut), F.col("_z") <= F.col("_cut")).drop("_z", "_cut")  # one row
