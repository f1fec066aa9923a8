"""Small feed-forward networks: layers of act(W x + b); the first layer passes its input on.

Weights are a few arrays on the driver. A batch is one pass over its rows: each task sums the
gradient of its rows, and the sums are added up. The forward pass is also an expression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ACTIVATIONS
from ..sources.scratch import materialize

#: Largest change of a weight in a step.
CLIP = 100.0

_ACT = {
    "relu": (lambda v: np.maximum(v, 0.0), lambda v: (v > 0).astype(float)),
    "sigmoid": (lambda v: 1 / (1 + np.exp(-v)), lambda v: np.exp(-v) / (1 + np.exp(-v)) ** 2),
    "softplus": (lambda v: np.log1p(np.exp(v)), lambda v: 1 / (1 + np.exp(-v))),
    "tanh": (np.tanh, lambda v: 1 - np.tanh(v) ** 2),
    "identity": (lambda v: v, np.ones_like),
}
_LOSS = {"squared": (lambda e, o: 0.5 * (e - o) ** 2, lambda e, o: e - o), "absolute": (lambda e, o: np.abs(e - o), lambda e, o: np.sign(e - o))}


@dataclass
class Network:
    weights: list[np.ndarray]
    biases: list[np.ndarray]
    activations: list[str]
    loss: str = "squared"

    @classmethod
    def init(cls, sizes: list[int], activations: str | list[str] = "sigmoid", loss: str = "squared", seed: int = 0) -> Network:
        """Uniform weights and biases in (-1, 1) for layers of the given sizes."""
        rng = np.random.default_rng(seed)
        acts = [activations] * (len(sizes) - 1) if isinstance(activations, str) else list(activations)
        if unknown := {*acts} - {*_ACT}:
            raise ValueError(f"unknown activations: {sorted(unknown)}")
        if loss not in _LOSS:
            raise ValueError(f"unknown loss: {loss}")
        shapes = list(zip(sizes[1:], sizes[:-1], strict=True))
        return cls([rng.uniform(-1, 1, s) for s in shapes], [rng.uniform(-1, 1, s[0]) for s in shapes], acts, loss)

    def forward(self, x: np.ndarray) -> np.ndarray:
        for w, b, a in zip(self.weights, self.biases, self.activations, strict=True):
            x = _ACT[a][0](x @ w.T + b)
        return x

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float]:
        """(sums over the rows of the gradient by weights and biases in turn, loss)."""
        states, sums = [x], []
        for w, b, a in zip(self.weights, self.biases, self.activations, strict=True):
            sums.append(states[-1] @ w.T + b)
            states.append(_ACT[a][0](sums[-1]))
        loss, slope = _LOSS[self.loss]
        error = slope(states[-1], y)
        out: list[np.ndarray] = []
        for k in range(len(self.weights) - 1, -1, -1):
            delta = error * _ACT[self.activations[k]][1](sums[k])
            out = [delta.T @ states[k], delta.sum(0), *out]
            error = delta @ self.weights[k]
        return out, float(loss(states[-1], y).sum())

    def expression(self, x: list[Column]) -> list[Column]:
        """The forward pass as columns."""
        for w, b, a in zip(self.weights, self.biases, self.activations, strict=True):
            x = [ACTIVATIONS[a][0](sum((F.lit(float(v)) * c for v, c in zip(row, x, strict=True)), F.lit(float(bias)))) for row, bias in zip(w, b, strict=True)]
        return x


def train(rows: DataFrame, features: list[str], targets: list[str], id_col: str, hidden: list[int], activations: str | list[str] = "sigmoid", loss: str = "squared", rate: float = 0.05, epoch_size: int = 1000, passes: int = 1, seed: int = 0) -> tuple[Network, list[float]]:
    """A network and the mean loss of each batch. Rows are dealt by a hash of their id into
    ceil(n / epoch_size) batches, one descent step each."""
    net = Network.init([len(features), *hidden, len(targets)], activations, loss, seed)
    cells = [F.array(*[F.col(c).cast("double") for c in cs]).alias(n) for cs, n in ((features, "x"), (targets, "y"))]
    n = rows.count()
    batches = max(1, -(-n // epoch_size))
    data = materialize(rows.select(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(batches)).alias("batch"), *cells))
    losses = []
    for _ in range(passes):
        for b in range(batches):
            held = net

            def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                total, loss, n = None, 0.0, 0
                for pdf in parts:
                    if len(pdf):
                        g, more = held.gradient(np.stack(pdf["x"].to_numpy()), np.stack(pdf["y"].to_numpy()))
                        flat = np.concatenate([v.ravel() for v in g])
                        total, loss, n = flat if total is None else total + flat, loss + more, n + len(pdf)
                if total is not None:
                    yield pd.DataFrame({"i": np.arange(len(total) + 2), "v": np.concatenate([total, [loss, n]])})

            got = data.filter(F.col("batch") == b).mapInPandas(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
            if not got:
                continue
            v = np.array([r["v"] for r in got])
            change, at = np.clip(rate * v[:-2] / v[-1], -CLIP, CLIP), 0
            new: list[list[np.ndarray]] = [[], []]
            for k in range(len(net.weights)):
                for kind, old in enumerate((net.weights[k], net.biases[k])):
                    new[kind].append(old - change[at : at + old.size].reshape(old.shape))
                    at += old.size
            net = Network(new[0], new[1], net.activations, net.loss)
            losses.append(float(v[-2] / v[-1]))
    return net, losses


def predict(net: Network, rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with the column output, an array."""
    x = F.array(*[F.col(c).cast("double") for c in features])

    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(net.forward(np.stack(s.to_numpy())))) if len(s) else pd.Series([], dtype=object)

    return rows.withColumn("output", F.pandas_udf(run, "array<double>")(x))
