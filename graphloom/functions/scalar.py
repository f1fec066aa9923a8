"""Scalar functions as Column expressions: edge reweighting, activations, losses, impurity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slopes of the consensus runs.
SLOPES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0, 1.33, 1.67, 2.0)


#: Draws are whole numbers below this prime.
PRIME = 2147483647


def draw(x: Column, *salts: int) -> Column:
    """A repeatable draw below PRIME for a whole number that is not negative: steps modulo a prime, which
    any SQL engine computes alike."""
    salt = sum(s * m for s, m in zip(salts, (16807, 48271, 39373), strict=False)) % PRIME
    h = (F.pmod(x, F.lit(PRIME)).cast("long") * 48271 + (salt + 11)) % PRIME
    h = (h * h + (salt * 3 + 7)) % PRIME
    h = (h * 69621 + 13) % PRIME
    return (h * h + h) % PRIME


def logistic(x: Column, slope: Column | float = 1.0, scale: float = 0.5) -> Column:
    slope = slope if isinstance(slope, Column) else F.lit(float(slope))
    return 1.0 / (1.0 + F.exp(-slope * (x - scale)))


def sigmoid_cutoff(w: Column, slope: Column | float, cutoff: float = 0.2, scale: float = 0.5) -> Column:
    """Out-of-core form: the edge stays, its weight becomes 0 at or below the cutoff.
    A negative slope empties all weights (the skeleton of a consensus graph)."""
    r = logistic(w, slope, scale)
    s = slope if isinstance(slope, Column) else F.lit(float(slope))
    return F.when(s < 0, 0.0).when(r > cutoff, r).otherwise(0.0)


ACTIVATIONS = {
    "relu": (lambda v: F.greatest(v, F.lit(0.0)), lambda v: F.when(v > 0, 1.0).otherwise(0.0)),
    "sigmoid": (lambda v: 1.0 / (1.0 + F.exp(-v)), lambda v: F.exp(-v) / F.pow(1.0 + F.exp(-v), F.lit(2.0))),
    "softplus": (lambda v: F.log1p(F.exp(v)), lambda v: 1.0 / (1.0 + F.exp(-v))),
    "tanh": (lambda v: F.tanh(v), lambda v: 1.0 - F.pow(F.tanh(v), F.lit(2.0))),
    "identity": (lambda v: v, lambda v: F.lit(1.0)),
}

LOSSES = {
    "squared": (lambda e, o: 0.5 * F.pow(e - o, F.lit(2.0)), lambda e, o: e - o),
    "absolute": (lambda e, o: F.abs(e - o), lambda e, o: F.signum(e - o)),
}


def gini(counts: list[Column]) -> Column:
    """1 - sum of squared shares; 1.0 for an empty set."""
    total = sum(counts[1:], counts[0])
    squares = sum((F.pow(c / total, F.lit(2.0)) for c in counts[1:]), F.pow(counts[0] / total, F.lit(2.0)))
    return F.when(total > 0, 1.0 - squares).otherwise(1.0)
