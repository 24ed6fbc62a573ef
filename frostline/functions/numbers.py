"""Activations and probabilities by rank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def softmax(x: Column, window) -> Column:
    """Shares of a window's rows, from exponents less the largest."""
    e = F.exp(x - F.max(x).over(window))
    return e / F.sum(e).over(window)


def rank_probability(rank: Column, n: Column, score: Column, mode: str, floor: float, window) -> Column:
    """Probabilities of a ranked list: constant, 1 / rank, scaled scores from ``floor``, or linear to ``floor``."""
    low, high = F.min(score).over(window), F.max(score).over(window)
    return {
        "constant": F.lit(1.0),
        "reciprocal": 1 / rank.cast("double"),
        "minmax": F.when(high > low, floor + (1 - floor) * (score - low) / (high - low)).otherwise(1.0),
        "linear": F.when(n <= 1, 1.0).otherwise(1 - (1 - floor) * (rank - 1) / (n - 1)),
    }[mode]
