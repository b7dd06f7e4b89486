"""Similarity, reinforcement and score expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Weights:
    """Weights of a candidate's score; a week halves the effect of past accesses."""

    alpha: float = 1.0
    beta: float = 0.8
    gamma: float = 0.2
    delta: float = 0.3
    decay: float = math.log(2) / (7 * 86_400)
    cap: float = 2.0

    @property
    def ceiling(self) -> float:
        return (self.alpha + self.beta + self.delta) * (1 + self.gamma * self.cap)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if either vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def unit(v: Column) -> Column:
    """The vector at length one in doubles; zero stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm == 0, F.lit(0.0)).otherwise(x.cast("double") / norm))


def age_seconds(last: Column, now: Column) -> Column:
    return F.greatest((F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) / 1e6, F.lit(0.0))


def reinforcement(count: Column, last: Column, now: Column, weights: Weights = Weights()) -> Column:
    """Bounded effect of ``count`` accesses, the last of them at ``last``; 0 without any."""
    value = F.least(F.log1p(count.cast("double")) * F.exp(-F.lit(weights.decay) * age_seconds(last, now)), F.lit(weights.cap))
    return F.when(count.isNull() | (count <= 0) | last.isNull(), 0.0).otherwise(value)


def clamped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def score(similarity: Column, distance: Column, confidence: Column, boost: Column, weights: Weights = Weights()) -> Column:
    """Additive relevance, times a bounded boost."""
    near = F.lit(weights.beta) / (1 + F.greatest(distance, F.lit(0)))
    relevance = F.lit(weights.alpha) * clamped(similarity) + near + F.lit(weights.delta) * clamped(confidence)
    return relevance * (1 + F.lit(weights.gamma) * boost)
