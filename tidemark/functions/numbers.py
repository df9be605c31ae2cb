"""Transforms and weights of scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
FANOUT_SATURATION = 60
EPSILON = 1e-6


def log_count(value: Column) -> Column:
    """log1p of a count; missing and negative values count as 0."""
    return F.log1p(F.greatest(F.coalesce(value.cast("double"), F.lit(0.0)), F.lit(0.0)))


def filled(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


def missing(value: Column) -> Column:
    return value.isNull().cast("double")


def logit(p: Column) -> Column:
    clipped = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))
    return F.ln(clipped / (1 - clipped))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def platt(score: Column, slope: Column | float, intercept: Column | float) -> Column:
    return sigmoid(logit(score) * slope + intercept)


def class_weight(rank: Column, classes: int) -> Column:
    """1 for the widest class, falling linearly to the narrowest."""
    if classes <= 1:
        return F.lit(1.0)
    return F.greatest(F.lit(0.0), 1 - (rank - 1) / (classes - 1))


def fanout_weight(count: Column) -> Column:
    """Grows with the log of the count and stops growing at 60."""
    return F.when(count <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log1p(count) / math.log1p(FANOUT_SATURATION)))


def share(hits: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(hits, total), F.lit(0.0))


def one_hot(value: Column, kinds: Sequence[str], name: str) -> list[Column]:
    return [(value == kind).cast("double").alias(f"{name}={kind}") for kind in kinds]
