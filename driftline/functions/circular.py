"""Circular statistics as columns and aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_to_pi(x: Column) -> Column:
    return F.atan2(F.sin(x), F.cos(x))


def angular_distance(a: Column, b: Column) -> Column:
    """0 to pi."""
    return F.abs(wrap_to_pi(a - b))


def circular_mean(phase: Column) -> Column:
    """Aggregate: argument of the mean unit vector."""
    return F.atan2(F.avg(F.sin(phase)), F.avg(F.cos(phase)))


def resultant(phase: Column) -> Column:
    """Aggregate: length of the mean unit vector."""
    return F.hypot(F.avg(F.cos(phase)), F.avg(F.sin(phase)))


def circular_std(phase: Column) -> Column:
    """Aggregate: root of -2 ln R, with R held within 1e-10 and 1."""
    return F.sqrt(-2 * F.ln(F.least(F.greatest(resultant(phase), F.lit(1e-10)), F.lit(1.0))))


def rayleigh_p(r: Column, n: Column) -> Column:
    """p of uniformity: exp(-n R^2), corrected for fewer than 50 phases and held within 0 and 1."""
    z = n * r * r
    small = F.exp(-z) * (
        1 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z**2 + 76 * z**3 - 9 * z**4) / (288 * n * n)
    )
    return F.greatest(F.least(F.when(n < 50, small).otherwise(F.exp(-z)), F.lit(1.0)), F.lit(0.0))


def phase_bin(phase: Column, n_bins: int) -> Column:
    """Bin of equal width on -pi to pi, the last one closed; null outside."""
    inside = phase.between(-math.pi, math.pi)
    return F.when(inside, F.least(F.floor((phase + math.pi) / (2 * math.pi / n_bins)), F.lit(n_bins - 1)).cast("int"))
