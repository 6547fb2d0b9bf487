"""Uncertainty of beliefs over options and states, as columns over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-10


def append_reference_option(values: Column) -> Column:
    """A 0 for the fixed reference option in front."""
    return F.concat(F.array(F.lit(0.0)), values)


def option_variances(covariance: Column) -> Column:
    """Diagonal of a covariance, the reference option's 0 in front."""
    return append_reference_option(F.transform(covariance, lambda row, i: F.get(row, i)))


def categorical_entropy(p: Column) -> Column:
    """-sum p ln p, with p held within 1e-10 and 1."""
    held = lambda x: F.least(F.greatest(x, F.lit(FLOOR)), F.lit(1.0))
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - held(x) * F.ln(held(x)))


def surprise(p: Column, choice: Column) -> Column:
    """-ln of the chosen option's probability, at least 1e-10."""
    return -F.ln(F.greatest(F.get(p, choice), F.lit(FLOOR)))


def change_point(pairwise: Column) -> Column:
    """1 less the probability of staying, from a joint over two states in turn; 0 where there is none."""
    stays = F.aggregate(F.transform(pairwise, lambda row, i: F.get(row, i)), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(1 - stays, F.lit(0.0))


def mixture_mean(p: Column, reward: Column) -> Column:
    """Mean reward of a state mixture."""
    return F.aggregate(F.zip_with(p, reward, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def mixture_variance(p: Column, reward: Column) -> Column:
    """Variance within and between the states of a Bernoulli mixture."""
    mean = mixture_mean(p, reward)
    within = F.aggregate(F.zip_with(p, reward, lambda a, b: a * b * (1 - b)), F.lit(0.0), lambda s, x: s + x)
    between = F.aggregate(F.zip_with(p, reward, lambda a, b: a * b * b), F.lit(0.0), lambda s, x: s + x) - mean * mean
    return within + F.greatest(between, F.lit(0.0))


def interval(mean: Column, covariance: Column, z: float) -> Column:
    """[low, high] of each component of a state, z deviations about its mean."""
    sd = F.transform(covariance, lambda row, i: F.sqrt(F.get(row, i)))
    return F.zip_with(mean, sd, lambda m, d: F.array(m - z * d, m + z * d))
