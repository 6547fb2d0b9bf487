"""Links, special functions and kernel coefficients as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def softplus(x: Column) -> Column:
    """ln(1 + e^x), without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def expected_count(log_rate: Column, dt: float) -> Column:
    """exp of the log rate plus ln dt, held within -20 and 20."""
    return F.exp(F.least(F.greatest(log_rate + math.log(dt), F.lit(-20.0)), F.lit(20.0)))


def softmax(values: Column) -> Column:
    """Of an array; the largest value is taken off first."""
    top = F.array_max(values)
    shifted = F.transform(values, lambda v: F.exp(v - top))
    total = F.aggregate(shifted, F.lit(0.0), lambda s, v: s + v)
    return F.transform(shifted, lambda v: v / total)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for positive x: Stirling's series after moving x above 7."""
    moved = F.aggregate(F.sequence(F.lit(0), F.lit(6)), F.lit(0.0), lambda s, k: s + F.ln(x + k))
    z = x + 7.0
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - moved


def poisson_log_likelihood(n: Column, mean: Column) -> Column:
    return n * F.ln(mean) - mean - log_gamma(n + 1.0)


def normal_cdf(x: Column) -> Column:
    """By the series of the error function within 6, and 0 or 1 beyond; x is worked out once, not at each term."""
    return F.transform(F.array(x), _normal_cdf)[0]


def _normal_cdf(x: Column) -> Column:
    z = F.abs(x) / math.sqrt(2.0)
    # erf(z) = 2/sqrt(pi) exp(-z^2) sum_k 2^k z^(2k+1) / (1 * 3 * ... * (2k+1))
    first = F.struct(z.alias("term"), z.alias("total"))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(90)),
        first,
        lambda s, k: F.struct(
            (s["term"] * 2 * z * z / (2 * k + 1)).alias("term"),
            (s["total"] + s["term"] * 2 * z * z / (2 * k + 1)).alias("total"),
        ),
        lambda s: s["total"],
    )
    erf = F.when(z > 6, F.lit(1.0)).otherwise(2 / math.sqrt(math.pi) * F.exp(-z * z) * series)
    return F.when(x < 0, (1 - erf) / 2).otherwise((1 + erf) / 2)


def matern32(lengthscale: float, variance: float, dt: float) -> dict[str, tuple]:
    """Transition, process noise and stationary covariance of a Matern-3/2 process as nested tuples."""
    return _matern32(lengthscale, variance, dt, math.exp, lambda small, near, far: near() if small else far(), math.sqrt)


def matern32_columns(lengthscale: Column, variance: Column, dt: float) -> dict[str, tuple]:
    """The same with columns."""
    return _matern32(lengthscale, variance, dt, F.exp, lambda small, near, far: F.when(small, near()).otherwise(far()), math.sqrt)


def _matern32(lengthscale, variance, dt, exp, either, sqrt):
    lam = sqrt(3) / lengthscale
    x = lam * dt
    e, e2 = exp(-x), exp(-2 * x)
    small = x <= 0.05  # leading terms of the same closed form, which cancels near 0
    q11 = either(small, lambda: variance * (4 / 3 * x**3 - 2 * x**4 + 8 / 5 * x**5), lambda: variance * (1 - e2 * ((1 + x) ** 2 + x**2)))
    q12 = either(small, lambda: variance * lam * (2 * x**2 - 4 * x**3 + 4 * x**4), lambda: variance * lam * (2 * x**2 * e2))
    q22 = either(small, lambda: variance * lam**2 * (4 * x - 8 * x**2 + 28 / 3 * x**3), lambda: variance * lam**2 * (1 - e2 * ((1 - x) ** 2 + x**2)))
    a = ((e * (1 + x), e * dt), (-e * lam * lam * dt, e * (1 - x)))
    return {"A": a, "Q": ((q11, q12), (q12, q22)), "P": ((variance, 0.0), (0.0, lam * lam * variance))}


def log_normal_rate(mean: Column, variance: Column, z: float) -> tuple[Column, Column, Column]:
    """Posterior mean of exp(g), which has half the variance in it, and the bounds at z deviations."""
    return F.exp(mean + variance / 2), F.exp(mean - z * F.sqrt(variance)), F.exp(mean + z * F.sqrt(variance))
