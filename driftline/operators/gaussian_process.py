"""Rates of counts under a Matern-3/2 process, as a state-space model iterated to its mode."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.links import log_normal_rate, matern32
from driftline.operators.matrices import log_gamma, mv, normal_quantile, psd_solve, symmetric, transposed
from driftline.plans.fold import fold, totals
from driftline.plans.lineage import reused

LEAST_WEIGHT = 1e-4


@dataclass(frozen=True)
class RateProcess:
    dt: float
    variance: float = 1.0
    lengthscale: float = 1.0
    mean: float = 0.0


def site(g: np.ndarray, y: np.ndarray, offset: float) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian observation that stands for a count at the current mode: value and variance."""
    w = np.maximum(np.exp(np.minimum(g + offset, 50)), LEAST_WEIGHT)
    return g + (y - np.exp(np.minimum(g + offset, 50))) / w, 1 / w


def infer(counts: DataFrame, model: RateProcess, n_iter: int = 8, key: str = "unit_id", order: str = "t", y: str = "n", cut: Callable[[DataFrame], DataFrame] = reused, every: int = 4) -> DataFrame:
    """(key, order, y, g, var, ev): mode and variance of the log rate, and each row's share of the Laplace evidence.

    Each iteration is a pass forward and one backward; `cut` writes every fourth to the shared folder, so that lineage stays short.
    """
    k = matern32(model.lengthscale, model.variance, model.dt)
    A, Q, P = (np.array(k[c]) for c in ("A", "Q", "P"))
    offset = model.mean + float(np.log(model.dt))
    rows = counts.select(key, order, y, F.lit(0.0).alias("g"))

    def start(n):
        return {"m": np.zeros((n, 2)), "V": np.repeat(P[None], n, 0)}

    def ahead(s, x, fresh):
        pm = np.where(fresh[:, None], s["m"], mv(A, s["m"]))
        pv = np.where(fresh[:, None, None], s["V"], symmetric(A @ s["V"] @ A.T + Q))
        value, r = site(x["g"], x[y], offset)
        total = pv[:, 0, 0] + r
        gain = pv[:, :, 0] / total[:, None]
        m = pm + gain * (value - pm[:, 0])[:, None]
        V = symmetric(pv - gain[:, :, None] * pv[:, 0, None, :])
        ll = -0.5 * (np.log(2 * np.pi * total) + (value - pm[:, 0]) ** 2 / total)
        sites = -0.5 * (np.log(2 * np.pi * r) + (value - x["g"]) ** 2 / r)
        eta = x["g"] + offset
        counted = x[y] * eta - np.exp(np.minimum(eta, 50)) - log_gamma(x[y] + 1.0)
        return {"m": m, "V": V}, {"m": m, "V": V, "ev": ll + counted - sites}

    def begin(n):
        return {"m": np.zeros((n, 2)), "V": np.zeros((n, 2, 2))}

    def back(s, x, fresh):
        up = symmetric(A @ x["V"] @ A.T + Q)
        j = transposed(psd_solve(up, A @ x["V"]))
        m = x["m"] + mv(j, s["m"] - mv(A, x["m"]))
        V = symmetric(x["V"] + j @ (s["V"] - up) @ transposed(j))
        m, V = np.where(fresh[:, None], x["m"], m), np.where(fresh[:, None, None], x["V"], V)
        return {"m": m, "V": V}, {"g": m[:, 0], "var": V[:, 0, 0]}

    for k in range(1, n_iter + 1):
        forward = fold(rows, key, order, start, ahead, {"m": 1, "V": 2, "ev": 0}, ["g", y], [y])
        rows = fold(forward, key, order, begin, back, {"g": 0, "var": 0}, ["m", "V"], [y, "ev"], backward=True)
        rows = cut(rows) if k % every == 0 and k < n_iter else rows
    return rows


def evidence(inferred: DataFrame) -> float:
    return float(totals(inferred, ["ev"], lambda x: {"ev": np.array(x["ev"].sum())})["ev"])


def rates(inferred: DataFrame, model: RateProcess, level: float = 0.95) -> DataFrame:
    """Adds rate, low and high; the mean of the rate has half the variance in it."""
    rate, low, high = log_normal_rate(F.col("g") + model.mean, F.col("var"), normal_quantile(0.5 + level / 2))
    return inferred.withColumns({"rate": rate, "low": low, "high": high})


def fit(counts: DataFrame, model: RateProcess, steps: int = 10, rate: float = 5e-2, n_iter: int = 6, **how):
    """Adam over variance, lengthscale and mean by the evidence; each value takes one inference over the data."""
    from driftline.plans import fitting

    spec = {"variance": fitting.POSITIVE, "lengthscale": fitting.POSITIVE, "mean": fitting.UNCONSTRAINED}
    at = {k: np.array([getattr(model, k)], float) for k in spec}
    n = counts.count()
    put = lambda p: RateProcess(model.dt, **{k: float(p[k][0]) for k in spec})
    got = fitting.adam(at, spec, lambda ps: [-evidence(infer(counts, put(p), n_iter, **how)) / n for p in ps], steps, rate)
    return fitting.Fit(put(got.params), [x * n for x in got.log_likelihoods], got.converged)
