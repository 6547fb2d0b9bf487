"""Learning curves from trials that succeed or fail: filter, smoother, fit, criteria.

The learning state walks at random; a trial's successes are binomial with the log odds of
chance plus the state.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.functions.links import normal_cdf, sigmoid
from driftline.operators.matrices import log_gamma, normal_quantile
from driftline.operators.preprocessing import runs
from driftline.plans.fitting import POSITIVE, UNCONSTRAINED, Fit, by_gradient, em
from driftline.plans.fold import fold, fold_sums, totals


@dataclass(frozen=True)
class Learner:
    """x_t = x_{t-1} + N(0, sigma^2); successes ~ Binomial(possible, sigmoid(bias + x)); x_0 ~ N(x0, v0)."""

    sigma: float = 0.5
    chance: float = 0.5
    x0: float = 0.0
    v0: float | None = None

    @property
    def bias(self) -> float:
        return float(np.log(self.chance / (1 - self.chance)))

    @property
    def start_variance(self) -> float:
        return self.sigma**2 if self.v0 is None else self.v0


def steps_of(model: Learner, correct: str = "n_correct", possible: str = "n_possible", steps: int = 10):
    """start and step of the filter."""

    def start(n):
        return {"m": np.full(n, model.x0), "v": np.full(n, model.start_variance)}

    def step(s, x, fresh):
        y, n = x[correct].astype(float), x[possible].astype(float)
        pm, pv = s["m"], s["v"] + model.sigma**2
        m = pm.copy()
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(model.bias + m)))
            m = m + (y - n * p - (m - pm) / pv) / (n * p * (1 - p) + 1 / pv)
        p = 1 / (1 + np.exp(-(model.bias + m)))
        v = 1 / (n * p * (1 - p) + 1 / pv)
        eta = model.bias + m
        ways = log_gamma(n + 1) - log_gamma(y + 1) - log_gamma(n - y + 1)
        ll = ways + y * eta - n * np.logaddexp(0, eta) - 0.5 * (m - pm) ** 2 / pv - 0.5 * np.log(pv) + 0.5 * np.log(v)
        return {"m": m, "v": v}, {"m": m, "v": v, "pm": pm, "pv": pv, "ll": ll}

    return start, step


def filtered(trials: DataFrame, model: Learner, key: str = "series_id", order: str = "t", correct: str = "n_correct", possible: str = "n_possible", steps: int = 10) -> DataFrame:
    """(key, order, correct, possible, m, v, pm, pv, ll, first): mode by Newton steps, variance by its curvature."""
    return fold(trials, key, order, *steps_of(model, correct, possible, steps), {"m": 0, "v": 0, "pm": 0, "pv": 0, "ll": 0, "first": 0}, [correct, possible], [correct, possible])


def smoothed(rows: DataFrame, key: str = "series_id", order: str = "t", keep=("ll",)) -> DataFrame:
    """(key, order, keep, ms, vs, g, next_m, next_v, last): g is the gain toward the next trial, 1 at the last."""

    def start(n):
        return {k: np.zeros(n) for k in ("m", "v", "pm")} | {"pv": np.ones(n)}

    def step(s, x, fresh):
        g = np.where(fresh, 1.0, x["v"] / s["pv"])
        m = np.where(fresh, x["m"], x["m"] + g * (s["m"] - s["pm"]))
        v = np.where(fresh, x["v"], x["v"] + g * g * (s["v"] - s["pv"]))
        return {"m": m, "v": v, "pm": x["pm"], "pv": x["pv"]}, {"ms": m, "vs": v, "g": g, "next_m": s["m"], "next_v": s["v"], "last": fresh.astype(float)}

    return fold(rows, key, order, start, step, {"ms": 0, "vs": 0, "g": 0, "next_m": 0, "next_v": 0, "last": 0}, ["m", "v", "pm", "pv"], keep, backward=True)


def fit(trials: DataFrame, model: Learner, max_iter: int = 20, tolerance: float = 1e-4, initial: str = "reestimate", key: str = "series_id", order: str = "t") -> Fit:
    """EM for sigma and the initial state; initial: reestimate, set, or user (left as it is)."""

    def e_step(model):
        def make(x):
            go, first = x["last"] == 0, x["first"] > 0
            d = x["next_m"] - x["ms"]
            each = d * d + x["next_v"] + x["vs"] - 2 * x["g"] * x["next_v"]
            return {"q": np.array(each[go].sum()), "n": np.array([go.sum(), first.sum()], float), "x0": np.array(x["ms"][first].sum()), "ll": np.array(x["ll"].sum())}

        s = totals(smoothed(filtered(trials, model, key, order), key, order, ("ll", "first")), ["first", "ms", "vs", "g", "next_m", "next_v", "last", "ll"], make)
        return float(s["ll"]), s

    def m_step(model, s):
        new = replace(model, sigma=float(np.sqrt(max(s["q"] / max(s["n"][0], 1), 1e-12))))
        return replace(new, x0=float(s["x0"] / s["n"][1])) if initial == "reestimate" else new

    return em(model, e_step, m_step, max_iter, tolerance)


def score(trials: DataFrame, model: Learner, key: str = "series_id", order: str = "t") -> tuple[float, dict[str, float]]:
    """Log evidence and its gradient in sigma and x0: the filter, and one pass back over it with the slopes of what follows.

    The mode's own slope comes from the equation that it solves.
    """
    rows = filtered(trials, model, key, order)

    def start(n):
        return {"m": np.zeros(n), "v": np.zeros(n)}

    def step(s, x, fresh):
        n, m, pm, pv, v = (x[c].astype(float) for c in ("n_possible", "m", "pm", "pv", "v"))
        p = 1 / (1 + np.exp(-(model.bias + m)))
        off = m - pm
        gv = s["v"] + 0.5 / v
        gm = s["m"] - gv * v * v * n * p * (1 - p) * (1 - 2 * p)
        to_m = off / pv + gm * v / pv
        to_v = 0.5 * off**2 / pv**2 - 0.5 / pv + gv * v * v / pv**2 + gm * v * off / pv**2
        return {"m": to_m, "v": to_v}, {"q": to_v, "ll": x["ll"]}

    s = fold_sums(rows, key, order, start, step, ["n_possible", "m", "pm", "pv", "v", "ll"], backward=True)
    q = s["q"] + (s["carry v"] if model.v0 is None else 0)
    return float(s["ll"]), {"sigma": float(2 * model.sigma * q), "x0": float(s["carry m"])}


def fit_gradient(trials: DataFrame, model: Learner, steps: int = 50, rate: float = 1e-2, learn: tuple[str, ...] = ("sigma", "x0"), key: str = "series_id", order: str = "t") -> Fit:
    """Adam over sigma and the initial state by the filter's evidence."""
    spec = {"sigma": POSITIVE, "x0": UNCONSTRAINED}
    put = lambda p: replace(model, **{c: float(p[c][0]) for c in learn})

    def value(p):
        ll, g = score(trials, put(p), key, order)
        return ll, {c: np.array([g[c]]) for c in learn}

    got = by_gradient({c: np.array([getattr(model, c)], float) for c in learn}, {c: spec[c] for c in learn}, None, trials.count(), steps, rate, score=value)
    return Fit(put(got.params), got.log_likelihoods, got.converged)


def curve(rows: DataFrame, model: Learner, percentiles: tuple[float, ...] = (5.0, 50.0, 95.0)) -> DataFrame:
    """Adds p<percentile> of the chance of success, and above: the chance that it exceeds chance level.

    Percentiles of the state go through the rising link, so no sampling is needed.
    """
    sd = F.sqrt("vs")
    made = {f"p{q:g}": sigmoid(model.bias + F.col("ms") + normal_quantile(q / 100) * sd) for q in percentiles}
    return rows.withColumns(made | {"above": normal_cdf(F.col("ms") / F.greatest(sd, F.lit(1e-12)))})


def criterion_trial(rows: DataFrame, alpha: float = 0.05, key: str = "series_id", order: str = "t") -> DataFrame:
    """(key, trial): the one after the last trial whose chance of lying above chance is below 1 - alpha; 0 if none is, null if the last is."""
    fails = F.col("above") < 1 - alpha
    got = rows.groupBy(key).agg(F.max(order).alias("__end"), F.max(F.when(fails, F.col(order))).alias("__fail"))
    return got.select(key, F.when(F.col("__fail") == F.col("__end"), None).otherwise(F.coalesce(F.col("__fail") + 1, F.lit(0))).alias("trial"))


def chance_of_run(p: float, run: int, length: int) -> float:
    """Chance of at least one run of `run` successes in `length` trials."""
    # chance of no run so far, by the trial at which the first run ends
    done = np.zeros(length + 1)
    for t in range(run, length + 1):
        done[t] = p**run if t == run else (1 - done[: t - run].sum()) * (1 - p) * p**run
    return float(done.sum())


def critical_run(p: float, length: int, threshold: float = 0.05, least: int = 2, most: int = 35) -> int | None:
    """The shortest run whose chance is below the threshold."""
    return next((k for k in range(least, most + 1) if chance_of_run(p, k, length) < threshold), None)


def significant_runs(trials: DataFrame, success: Column, chance: float, length: int, key: str = "series_id", order: str = "t", **how) -> DataFrame:
    """(key, start, end, length): runs of successes no shorter than the critical length for series of `length` trials."""
    need = critical_run(chance, length, **how)
    found = runs(trials, success, key, order)
    return found.filter(F.col("length") >= need) if need is not None else found.filter(F.lit(False))


def first_better(comparisons: DataFrame, reference: int = 0, level: float = 0.05, key: str = "series_id") -> DataFrame:
    """(key, trial): the first trial j with P(x_reference > x_j) below half the level, told by z, so that no chance is worked out."""
    return comparisons.filter((F.col("i") == reference) & (F.col("z") < normal_quantile(level / 2))).groupBy(key).agg(F.min("j").alias("trial"))


def null_log_likelihood(trials: DataFrame, chance: float, correct: str = "n_correct", possible: str = "n_possible") -> DataFrame:
    """One row, ll: trials at chance level throughout."""
    from driftline.functions.links import log_gamma as lg

    y, n = F.col(correct).cast("double"), F.col(possible).cast("double")
    ways = lg(n + 1.0) - lg(y + 1.0) - lg(n - y + 1.0)
    return trials.agg(F.sum(ways + y * float(np.log(chance)) + (n - y) * float(np.log1p(-chance))).alias("ll"))


def gaps(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with the step since the row before."""
    return rows.withColumn("step", F.col(order) - F.lag(order).over(Window.partitionBy(key).orderBy(order)))
