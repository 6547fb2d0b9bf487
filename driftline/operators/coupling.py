"""Couplings of spikes to oscillations of a field: latent from the field first, then regressions of spikes on it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators import kalman
from driftline.operators.oscillators import common_transition
from driftline.plans.fold import totals
from driftline.plans.lineage import reused


@dataclass(frozen=True)
class Field:
    """Bands of the field: frequencies, decay in (0, 1), variances of their noise and of the field's, and the step."""

    freqs: np.ndarray
    decay: np.ndarray
    noise: np.ndarray
    field_noise: float
    dt: float

    def __post_init__(self):
        if not ((np.asarray(self.decay) > 0) & (np.asarray(self.decay) < 1)).all():
            raise ValueError("decay lies strictly between 0 and 1")

    def linear(self) -> kalman.Linear:
        d = 2 * len(self.freqs)
        q = np.diag(np.repeat(np.asarray(self.noise, float), 2))
        spread = np.diag(np.repeat(np.asarray(self.noise) / (1 - np.asarray(self.decay) ** 2), 2))
        return kalman.Linear(common_transition(self.freqs, self.decay, 1 / self.dt), q, np.eye(d), self.field_noise * np.eye(d), np.zeros(d), spread)


def smoothed_field(field_rows: DataFrame, params: Field, key: str = "series_id", order: str = "t", y: str = "lfp", keep=()) -> DataFrame:
    """(key, order, keep, x): the latent's smoothed mean from the field alone."""
    got = kalman.filtered(field_rows.select(key, order, F.col(y).alias("y")), params.linear(), key, order)
    p = params.linear()
    rows = kalman.smoothed(got, p.A, p.Q, key, order, ())
    out = rows.select(key, order, F.col("ms").alias("x"))
    return out.join(field_rows.select(key, order, *keep), [key, order]) if keep else out


def _held(eta):
    return np.clip(eta, -30, 30)


def laplace_couplings(rows: DataFrame, baseline: np.ndarray, sigma: float = 5.0, max_iter: int = 10, x: str = "x", spikes: str = "spikes") -> tuple[np.ndarray, np.ndarray]:
    """Means (neurons, 2 bands) and covariances of couplings under a N(0, sigma^2) prior: Newton steps for all neurons in one job each."""
    rows = reused(rows.select(x, spikes))
    S = len(baseline)
    d = len(rows.select(x).first()[0])
    b = np.zeros((S, d))
    for _ in range(max_iter):
        def make(v, b=b):
            p = 1 / (1 + np.exp(-_held(v[x] @ b.T + baseline)))
            return {"g": (v[spikes] - p).T @ v[x], "h": np.einsum("ns,na,nb->sab", p * (1 - p), v[x], v[x])}

        s = totals(rows, [x, spikes], make)
        prec = s["h"] + np.eye(d) / sigma**2
        move = np.linalg.solve(prec, (s["g"] - b / sigma**2)[..., None])[..., 0]
        if not np.isfinite(move).all():
            raise FloatingPointError("the regression of spikes diverged")
        b = b + move
        if np.abs(move).max() < 1e-8:
            break
    return b, np.linalg.inv(prec)


def polya_gamma_mean(eta: np.ndarray) -> np.ndarray:
    """Mean of PG(1, eta)."""
    e = np.abs(eta)
    return np.where(e < 1e-6, 0.25, np.tanh(e / 2) / (2 * np.maximum(e, 1e-12)))


def _uniform(counter: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from whole ones, by the finaliser of SplitMix64."""
    x = counter * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


#: Where the two forms of the density's terms meet.
_MEET = 0.64


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    from math import erfc

    return 0.5 * np.vectorize(erfc, otypes=[float])(-np.asarray(x) / 2**0.5)


def _term(n: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Term n of the alternating series of the density at x, each form where its terms fall."""
    k = n + 0.5
    left = np.exp(1.5 * np.log(2 / (np.pi * x)) - 2 * k**2 / x)
    return np.pi * k * np.where(x > _MEET, np.exp(-0.5 * k**2 * np.pi**2 * x), left)


def draw_polya_gamma(eta: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Exact draws of PG(1, eta), one for each seed, in rounds over all that are not yet accepted.

    A proposal is an exponential tail or a truncated inverse Gaussian; whether it is accepted is settled by the partial
    sums of an alternating series, which close in on the density from both sides. Numbers are drawn by a seed's own
    counter, so a draw depends on nothing but its eta and seed.
    """
    z = np.abs(np.ravel(np.asarray(eta, float))) / 2
    seed, count = np.ravel(seeds).astype(np.uint64), np.zeros(z.size, np.uint64)
    with np.errstate(over="ignore"):
        seed = seed * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)

    def uniform(at):
        count[at] += np.uint64(1)
        with np.errstate(over="ignore"):
            return _uniform(seed[at] + count[at] * np.uint64(0xA24BAED4963EE407))

    rate = np.pi**2 / 8 + z**2 / 2
    right = np.pi / (2 * rate) * np.exp(-rate * _MEET)
    root = _MEET**-0.5
    # chance that an inverse Gaussian of mean 1/z stays below _MEET, times 2 exp(-z)
    with np.errstate(over="ignore", invalid="ignore"):
        far = np.exp(np.minimum(z, 700)) * _normal_cdf(-root * (_MEET * z + 1))
    left = 2 * (np.exp(-z) * _normal_cdf(root * (_MEET * z - 1)) + np.where(z < 700, far, 0.0))
    out, open_ = np.zeros(z.size), np.arange(z.size)
    while len(open_):
        x = np.zeros(len(open_))
        tail = uniform(open_) < right[open_] / (right[open_] + left[open_])
        x[tail] = _MEET - np.log(uniform(open_[tail])) / rate[open_[tail]]
        x[~tail] = _truncated_inverse_gaussian(z[open_[~tail]], open_[~tail], uniform)
        total = _term(np.zeros(len(x)), x)
        goal = uniform(open_) * total
        verdict, n = np.zeros(len(x), np.int8), 0  # 1 accepted, -1 refused
        while (todo := np.flatnonzero(verdict == 0)).size:
            n += 1
            step = _term(np.full(len(todo), float(n)), x[todo])
            if n % 2:
                total[todo] -= step
                verdict[todo[goal[todo] <= total[todo]]] = 1
            else:
                total[todo] += step
                verdict[todo[goal[todo] > total[todo]]] = -1
        won = verdict == 1
        out[open_[won]] = x[won] / 4
        open_ = open_[~won]
    return out.reshape(np.shape(eta))


def _truncated_inverse_gaussian(z: np.ndarray, at: np.ndarray, uniform) -> np.ndarray:
    """Inverse Gaussian of mean 1 / z and shape 1 below _MEET."""
    x, wide = np.zeros(len(z)), z < 1 / _MEET
    todo = np.flatnonzero(wide)  # a mean beyond the bound: scaled from the inverse chi-square, thinned
    while len(todo):
        e, f = -np.log(uniform(at[todo])), -np.log(uniform(at[todo]))
        drawn = _MEET / (1 + _MEET * e) ** 2
        good = (e**2 <= 2 * f / _MEET) & (uniform(at[todo]) <= np.exp(-0.5 * z[todo] ** 2 * drawn))
        x[todo[good]] = drawn[good]
        todo = todo[~good]
    todo = np.flatnonzero(~wide)  # else drawn whole until it is below
    while len(todo):
        mean = 1 / z[todo]
        normal = np.sqrt(-2 * np.log(uniform(at[todo]))) * np.cos(2 * np.pi * uniform(at[todo]))
        y = normal**2
        drawn = mean + 0.5 * mean**2 * y - 0.5 * mean * np.sqrt(4 * mean * y + (mean * y) ** 2)
        drawn = np.where(uniform(at[todo]) > mean / (mean + drawn), mean**2 / drawn, drawn)
        good = drawn < _MEET
        x[todo[good]] = drawn[good]
        todo = todo[~good]
    return x


def gibbs_couplings(rows: DataFrame, baseline: np.ndarray, n_iter: int = 60, burn_in: int = 20, sigma: float = 5.0, seed: int = 0, x: str = "x", spikes: str = "spikes", t: str = "t", key: str = "series_id") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, covariances and kept draws (draws, neurons, 2 bands): each sweep draws one Polya-Gamma variable for every row and neuron in one job.

    A row's draws come from a hash of seed, sweep, series, time and neuron, so they do not depend on batches or on lost tasks.
    """
    rows = reused(rows.select(x, spikes, F.xxhash64(F.lit(seed), key, t).alias("__seed")))
    S, d = len(baseline), len(rows.select(x).first()[0])
    driver = np.random.default_rng(seed)
    b, kept = np.zeros((S, d)), []
    for sweep in range(n_iter):
        def make(v, b=b, sweep=sweep):
            with np.errstate(over="ignore"):
                each = (v["__seed"].view(np.uint64)[:, None] + np.uint64(sweep)) * np.uint64(2 * S + 1) + np.arange(S, dtype=np.uint64)
            w = draw_polya_gamma(v[x] @ b.T + baseline, each)
            k = v[spikes] - 0.5 - w * baseline
            return {"h": np.einsum("ns,na,nb->sab", w, v[x], v[x]), "g": k.T @ v[x]}

        s = totals(rows, [x, spikes, "__seed"], make)
        cov = np.linalg.inv(s["h"] + np.eye(d) / sigma**2)
        mean = np.einsum("sab,sb->sa", cov, s["g"])
        b = mean + np.einsum("sab,sb->sa", np.linalg.cholesky(cov), driver.standard_normal((S, d)))
        if sweep >= burn_in:
            kept.append(b)
    kept = np.array(kept)
    return kept.mean(0), np.array([np.cov(kept[:, s].T).reshape(d, d) for s in range(S)]), kept


def coupling_rows(mean: np.ndarray, cov: np.ndarray) -> list[tuple]:
    """(neuron, band, re, im, var_re, var_im, cov) rows of interleaved couplings."""
    return [
        (s, j, *map(float, (mean[s, 2 * j], mean[s, 2 * j + 1], cov[s, 2 * j, 2 * j], cov[s, 2 * j + 1, 2 * j + 1], cov[s, 2 * j, 2 * j + 1])))
        for s in range(len(mean)) for j in range(mean.shape[1] // 2)
    ]


def cross_check(field_rows: DataFrame, params: Field, baseline: np.ndarray, truth: np.ndarray, sweeps: int = 60) -> list[dict]:
    """Both estimators on the same smoothed latent: share of true couplings within 95 per cent, mean bias, interval width."""
    rows = smoothed_field(field_rows, params, keep=("spikes",))
    out = []
    for name, (mean, cov) in (("laplace", laplace_couplings(rows, baseline)), ("gibbs", gibbs_couplings(rows, baseline, sweeps)[:2])):
        sd = np.sqrt(np.einsum("saa->sa", cov))
        inside = np.abs(mean - truth) <= 1.96 * sd
        out.append({"estimator": name, "coverage": float(inside.mean()), "bias": float((mean - truth).mean()), "width": float(2 * 1.96 * sd.mean())})
    return out


def scaled(couplings: np.ndarray, scale: float) -> np.ndarray:
    """Couplings of another magnitude and the same phases."""
    from driftline.operators.checks import scalar

    return np.asarray(couplings) * scalar(scale, "scale", nonnegative=True)


def averaged(spark, records: list[dict], by: str = "magnitude"):
    """(by, estimator, n, metric means) of cross-checks over replicates; numbers that are not finite are passed over."""
    if not records:
        raise ValueError("there are no records to average")
    rows = spark.createDataFrame([{k: v if isinstance(v, str) else float(v) for k, v in r.items()} for r in records])
    metrics = [c for c in rows.columns if c not in (by, "estimator")]
    live = lambda c: F.avg(F.when(~F.isnan(c), F.col(c))).alias(c)
    return rows.groupBy(F.round(by, 4).alias(by), "estimator").agg(F.count("*").alias("n"), *[live(c) for c in metrics])
