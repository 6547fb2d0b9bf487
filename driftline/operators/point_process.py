"""Filters of counts and choices by Laplace updates, and regressions of spikes on states.

An update takes Fisher steps from the predicted mean; one step by default. The evidence is the
log density at the mode with the volumes of prior and posterior.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from driftline.operators import kalman
from driftline.operators.diagnostics import marks, of_moments
from driftline.operators.matrices import log_det, log_gamma, mv, project_psd, psd_solve, symmetric, transposed, vec_solve
from driftline.plans.fitting import PSD_MATRIX, UNCONSTRAINED, Fit, by_gradient, em
from driftline.plans.fold import evidence, fold, fold_sums, totals
from driftline.plans.lineage import reused

MOST_LOG_COUNT = 20.0


@dataclass(frozen=True)
class Family:
    """mean(eta), weight(eta, mean), loglik(y, eta, mean) of a canonical link."""

    mean: Callable
    weight: Callable
    loglik: Callable


def poisson(dt: float, most: float = MOST_LOG_COUNT) -> Family:
    """Counts of rate exp(eta) in bins of dt; the log of the expected count is held within -20 and `most`."""
    held = lambda eta: np.clip(eta + np.log(dt), -20.0, most)
    return Family(
        lambda eta: np.exp(held(eta)),
        lambda eta, mu: mu,
        lambda y, eta, mu: y * held(eta) - mu - log_gamma(y + 1.0),
    )


def bernoulli() -> Family:
    """0 or 1 with log odds eta, held within 30."""
    held = lambda eta: np.clip(eta, -30.0, 30.0)
    return Family(
        lambda eta: 1 / (1 + np.exp(-held(eta))),
        lambda eta, mu: mu * (1 - mu),
        lambda y, eta, mu: y * held(eta) - np.logaddexp(0, held(eta)),
    )


def binomial(n: np.ndarray) -> Family:
    """n trials with log odds eta each, without the count of orders' factor left out."""
    ways = lambda y: log_gamma(n + 1.0) - log_gamma(y + 1.0) - log_gamma(n - y + 1.0)
    held = lambda eta: np.clip(eta, -30.0, 30.0)
    return Family(
        lambda eta: n / (1 + np.exp(-held(eta))),
        lambda eta, mu: mu * (1 - mu / n),
        lambda y, eta, mu: y * held(eta) - n * np.logaddexp(0, held(eta)) + ways(y),
    )


def laplace(pm, pv, y, Z, offset, family: Family, steps: int = 1, normalised: bool = True):
    """Mode, covariance and log evidence of rows with eta = Z x + offset; more steps add the prior's pull and halvings."""
    prec = psd_solve(pv, np.broadcast_to(np.eye(pm.shape[-1]), pv.shape))
    value = lambda x: (
        family.loglik(y, mv(Z, x) + offset, family.mean(mv(Z, x) + offset)).sum(-1) - 0.5 * ((x - pm) * mv(prec, x - pm)).sum(-1)
    )
    x = pm
    for k in range(steps):
        eta = mv(Z, x) + offset
        mu = family.mean(eta)
        info = symmetric(prec + transposed(Z) @ (family.weight(eta, mu)[..., None] * Z))
        move = vec_solve(info, mv(transposed(Z), y - mu) - (mv(prec, x - pm) if k else 0))
        if steps > 1:
            before, scale = value(x), np.ones(x.shape[:-1])
            for _ in range(10):
                worse = value(x + scale[..., None] * move) < before
                if not worse.any():
                    break
                scale = np.where(worse, scale / 2, scale)
            move = np.where((value(x + scale[..., None] * move) >= before)[..., None], scale[..., None] * move, 0)
        x = x + move
    if steps > 1:
        eta = mv(Z, x) + offset
        info = symmetric(prec + transposed(Z) @ (family.weight(eta, family.mean(eta))[..., None] * Z))
    P = symmetric(psd_solve(info, np.broadcast_to(np.eye(pm.shape[-1]), info.shape)))
    if not normalised:
        eta = mv(Z, x) + offset
        return x, P, family.loglik(y, eta, family.mean(eta)).sum(-1)
    return x, P, value(x) - 0.5 * log_det(pv) + 0.5 * log_det(P)


@dataclass(frozen=True)
class Counts:
    """x_t = A x_{t-1} + N(0, Q); counts of units with log rates Z x. The prior is that of x_0."""

    A: np.ndarray
    Q: np.ndarray
    m0: np.ndarray
    P0: np.ndarray
    dt: float
    steps: int = 1


def steps_of(model: Counts, y: str = "n", design: str = "z", family: Family | None = None):
    """start and step of the filter."""
    family = family or poisson(model.dt)

    def start(n):
        return {"m": np.repeat(model.m0[None], n, 0).astype(float), "V": np.repeat(model.P0[None], n, 0).astype(float)}

    def step(s, x, fresh):
        pm, pv = mv(model.A, s["m"]), symmetric(model.A @ s["V"] @ model.A.T + model.Q)
        Z = x[design][:, None, :]
        m, P, ll = laplace(pm, pv, x[y][:, None].astype(float), Z, 0.0, family, model.steps)
        eta = (x[design] * m).sum(1) + np.log(model.dt)
        return {"m": m, "V": P}, {"m": m, "V": P, "ll": ll, "diag": marks(saturated=(eta > MOST_LOG_COUNT) | (eta < -20.0), **of_moments(m, P))}

    return start, step


def filtered(series: DataFrame, model: Counts, key: str = "unit_id", order: str = "t", y: str = "n", design: str = "z", family: Family | None = None, keep=()) -> DataFrame:
    """(key, order, y, design, m, V, ll, first, diag); `design` holds the row's weights of the state, y one count.

    Units are independent given their own states, so each is a series: no dense state of all units is built.
    """
    return fold(series, key, order, *steps_of(model, y, design, family), {"m": 1, "V": 2, "ll": 0, "first": 0, "diag": 0}, [y, design], [y, design, *keep])


def blocks_of(model: Counts, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(state numbers, unit numbers) of each part of a dense model that shares nothing with the others; weights: (units, d)."""
    d = len(model.m0)
    joined = (model.A != 0) | (model.A.T != 0) | (model.Q != 0) | (model.P0 != 0) | (np.abs(weights.T) @ np.abs(weights) > 0)
    label = np.arange(d)
    for _ in range(d):
        label = np.where(joined, label[None, :], d).min(axis=1).clip(max=label)
    seen = [np.flatnonzero(label == k) for k in np.unique(label)]
    return [(own, np.flatnonzero(np.abs(weights[:, own]).sum(1) > 0)) for own in seen]


@dataclass(frozen=True)
class Parts:
    """The parts of a dense model, filled up to one size: a state that a part lacks stands alone, a unit that it lacks says nothing."""

    own: list[np.ndarray]
    units: list[np.ndarray]
    A: np.ndarray
    Q: np.ndarray
    P0: np.ndarray
    m0: np.ndarray
    Z: np.ndarray
    there: np.ndarray

    def family(self, b: np.ndarray, dt: float) -> Family:
        """Poisson counts of the units that the parts b have."""
        f, there = poisson(dt), self.there[b]
        return Family(lambda eta: f.mean(eta) * there, lambda eta, mu: mu, lambda y, eta, mu: f.loglik(y, eta, mu) * there)


def parts_of(model: Counts, weights: np.ndarray) -> Parts:
    own, units = (list(x) for x in zip(*blocks_of(model, weights)))
    n, d, u = len(own), max(map(len, own)), max(1, *map(len, units))
    A, Q, P0, m0 = np.zeros((n, d, d)), np.tile(np.eye(d), (n, 1, 1)), np.tile(np.eye(d), (n, 1, 1)), np.zeros((n, d))
    Z, there = np.zeros((n, u, d)), np.zeros((n, u))
    for k, (o, w) in enumerate(zip(own, units)):
        at = np.ix_([k], range(len(o)), range(len(o)))
        A[at], Q[at], P0[at] = model.A[np.ix_(o, o)], model.Q[np.ix_(o, o)], model.P0[np.ix_(o, o)]
        m0[k, : len(o)], there[k, : len(w)] = model.m0[o], 1
        Z[np.ix_([k], range(len(w)), range(len(o)))] = weights[np.ix_(w, o)]
    return Parts(own, units, A, Q, P0, m0, Z, there)


def _filtered_parts(series: DataFrame, model: Counts, parts: Parts, key: str, order: str, y: str) -> DataFrame:
    """(__series, key, order, block, m, V, ll, first): all parts of all series in one pass, states filled up."""
    from pyspark.sql import functions as F

    u, d = parts.Z.shape[1:]
    counts = [F.array(*[F.get(y, F.lit(int(w))).cast("double") for w in units], *[F.lit(0.0)] * (u - len(units))) for units in parts.units]
    each = F.array(*[F.struct(F.lit(k).alias("block"), x.alias("own")) for k, x in enumerate(counts)])
    rows = series.select(key, order, F.explode(each).alias("b")).select(key, order, "b.*")
    name = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("none"))  # an empty text is another key than none
    rows = rows.withColumn("__series", F.concat_ws(":", name, "block"))

    def start(n):
        return {"m": np.zeros((n, d)), "V": np.repeat(np.eye(d)[None], n, 0)}

    def step(s, x, fresh):
        b, e = x["block"].astype(int), fresh[:, None]
        m, V = np.where(e, parts.m0[b], s["m"]), np.where(e[..., None], parts.P0[b], s["V"])
        pm, pv = mv(parts.A[b], m), symmetric(parts.A[b] @ V @ transposed(parts.A[b]) + parts.Q[b])
        m, V, ll = laplace(pm, pv, x["own"], parts.Z[b], 0.0, parts.family(b, model.dt), model.steps)
        return {"m": m, "V": V}, {"m": m, "V": V, "ll": ll}

    return fold(rows, "__series", order, start, step, {"m": 1, "V": 2, "ll": 0, "first": 0}, ["block", "own"], [key, "block"])


def _trimmed(rows: DataFrame, parts: Parts, vectors: tuple[str, ...], matrices: tuple[str, ...]) -> DataFrame:
    """Each part's own states."""
    from pyspark.sql import functions as F

    n = F.element_at(F.array(*[F.lit(len(o)) for o in parts.own]), F.col("block") + 1)
    cut = lambda x: F.slice(x, F.lit(1), n)
    return rows.withColumns({c: cut(F.col(c)) for c in vectors} | {c: F.transform(cut(F.col(c)), cut) for c in matrices})


def filtered_blocks(series: DataFrame, model: Counts, weights: np.ndarray, key: str = "series_id", order: str = "t", y: str = "counts") -> DataFrame:
    """(key, order, block, m, V, ll) of a dense model of many units, block by block: rows hold an array of all units' counts.

    Each block is a series of its own; blocks of any size go in one pass. The dense filter's evidence is the sum over blocks.
    """
    parts = parts_of(model, weights)
    got = _filtered_parts(series, model, parts, key, order, y)
    return _trimmed(got, parts, ("m",), ("V",)).select(key, order, "block", "m", "V", "ll")


def _smoothed_parts(rows: DataFrame, parts: Parts, key: str, order: str) -> DataFrame:
    d = parts.m0.shape[1]

    def start(n):
        return {"m": np.zeros((n, d)), "V": np.zeros((n, d, d))}

    def step(s, x, fresh):
        b, e = x["block"].astype(int), fresh[:, None, None]
        m, P, c = kalman.rts(x["m"], x["V"], parts.A[b], parts.Q[b], (s["m"], s["V"]))
        m, P, c = np.where(e[..., 0], x["m"], m), np.where(e, x["V"], P), np.where(e, 0.0, c)
        return {"m": m, "V": P}, {"ms": m, "Vs": P, "cross": c, "next_m": s["m"], "last": fresh.astype(float)}

    into = {"ms": 1, "Vs": 2, "cross": 2, "next_m": 1, "last": 0}
    return fold(rows.withColumnRenamed("first", "begins"), "__series", order, start, step, into, ["block", "m", "V"], [key, "block", "ll", "begins"], backward=True)


def smoothed_blocks(series: DataFrame, model: Counts, weights: np.ndarray, key: str = "series_id", order: str = "t", y: str = "counts") -> DataFrame:
    """(key, order, block, ms, Vs, cross, ll): the dense model's smoother, block by block; states of different blocks are independent."""
    parts = parts_of(model, weights)
    got = _smoothed_parts(_filtered_parts(series, model, parts, key, order, y), parts, key, order)
    return _trimmed(got, parts, ("ms",), ("Vs", "cross")).select(key, order, "block", "ms", "Vs", "cross", "ll")


def fit_blocks(series: DataFrame, model: Counts, weights: np.ndarray, max_iter: int = 10, tolerance: float = 1e-4, key: str = "series_id", order: str = "t", y: str = "counts") -> Fit:
    """EM of a dense model of many units for A, Q and the prior, block by block; what is between blocks stays 0.

    Sums are kept for each block, so their number is that of the blocks' own entries.
    """
    from dataclasses import replace

    def e_step(model):
        parts = parts_of(model, weights)
        n = len(parts.own)
        rows = _smoothed_parts(_filtered_parts(series, model, parts, key, order, y), parts, key, order)

        def make(x):
            b, ms, Ps, go, first = x["block"].astype(int), x["ms"], x["Vs"], x["last"] == 0, x["begins"] > 0
            outer = lambda u, v: u[:, :, None] * v[:, None, :]
            m0, P0, c0 = kalman.rts(parts.m0[b[first]], parts.P0[b[first]], parts.A[b[first]], parts.Q[b[first]], (ms[first], Ps[first]))
            out = {c: np.zeros((n, *x["Vs"].shape[1:])) for c in ("gamma1", "gamma2", "beta", "P0")} | {"m0": np.zeros((n, ms.shape[1])), "n": np.zeros((n, 2)), "ll": np.array(x["ll"].sum())}
            for name, at, value in (
                ("gamma2", b, Ps + outer(ms, ms)), ("gamma1", b[go], (Ps + outer(ms, ms))[go]), ("gamma1", b[first], P0 + outer(m0, m0)),
                ("beta", b[go], (transposed(x["cross"]) + outer(x["next_m"], ms))[go]), ("beta", b[first], transposed(c0) + outer(ms[first], m0)),
                ("P0", b[first], P0 + outer(m0, m0)), ("m0", b[first], m0),
            ):
                np.add.at(out[name], at, value)
            out["n"] += np.stack([np.bincount(b, minlength=n), np.bincount(b[first], minlength=n)], 1)
            return out

        s = totals(rows, ["block", "ms", "Vs", "cross", "next_m", "last", "begins", "ll"], make)
        return float(s["ll"]), (s, parts)

    def m_step(model, held):
        s, parts = held
        A, Q, P0, m0 = np.zeros_like(model.A), np.zeros_like(model.Q), np.zeros_like(model.P0), np.array(model.m0, float)
        for k, o in enumerate(parts.own):
            at, d = np.ix_(o, o), len(o)
            g1, g2, b = (s[c][k, :d, :d] for c in ("gamma1", "gamma2", "beta"))
            A[at] = transposed(psd_solve(g1, b.T))
            c = A[at] @ b.T
            Q[at] = project_psd((g2 - c - c.T + A[at] @ g1 @ A[at].T) / s["n"][k, 0])
            m0[o] = s["m0"][k, :d] / s["n"][k, 1]
            P0[at] = project_psd(s["P0"][k, :d, :d] / s["n"][k, 1] - np.outer(m0[o], m0[o]))
        return replace(model, A=A, Q=Q, m0=m0, P0=P0)

    return em(model, e_step, m_step, max_iter, tolerance)


def smoothed(rows: DataFrame, model: Counts, key: str = "unit_id", order: str = "t", keep=("n", "z", "ll")) -> DataFrame:
    return kalman.smoothed(rows, model.A, model.Q, key, order, keep)


def fit(series: DataFrame, model: Counts, max_iter: int = 10, tolerance: float = 1e-4, key: str = "unit_id", order: str = "t", structure: str = "full", fixed_A: bool = False) -> Fit:
    """EM for A, Q and the prior, pooled over all units; structure: full, diagonal or isotropic Q."""
    from dataclasses import replace

    def e_step(model):
        rows = smoothed(filtered(series, model, key, order), model, key, order, ("n", "ll", "first"))
        from pyspark.sql import functions as F

        s = kalman.statistics(rows.withColumn("__y", F.array(F.col("n").cast("double"))), model, "__y")
        return float(s["ll"]), s

    def m_step(model, s):
        A = model.A if fixed_A else transposed(psd_solve(s["gamma1"], s["beta"].T))
        b = A @ s["beta"].T
        Q = (s["gamma2"] - b - b.T + A @ s["gamma1"] @ A.T) / s["n"][0]
        if structure == "full":
            Q = project_psd(Q)
        else:
            d = np.maximum(np.diag(Q), 1e-10)
            Q = np.diag(d if structure == "diagonal" else np.full(len(d), d.mean()))
        m0 = s["m0"] / s["n"][1]
        return replace(model, A=A, Q=Q, m0=m0, P0=project_psd(s["P0"] / s["n"][1] - np.outer(m0, m0)))

    return em(model, e_step, m_step, max_iter, tolerance)


def score(series: DataFrame, model: Counts, key: str = "unit_id", order: str = "t", y: str = "n", design: str = "z") -> tuple[float, dict[str, np.ndarray]]:
    """Log evidence of Poisson counts and its gradient in A, Q, m0 and P0: the filter, and one pass back over it.

    The pass back carries the slopes of all that follows in the moments of a row, and hands them through the row's
    update and prediction, so that two passes give the gradient in any number of parameters. Updates are of one step.
    """
    if model.steps != 1:
        raise ValueError("slopes are those of updates of one step")
    family = poisson(model.dt)
    begin, go = steps_of(model, y, design, family)

    def with_before(s, x, fresh):
        after, out = go(s, x, fresh)
        return after, {"bm": s["m"], "bV": s["V"], "ll": out["ll"]}

    rows = fold(series, key, order, begin, with_before, {"bm": 1, "bV": 2, "ll": 0}, [y, design], [y, design])
    d = len(model.m0)
    open_at = lambda eta: ((eta + np.log(model.dt) > -20.0) & (eta + np.log(model.dt) < MOST_LOG_COUNT)).astype(float)
    outer = lambda a, b: a[:, :, None] * b[:, None, :]

    def start(n):
        return {"m": np.zeros((n, d)), "V": np.zeros((n, d, d))}

    def step(s, x, fresh):
        m, V, z = x["bm"], x["bV"], x[design]
        pm, pv = mv(model.A, m), symmetric(model.A @ V @ model.A.T + model.Q)
        prec = psd_solve(pv, np.broadcast_to(np.eye(d), pv.shape))
        eta = (z * pm).sum(1)
        mu = family.mean(eta)
        info = symmetric(prec + mu[:, None, None] * outer(z, z))
        P = symmetric(psd_solve(info, np.broadcast_to(np.eye(d), info.shape)))
        off = P @ z[..., None]
        off = off[..., 0] * (x[y] - mu)[:, None]
        eta_x = (z * (pm + off)).sum(1)
        pull = mv(prec, off)
        gx = s["m"] + z * ((x[y] - family.mean(eta_x)) * open_at(eta_x))[:, None] - pull
        gP = s["V"] + 0.5 * info + symmetric(outer(gx, z * (x[y] - mu)[:, None]))
        g_info = -symmetric(P @ gP @ P)
        g_mu = np.einsum("na,nab,nb->n", z, g_info, z) - (z * mv(P, gx)).sum(1)
        # the mode is pm + off, so what moves pm moves the mode; the pull of the prior does not see it
        g_pm = gx + pull + z * (g_mu * mu * open_at(eta))[:, None]
        g_prec = g_info - 0.5 * outer(off, off)
        g_pv = -symmetric(prec @ g_prec @ prec) - 0.5 * prec
        back = {"m": mv(model.A.T, g_pm), "V": symmetric(model.A.T @ g_pv @ model.A)}
        return back, {"A": outer(g_pm, m) + 2 * g_pv @ model.A @ V, "Q": g_pv, "ll": x["ll"]}

    s = fold_sums(rows, key, order, start, step, ["bm", "bV", y, design, "ll"], backward=True)
    return float(s["ll"]), {"A": s["A"], "Q": s["Q"], "m0": s["carry m"], "P0": s["carry V"]}


def fit_gradient(series: DataFrame, model: Counts, steps: int = 50, rate: float = 1e-2, learn: tuple[str, ...] = ("A", "Q", "m0"), key: str = "unit_id", order: str = "t", y: str = "n", design: str = "z", family: Family | None = None) -> Fit:
    """Adam over any of A, Q, m0 and P0 by the filter's evidence; drifting place fields are such models too."""
    from dataclasses import replace

    spec = {"A": UNCONSTRAINED, "Q": PSD_MATRIX, "m0": UNCONSTRAINED, "P0": PSD_MATRIX}
    values = lambda ps: evidence(series, [steps_of(replace(model, **p), y, design, family) for p in ps], [y, design], key, order)

    def value(p):
        ll, g = score(series, replace(model, **p), key, order, y, design)
        return ll, {c: g[c] for c in learn}

    own = value if family is None and model.steps == 1 else None  # other updates are valued by differences
    got = by_gradient({c: np.asarray(getattr(model, c), float) for c in learn}, {c: spec[c] for c in learn}, values, series.count(), steps, rate, score=own)
    return Fit(replace(model, **got.params), got.log_likelihoods, got.converged)


def steepest_descent(series: DataFrame, start_at: np.ndarray, gain: float, dt: float, log_rate: Callable, gradient: Callable, key: str = "unit_id", order: str = "t", y: str = "n", position: str = "x") -> DataFrame:
    """(key, order, m): x += gain * grad log rate * (count - expected count), with given functions of position and state."""

    def start(n):
        return {"m": np.repeat(np.asarray(start_at, float)[None], n, 0)}

    def step(s, x, fresh):
        mu = np.exp(np.clip(log_rate(x[position], s["m"]) + np.log(dt), -20, MOST_LOG_COUNT))
        m = s["m"] + gain * gradient(x[position], s["m"]) * (x[y] - mu)[:, None]
        return {"m": m}, {"m": m}

    return fold(series, key, order, start, step, {"m": 1}, [y, position], [y])


def gaussian_field_log_rate(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """s: log peak, centre, width."""
    return s[:, 0] - (x - s[:, 1]) ** 2 / (2 * s[:, 2] ** 2)


def gaussian_field_gradient(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    off = x - s[:, 1]
    return np.stack([np.ones_like(off), off / s[:, 2] ** 2, off**2 / s[:, 2] ** 3], axis=1)


def regression(rows: DataFrame, y: str, mean: str, cov: str | None, dt: float, start: np.ndarray, weight: str | None = None, ridge: float = 0.0, baseline: tuple[float, float] | None = None, max_iter: int = 10, tolerance: float = 1e-6) -> np.ndarray:
    """(baseline, weights) of counts on smoothed states: Newton steps on the expected negative log likelihood, one job a step.

    With `cov` the state's spread raises the expected rate by half its variance. baseline: a
    prior value and its strength. Steps that do not lower the loss are halved.
    """
    d = len(start) - 1
    used = [y, mean, *([cov] if cov else []), *([weight] if weight else [])]

    def sums(at):
        b, w = at[0], at[1:]

        def make(x):
            m = x[mean]
            lift = np.einsum("nab,b->na", x[cov], w) if cov else np.zeros_like(m)
            eta = b + m @ w + 0.5 * lift @ w
            mu = np.exp(np.clip(eta, -50, 50)) * dt
            g = x[weight] if weight else np.ones(len(m))
            v = np.concatenate([np.ones((len(m), 1)), m + lift], axis=1)
            u = np.concatenate([np.ones((len(m), 1)), m], axis=1)
            h = np.einsum("n,na,nb->ab", g * mu, v, v)
            if cov:
                h[1:, 1:] += np.einsum("n,nab->ab", g * mu, x[cov])
            return {"loss": np.array((g * (mu - x[y] * (b + m @ w))).sum()), "grad": ((g * mu)[:, None] * v - (g * x[y])[:, None] * u).sum(0), "hess": h}

        s = totals(rows, used, make)
        loss, grad, hess = float(s["loss"]) + 0.5 * ridge * w @ w, s["grad"].copy(), s["hess"].copy()
        grad[1:] += ridge * w
        hess[np.arange(1, d + 1), np.arange(1, d + 1)] += ridge
        if baseline:
            loss += 0.5 * baseline[1] * (b - baseline[0]) ** 2
            grad[0] += baseline[1] * (b - baseline[0])
            hess[0, 0] += baseline[1]
        return loss, grad, hess

    at = np.array(start, float)
    loss, grad, hess = sums(at)
    for _ in range(max_iter):
        move = -np.linalg.solve(hess + 1e-6 * np.eye(d + 1), grad)
        scale = 1.0
        while scale > 1e-4:
            got = sums(at + scale * move)
            if got[0] <= loss + 1e-4 * scale * grad @ move:
                break
            scale /= 2
        else:
            break
        at, change = at + scale * move, loss - got[0]
        loss, grad, hess = got
        if change < tolerance * (1 + abs(loss)):
            break
    return at


# ---------------------------------------------------------------- switching spikes


@dataclass(frozen=True)
class SpikeObs:
    """baseline (K, n) and weights (K, n, d) of n units' log rates."""

    baseline: np.ndarray
    weights: np.ndarray
    dt: float


def spikes(obs: SpikeObs, m, P, y, j):
    """For operators.switching: update of a state by an array of counts."""
    extra = m.ndim - y.ndim
    y = np.broadcast_to(y.reshape(len(y), *[1] * extra, y.shape[-1]), (*m.shape[:-1], y.shape[-1])).astype(float)
    return laplace(m, P, y, obs.weights[j], obs.baseline[j], poisson(obs.dt))


#: Step sizes that a line search values at once, and the share of the expected gain that a step has to bring.
LADDER, GAIN = tuple(2.0**-k for k in range(12)), 1e-4


def refit_spikes(rows: DataFrame, obs: SpikeObs, y: str = "y", ridge: float = 1e-2, rounds: int = 1) -> SpikeObs:
    """Newton steps for each state and unit on state-conditional smoothed moments, two jobs a round for all of them.

    A step moves no number by more than 1. All sizes of LADDER are then valued for all states and units in one pass,
    and each takes the largest that lowers its own loss enough, or stays.
    """
    K, n, d = obs.weights.shape
    rows = reused(rows.select(y, "ms", "Vs", "ps"))

    def expected(x, at, k, u):
        """Expected counts of a unit in a state, its log rate, and how the state's spread leans on the weights."""
        m, P, c = x["ms"][:, k], x["Vs"][:, k], at[k, u, 1:]
        lift = np.einsum("nab,b->na", P, c)
        return np.exp(np.clip(at[k, u, 0] + m @ c + 0.5 * (lift * c).sum(1), -50, 50)) * obs.dt, at[k, u, 0] + m @ c, lift

    at = np.concatenate([obs.baseline[..., None], obs.weights], axis=-1)
    for _ in range(rounds):
        def make(x, at=at):
            g, h = np.zeros((K, n, d + 1)), np.zeros((K, n, d + 1, d + 1))
            for k in range(K):
                m, P, w = x["ms"][:, k], x["Vs"][:, k], x["ps"][:, k]
                for u in range(n):
                    mu, _, lift = expected(x, at, k, u)
                    v = np.concatenate([np.ones((len(m), 1)), m + lift], 1)
                    one = np.concatenate([np.ones((len(m), 1)), m], 1)
                    g[k, u] = ((w * mu)[:, None] * v - (w * x[y][:, u])[:, None] * one).sum(0)
                    h[k, u] = np.einsum("n,na,nb->ab", w * mu, v, v)
                    h[k, u, 1:, 1:] += np.einsum("n,nab->ab", w * mu, P)
            return {"g": g, "h": h}

        s = totals(rows, [y, "ms", "Vs", "ps"], make)
        lift = np.diag([1e-6, *[ridge] * d])
        slope = s["g"] + np.concatenate([np.zeros((K, n, 1)), ridge * at[..., 1:]], -1)
        move = np.clip(-np.linalg.solve(s["h"] + lift, slope[..., None])[..., 0], -1.0, 1.0)
        tried = np.array([at, *[at + size * move for size in LADDER]])

        def losses(x, tried=tried):
            out = np.zeros((len(tried), K, n))
            for r, k, u in np.ndindex(out.shape):
                mu, eta, _ = expected(x, tried[r], k, u)
                out[r, k, u] = (x["ps"][:, k] * (mu - x[y][:, u] * eta)).sum()
            return {"loss": out}

        loss = totals(rows, [y, "ms", "Vs", "ps"], losses)["loss"] + 0.5 * ridge * (tried[..., 1:] ** 2).sum(-1)
        gain = np.minimum((slope * move).sum(-1), 0)
        good = loss[1:] <= loss[0] + GAIN * np.array(LADDER)[:, None, None] * gain
        size = np.where(good.any(0), np.array(LADDER)[good.argmax(0)], 0.0)
        at = at + size[..., None] * move
    return SpikeObs(at[..., 0], at[..., 1:], obs.dt)


def trusted(model, new, weight: float = 0.3, most_q: float = 1.0, most_p0: float = 10.0):
    """Q and the prior's covariance moved part of the way, with eigenvalues held below their bounds."""
    from dataclasses import replace

    def held(old, got, most):
        w, v = np.linalg.eigh(symmetric(weight * got + (1 - weight) * old))
        return symmetric((v * np.clip(w, 0, most)[..., None, :]) @ transposed(v))

    return replace(new, Q=held(model.Q, new.Q, most_q), P0=held(model.P0, new.P0, most_p0))
