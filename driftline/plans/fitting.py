"""Loops that fit parameters: expectation-maximisation with rollback, Adam over transformed parameters, line searches.

Parameters are small and stay on the driver; every step over data is a Spark job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np

Params = dict[str, np.ndarray]


@dataclass
class Fit:
    """Accepted parameters, log likelihood of each accepted step, and whether the last change was small enough."""

    params: Any
    log_likelihoods: list[float] = field(default_factory=list)
    converged: bool = False

    @property
    def log_likelihood(self) -> float:
        return self.log_likelihoods[-1]


def converged(now: float, before: float, tolerance: float = 1e-4, absolute: float | None = None) -> tuple[bool, bool]:
    """(converged, decreased): change below the absolute tolerance, else relative to the mean magnitude."""
    change = now - before
    small = absolute if absolute is not None else tolerance
    scale = (abs(now) + abs(before) + np.finfo(float).eps) / 2
    relative = abs(change) / scale < tolerance
    return abs(change) < small or relative, change < -small and not relative


def em(params: Any, e_step: Callable, m_step: Callable, max_iter: int = 50, tolerance: float = 1e-4) -> Fit:
    """e_step(params) -> (log likelihood, statistics); m_step(params, statistics) -> params.

    A step that lowers the likelihood beyond the tolerance is undone and ends the loop.
    """
    ll, stats = e_step(params)
    fit = Fit(params, [ll])
    for _ in range(max_iter):
        new = m_step(fit.params, stats)
        ll, new_stats = e_step(new)
        done, fell = converged(ll, fit.log_likelihood, tolerance)
        if fell or not np.isfinite(ll):
            break
        fit.params, stats = new, new_stats
        fit.log_likelihoods.append(ll)
        if done:
            fit.converged = True
            break
    return fit


# ---------------------------------------------------------------- transforms


@dataclass(frozen=True)
class Transform:
    """Maps of a parameter to free numbers and back; an untrained one is left as it is."""

    free: Callable[[np.ndarray], np.ndarray]
    bound: Callable[[np.ndarray, tuple], np.ndarray]
    trained: bool = True


def _softplus(x):
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def _softplus_inverse(x):
    x = np.maximum(x, 1e-300)
    return x + np.log(-np.expm1(-x))


def _psd_free(p):
    root = np.linalg.cholesky(p)
    i = np.tril_indices(p.shape[-1])
    flat = root[..., i[0], i[1]].copy()
    flat[..., i[0] == i[1]] = _softplus_inverse(flat[..., i[0] == i[1]])
    return flat


def _psd_bound(x, shape):
    root = np.zeros(shape)
    i = np.tril_indices(shape[-1])
    x = np.array(x, float).reshape(*shape[:-2], len(i[0]))
    x[..., i[0] == i[1]] = _softplus(x[..., i[0] == i[1]])
    root[..., i[0], i[1]] = x
    return root @ np.swapaxes(root, -1, -2)


UNCONSTRAINED = Transform(lambda x: np.ravel(x), lambda x, shape: np.reshape(x, shape))
POSITIVE = Transform(lambda x: _softplus_inverse(np.ravel(x)), lambda x, shape: np.reshape(_softplus(x) + np.finfo(float).tiny, shape))
UNIT_INTERVAL = Transform(
    lambda x: np.log(np.clip(np.ravel(x), 1e-6, 1 - 1e-6)) - np.log1p(-np.clip(np.ravel(x), 1e-6, 1 - 1e-6)),
    lambda x, shape: np.reshape(1 / (1 + np.exp(-x)), shape),
)
PSD_MATRIX = Transform(_psd_free, _psd_bound)


def _row_free(z):
    z = np.maximum(z, 1e-10)
    return (np.log(z[..., :-1]) - np.log(z[..., -1:])).ravel()


def _row_bound(x, shape):
    logits = np.concatenate([np.reshape(x, (*shape[:-1], shape[-1] - 1)), np.zeros((*shape[:-1], 1))], axis=-1)
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


STOCHASTIC_ROW = Transform(_row_free, _row_bound)


def stacked(t: Transform) -> Transform:
    """The same transform for each entry along the leading axis."""

    def bound(x, shape):
        return np.stack([t.bound(part, shape[1:]) for part in np.split(np.asarray(x), shape[0])])

    return Transform(lambda x: np.concatenate([t.free(part) for part in x]), bound, t.trained)


def by_gradient(at: Params, spec: dict[str, Transform], evidences: Callable[[list[Params]], list[float]] | None, n: int, steps: int = 50, rate: float = 1e-2, penalty: Callable[[Params], float] = lambda p: 0.0, score: Callable[[Params], tuple[float, Params]] | None = None, **how) -> Fit:
    """Adam on the log evidence per row less a penalty.

    score(params) gives the evidence and its gradient in the parameters, in a number of passes that does not depend on
    how many there are; without it evidences(candidates) values all of a step in one pass over the rows.
    Log likelihoods of the result are sums again, with the penalty taken off.
    """
    losses = lambda ps: [-e / n + penalty(p) for e, p in zip(evidences(ps), ps)]

    def slope(flat: np.ndarray) -> tuple[float, np.ndarray]:
        p = from_free(flat, at, spec)
        value, g = score(p)
        pull = differences(lambda x: penalty(from_free(x, at, spec)), flat)
        return -value / n + penalty(p), pull - pulled_back(flat, at, spec, g) / n

    got = adam(at, spec, losses, steps, rate, slope=slope if score else None, **how)
    return Fit(got.params, [x * n for x in got.log_likelihoods], got.converged)


def positive_capped(most: float = 50.0) -> Transform:
    """Numbers between 0 and `most`."""
    return Transform(
        lambda x: UNIT_INTERVAL.free(np.asarray(x) / most), lambda x, shape: most * UNIT_INTERVAL.bound(x, shape)
    )


def frozen(t: Transform) -> Transform:
    return Transform(t.free, t.bound, False)


def to_free(params: Params, spec: dict[str, Transform]) -> np.ndarray:
    missing = set(spec) ^ set(params)
    if missing:
        raise KeyError(f"parameters and transforms differ in {sorted(missing)}")
    return np.concatenate([np.ravel(spec[k].free(np.asarray(params[k], float))) for k in spec if spec[k].trained] or [np.zeros(0)])


def from_free(flat: np.ndarray, like: Params, spec: dict[str, Transform]) -> Params:
    out, at = {}, 0
    for k, t in spec.items():
        old = np.asarray(like[k], float)
        if not t.trained:
            out[k] = like[k]
            continue
        n = len(np.ravel(t.free(old)))
        out[k] = t.bound(flat[at : at + n], old.shape)
        at += n
    return out


def differences(f: Callable[[np.ndarray], float], x: np.ndarray, width: float = 1e-6) -> np.ndarray:
    """Central differences of a function of numbers on the driver."""
    return np.array([(f(x + width * e) - f(x - width * e)) / (2 * width) for e in np.eye(len(x))])


def pulled_back(flat: np.ndarray, like: Params, spec: dict[str, Transform], gradient: Params) -> np.ndarray:
    """Gradient in free numbers from that in the parameters: each transform's own slope, which needs no data."""
    out, at = np.zeros_like(flat), 0
    for k, t in spec.items():
        if t.trained:
            shape = np.shape(like[k])
            n = len(np.ravel(t.free(np.asarray(like[k], float))))
            g = np.asarray(gradient[k], float)
            out[at : at + n] = differences(lambda x, t=t, g=g, shape=shape: float((t.bound(x, shape) * g).sum()), flat[at : at + n])
            at += n
    return out


# ---------------------------------------------------------------- gradient fits


def adam(
    params: Params,
    spec: dict[str, Transform],
    losses: Callable[[list[Params]], list[float]],
    steps: int = 200,
    rate: float = 1e-2,
    clip: float = 10.0,
    tolerance: float | None = None,
    width: float = 1e-4,
    slope: Callable[[np.ndarray], tuple[float, np.ndarray]] | None = None,
) -> Fit:
    """Adam on free parameters. slope(free) gives the loss and its gradient; without it, central differences, for
    which `losses` values many candidates in one job over the data.

    Gradients are clipped to a global norm; a step without a finite loss goes back to the last
    good one and ends; five steps in turn that change less than the tolerance end it too.
    """
    flat = to_free(params, spec)
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    fit, stalled, last = Fit(params), 0, None
    for k in range(1, steps + 1):
        if slope:
            now, g = slope(flat)
            got = np.array([now])
        else:
            trial = [flat, *[flat + s * width * e for e in np.eye(len(flat)) for s in (1, -1)]]
            got = np.array(losses([from_free(x, params, spec) for x in trial]), float)
            g = (got[1::2] - got[2::2]) / (2 * width)
        if not np.isfinite(got).all() or not np.isfinite(g).all():
            break
        fit.params = from_free(flat, params, spec)
        fit.log_likelihoods.append(-float(got[0]))
        if tolerance is not None and last is not None:
            stalled = stalled + 1 if abs(last - got[0]) < tolerance else 0
            if stalled >= 5:
                fit.converged = True
                break
        last = got[0]
        g = g * min(1.0, clip / max(np.linalg.norm(g), 1e-300))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        flat = flat - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return fit


def best_on_grid(values: Callable[[list[float]], list[float]], grid: list[float], golden: int = 10) -> float:
    """The x of the largest value: one job for the grid, then golden sections between its neighbours."""
    got = values(list(grid))
    k = int(np.argmax(got))
    a, b = grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)]
    ratio = (5**0.5 - 1) / 2
    best, at = got[k], grid[k]
    for _ in range(golden):
        x, y = b - ratio * (b - a), a + ratio * (b - a)
        fx, fy = values([x, y])
        a, b = (a, y) if fx >= fy else (x, b)
        for f, z in ((fx, x), (fy, y)):
            if f > best:
                best, at = f, z
    return float(at)


def bfgs(loss: Callable[[np.ndarray], float], x: np.ndarray, max_iter: int = 100, tolerance: float = 1e-6) -> np.ndarray:
    """Quasi-Newton descent with differences and halving; for functions of small statistics on the driver."""
    x = np.array(x, float)

    def gradient(z):
        w = 1e-6 * np.maximum(1, np.abs(z))
        return np.array([(loss(z + w[i] * e) - loss(z - w[i] * e)) / (2 * w[i]) for i, e in enumerate(np.eye(len(z)))])

    h, g, f = np.eye(len(x)), gradient(x), loss(x)
    for _ in range(max_iter):
        if np.linalg.norm(g) < tolerance:
            break
        d = -h @ g
        if d @ g >= 0:
            h, d = np.eye(len(x)), -g
        t = 1.0
        while t > 1e-10 and not loss(x + t * d) <= f + 1e-4 * t * (g @ d):
            t /= 2
        if t <= 1e-10:
            break
        s = t * d
        new = gradient(x + s)
        y, x, g, f = new - g, x + s, new, loss(x + s)
        if s @ y > 1e-12:
            r = 1 / (s @ y)
            left = np.eye(len(x)) - r * np.outer(s, y)
            h = left @ h @ left.T + r * np.outer(s, s)
    return x


def assignment(gain: np.ndarray) -> np.ndarray:
    """Permutation p with the largest sum of gain[i, p[i]]: the shortest augmenting path method on a small square table."""
    cost = gain.max() - np.asarray(gain, float)
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = np.zeros(n, int)
    out[match[1:] - 1] = np.arange(n)
    return out


def summary(spark, fit: Fit, n_params: int, n_rows: int):
    """(name, value) of a fit: likelihood, criteria, steps, and every number of its parameters."""
    ll = fit.log_likelihood
    rows = [("log_likelihood", ll), ("bic", -2 * ll + n_params * float(np.log(n_rows))), ("aic", -2 * ll + 2 * n_params), ("n_params", n_params), ("steps", len(fit.log_likelihoods)), ("converged", float(fit.converged))]
    values = fit.params if isinstance(fit.params, dict) else getattr(fit.params, "__dict__", {})
    for name, x in values.items():
        try:
            x = np.asarray(x, float)
        except (TypeError, ValueError):
            continue  # functions, families, nested models
        rows += [(name + "".join(f"[{k}]" for k in at), x[at]) for at in np.ndindex(*x.shape)]
    return spark.createDataFrame([(a, float(b)) for a, b in rows], "name string, value double")
