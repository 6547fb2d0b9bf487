"""Latents that follow a learned separable Hamiltonian: leapfrog steps, extended filters and smoothers, gradient fits.

H = p'p / 2 + omega^2 q'q / 2 + net(q) - net(0). The net has any number of hidden layers of tanh
units. Force and curvature are carried through it layer by layer, first and second slopes in q
beside the values, for all series of a batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame

from driftline.operators.kalman import measured
from driftline.operators.matrices import mv, psd_solve, symmetric, transposed
from driftline.operators.point_process import laplace, poisson
from driftline.plans import fitting
from driftline.plans.fold import evidence, fold, totals


@dataclass(frozen=True)
class Hamiltonian:
    """omega (n), w (hidden, n), b (hidden), v (hidden); noise Q (2n, 2n); field: C, offset, R; spikes: W, baseline.

    inner: weights (units, units before) and offsets (units) of each further hidden layer; v reads the last one.
    """

    omega: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    Q: np.ndarray
    dt: float
    C: np.ndarray | None = None
    offset: np.ndarray | None = None
    R: np.ndarray | None = None
    W: np.ndarray | None = None
    baseline: np.ndarray | None = None
    inner: tuple[tuple[np.ndarray, np.ndarray], ...] = ()

    @property
    def layers(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(self.w, self.b), *self.inner]

    @property
    def weight(self) -> float:
        """Sum of the squares of the net's weights, without offsets."""
        return float(sum((U**2).sum() for U, _ in self.layers) + (self.v**2).sum())

    @property
    def n(self) -> int:
        return len(self.omega)

    @property
    def field_noise(self) -> np.ndarray:
        """Standard deviation of each channel of the field."""
        return np.sqrt(np.diag(self.R))

    def prior(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.full(self.n, 0.1), np.zeros(self.n)]), np.eye(2 * self.n)


def made(n: int, dt: float, hidden: int | tuple[int, ...] = 8, seed: int = 42, noise: float = 1e-3, **observed) -> Hamiltonian:
    """hidden: units of the hidden layer, or of each."""
    r = np.random.default_rng(seed)
    first, *more = (hidden,) if isinstance(hidden, int) else hidden
    w, v = r.normal(0, 0.1, (first, n)), r.normal(0, 0.1, (more or [first])[-1])
    inner = tuple((r.normal(0, before**-0.5, (units, before)), np.zeros(units)) for before, units in zip([first, *more], more))
    return Hamiltonian(np.ones(n), w, np.zeros(first), v, noise * np.eye(2 * n), dt, inner=inner, **observed)


def potential(q: np.ndarray, h: Hamiltonian) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The net, its gradient and its second derivatives in q."""
    y, J, T = q, np.broadcast_to(np.eye(h.n), (*q.shape, h.n)), np.zeros((*q.shape, h.n, h.n))
    for U, c in h.layers:
        t = np.tanh(y @ U.T + c)
        J, T = U @ J, np.einsum("ij,...jab->...iab", U, T)
        one = 1 - t * t
        T = (-2 * t * one)[..., None, None] * J[..., :, None] * J[..., None, :] + one[..., None, None] * T
        y, J = t, one[..., None] * J
    return y @ h.v, np.einsum("i,...ia->...a", h.v, J), np.einsum("i,...iab->...ab", h.v, T)


def energy(x: np.ndarray, h: Hamiltonian) -> np.ndarray:
    q, p = x[..., : h.n], x[..., h.n :]
    return 0.5 * (p * p).sum(-1) + 0.5 * (h.omega**2 * q * q).sum(-1) + potential(q, h)[0] - potential(np.zeros(h.n), h)[0]


def gradient(q: np.ndarray, h: Hamiltonian) -> tuple[np.ndarray, np.ndarray]:
    """dH/dq and d2H/dq2."""
    _, slope, curve = potential(q, h)
    return h.omega**2 * q + slope, curve + np.diag(h.omega**2)


def leapfrog(x: np.ndarray, h: Hamiltonian) -> tuple[np.ndarray, np.ndarray]:
    """Kick, drift, kick, and the Jacobian of the step."""
    n, dt, eye = h.n, h.dt, np.eye(h.n)
    q, p = x[..., :n], x[..., n:]
    g0, k0 = gradient(q, h)
    half = p - dt / 2 * g0
    q1 = q + dt * half
    g1, k1 = gradient(q1, h)
    p1 = half - dt / 2 * g1
    dq_q, dq_p = eye - dt * dt / 2 * k0, np.broadcast_to(dt * eye, k0.shape)
    dp_q = -dt / 2 * k0 - dt / 2 * k1 @ dq_q
    dp_p = eye - dt / 2 * k1 @ dq_p
    F = np.concatenate([np.concatenate([dq_q, dq_p], -1), np.concatenate([dp_q, dp_p], -1)], -2)
    return np.concatenate([q1, p1], -1), F


def updated(m, P, h: Hamiltonian, lfp, spikes):
    """Field first, then spikes."""
    ll = np.zeros(m.shape[:-1])
    if lfp is not None:
        m, P, ll = measured(m, P, np.broadcast_to(lfp, (*m.shape[:-1], lfp.shape[-1])), h.C, h.R, h.offset)
    if spikes is not None:
        m, P, more = laplace(m, P, np.broadcast_to(spikes, (*m.shape[:-1], spikes.shape[-1])).astype(float), h.W, h.baseline, poisson(h.dt))
        ll = ll + more
    return m, P, ll


def filtered(series: DataFrame, models: Hamiltonian | list[Hamiltonian], lfp: str | None = "lfp", spikes: str | None = None, key: str = "series_id", order: str = "t") -> DataFrame:
    """(key, order, m, P, pm, pP, F, ll) of an extended filter; (key, order, ll) with an array under several models, valued in one pass."""
    several = isinstance(models, list)
    tried = models if several else [models]
    given = [c for c in (lfp, spikes) if c]

    def start(n):
        out = {}
        for k, h in enumerate(tried):
            m, P = h.prior()
            out |= {f"m{k}": np.repeat(m[None], n, 0), f"P{k}": np.repeat(P[None], n, 0)}
        return out

    def step(s, x, fresh):
        carry, lls = {}, []
        for k, h in enumerate(tried):
            pm, F = leapfrog(s[f"m{k}"], h)
            pv = symmetric(F @ s[f"P{k}"] @ transposed(F) + h.Q)
            m, P, ll = updated(pm, pv, h, x[lfp] if lfp else None, x[spikes] if spikes else None)
            carry |= {f"m{k}": m, f"P{k}": P}
            lls.append(ll)
        return carry, {"ll": np.stack(lls, 1)} if several else {"m": m, "V": P, "pm": pm, "pV": pv, "F": F, "ll": ll}

    into = {"ll": 1} if several else {"m": 1, "V": 2, "pm": 1, "pV": 2, "F": 2, "ll": 0}
    return fold(series, key, order, start, step, into, given)


def smoothed(rows: DataFrame, n: int, key: str = "series_id", order: str = "t", keep=("ll",)) -> DataFrame:
    """(key, order, keep, ms, Ps) backward with each step's Jacobian."""
    d = 2 * n

    def start(k):
        return {"m": np.zeros((k, d)), "V": np.zeros((k, d, d)), "pm": np.zeros((k, d)), "pV": np.repeat(np.eye(d)[None], k, 0), "F": np.zeros((k, d, d))}

    def step(s, x, fresh):
        j = transposed(psd_solve(s["pV"], s["F"] @ x["V"]))
        m = x["m"] + mv(j, s["m"] - s["pm"])
        P = symmetric(x["V"] + j @ (s["V"] - s["pV"]) @ transposed(j))
        m, P = np.where(fresh[:, None], x["m"], m), np.where(fresh[:, None, None], x["V"], P)
        return {"m": m, "V": P, "pm": x["pm"], "pV": x["pV"], "F": x["F"]}, {"ms": m, "Vs": P}

    return fold(rows, key, order, start, step, {"ms": 1, "Vs": 2}, ["m", "V", "pm", "pV", "F"], keep, backward=True)


def fit(series: DataFrame, model: Hamiltonian, steps: int = 20, lfp: str | None = "lfp", spikes: str | None = None, ridge: float = 1e-4, rate: float = 1e-2, learn: tuple[str, ...] = ("omega", "w", "b", "v", "inner"), **how) -> fitting.Fit:
    """Adam on the filter's evidence less an L2 pull on the net; all differences of a step in one pass over the rows.

    learn: any of omega, w, b, v, inner (all further layers), C, offset, W and baseline.
    """
    n = series.count()
    at = parameters(model, learn)
    spec = {k: fitting.POSITIVE if k == "omega" else fitting.UNCONSTRAINED for k in at}

    def losses(ps):
        tried = [with_parameters(model, p) for p in ps]
        got = totals(filtered(series, tried, lfp, spikes, **how), ["ll"], lambda x: {"ll": x["ll"].sum(0)})["ll"]
        return [-x / n + ridge * h.weight for x, h in zip(got, tried)]

    got = fitting.adam(at, spec, losses, steps, rate)
    return fitting.Fit(with_parameters(model, got.params), got.log_likelihoods, got.converged)


def parameters(h: Hamiltonian, learn: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Arrays to learn by name; those of inner layers are U0, c0, U1, ..."""
    out = {c: np.asarray(getattr(h, c), float) for c in learn if c != "inner"}
    if "inner" in learn:
        out |= {f"{name}{k}": np.asarray(x, float) for k, layer in enumerate(h.inner) for name, x in zip("Uc", layer)}
    return out


def with_parameters(h: Hamiltonian, p: dict[str, np.ndarray]) -> Hamiltonian:
    inner = tuple((p.get(f"U{k}", U), p.get(f"c{k}", c)) for k, (U, c) in enumerate(h.inner))
    taken = {f"{name}{k}" for k in range(len(h.inner)) for name in "Uc"}
    return replace(h, inner=inner, **{c: x for c, x in p.items() if c not in taken})


def _moved(m, P, h: Hamiltonian):
    pm, F = leapfrog(m, h)
    return pm, symmetric(F @ P @ transposed(F) + h.Q), F


def _switching_steps(models: list[Hamiltonian], Z: np.ndarray, prior: np.ndarray, lfp: str | None, spikes: str | None):
    """start and step of the filter: states are mixed after the prediction, so that each row takes K updates; the chain moves into the first row too."""
    from driftline.operators.matrices import log_sum_exp, safe_log
    from driftline.operators.switching import collapse

    K = len(models)

    def start(n):
        m, P = models[0].prior()
        return {"m": np.tile(m, (n, K, 1)), "V": np.tile(P, (n, K, 1, 1)), "p": np.repeat(np.asarray(prior, float)[None], n, 0)}

    def step(s, x, fresh):
        joint = s["p"][:, :, None] * Z
        pred = joint.sum(1)
        w = np.where(pred[:, None] > 0, joint / np.where(pred > 0, pred, 1)[:, None], 1 / K)
        out_m, out_P, lls = [], [], []
        for j, h in enumerate(models):
            pm, pv, _ = _moved(s["m"], s["V"], h)
            m, P = collapse(pm, pv, w[:, :, j], 1)
            m, P, ll = updated(m, P, h, x[lfp] if lfp else None, x[spikes] if spikes else None)
            out_m.append(m)
            out_P.append(P)
            lls.append(ll)
        lj = safe_log(pred) + np.stack(lls, 1)
        z = log_sum_exp(lj, 1)
        m, P, p = np.stack(out_m, 1), np.stack(out_P, 1), np.exp(lj - z[:, None])
        return {"m": m, "V": P, "p": p}, {"m": m, "V": P, "p": p, "ll": z}

    return start, step


def switching_filtered(series: DataFrame, models: list[Hamiltonian], Z: np.ndarray, prior: np.ndarray, lfp: str | None = "lfp", spikes: str | None = None, key: str = "series_id", order: str = "t") -> DataFrame:
    """(key, order, m, V, p, ll) of several Hamiltonians."""
    given = [c for c in (lfp, spikes) if c]
    return fold(series, key, order, *_switching_steps(models, np.asarray(Z, float), prior, lfp, spikes), {"m": 2, "V": 3, "p": 1, "ll": 0}, given)


def switching_smoothed(rows: DataFrame, models: list[Hamiltonian], Z: np.ndarray, key: str = "series_id", order: str = "t", keep=("ll",)) -> DataFrame:
    """(key, order, keep, ms, Vs, ps): backward over pairs of a state and the next, collapsed over the next."""
    from driftline.operators.switching import collapse

    K, d = len(models), 2 * models[0].n
    Z = np.asarray(Z, float)

    def start(n):
        return {"m": np.zeros((n, K, d)), "V": np.zeros((n, K, d, d)), "p": np.zeros((n, K))}

    def step(s, x, fresh):
        joint = x["p"][:, :, None] * Z
        pred = joint.sum(1, keepdims=True)
        joint = np.where(pred > 0, joint / np.where(pred > 0, pred, 1), 0) * s["p"][:, None, :]
        ps = joint.sum(2)
        w = np.where(ps[:, :, None] > 0, joint / np.where(ps > 0, ps, 1)[:, :, None], 1 / K)
        pairs_m, pairs_P = [], []
        for k, h in enumerate(models):
            pm, pv, F = _moved(x["m"], x["V"], h)
            j = transposed(psd_solve(pv, F @ x["V"]))
            pairs_m.append(x["m"] + mv(j, s["m"][:, None, k] - pm))
            pairs_P.append(symmetric(x["V"] + j @ (s["V"][:, None, k] - pv) @ transposed(j)))
        m, P = collapse(np.stack(pairs_m, 2), np.stack(pairs_P, 2), w, 2)
        total = ps.sum(1, keepdims=True)
        ps = ps / np.where(total > 0, total, 1)
        e = fresh[:, None]
        m, P, ps = np.where(e[..., None], x["m"], m), np.where(e[..., None, None], x["V"], P), np.where(e, x["p"], ps)
        return {"m": m, "V": P, "p": ps}, {"ms": m, "Vs": P, "ps": ps}

    return fold(rows, key, order, start, step, {"ms": 2, "Vs": 3, "ps": 1}, ["m", "V", "p"], keep, backward=True)


def fit_switching(series: DataFrame, models: list[Hamiltonian], Z: np.ndarray, prior: np.ndarray, steps: int = 20, lfp: str | None = "lfp", spikes: str | None = None, ridge: float = 1e-4, rate: float = 1e-2, learn: tuple[str, ...] = ("omega", "w", "b", "v", "inner", "Z", "prior"), key: str = "series_id", order: str = "t") -> fitting.Fit:
    """Adam over the chain and each state's Hamiltonian by the filter's evidence less an L2 pull on the nets; params: (models, Z, prior)."""
    own = [list(parameters(h, tuple(c for c in learn if c not in ("Z", "prior")))) for h in models]
    at = {f"{c} {k}": x for k, h in enumerate(models) for c, x in parameters(h, tuple(c for c in learn if c not in ("Z", "prior"))).items()}
    at |= {c: np.asarray(x, float) for c, x in (("Z", Z), ("prior", prior)) if c in learn}
    spec = {c: fitting.STOCHASTIC_ROW if c in ("Z", "prior") else fitting.POSITIVE if c.startswith("omega") else fitting.UNCONSTRAINED for c in at}

    def build(p):
        made = [with_parameters(h, {c: p[f"{c} {k}"] for c in own[k]}) for k, h in enumerate(models)]
        return made, p.get("Z", np.asarray(Z, float)), p.get("prior", np.asarray(prior, float))

    def pull(p):
        return ridge * sum(h.weight for h in build(p)[0])

    given = [c for c in (lfp, spikes) if c]
    values = lambda ps: evidence(series, [_switching_steps(*build(p), lfp, spikes) for p in ps], given, key, order)
    got = fitting.by_gradient(at, spec, values, series.count(), steps, rate, pull)
    return fitting.Fit(build(got.params), got.log_likelihoods, got.converged)
