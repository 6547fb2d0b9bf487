"""Filters and smoothers whose dynamics switch with a hidden discrete state.

Every kind of observation shares one recursion: all pairs of source and destination states are
predicted with the destination's dynamics and updated, and pairs are collapsed to one Gaussian
for each destination. The prior is that of the first row, which is updated without dynamics.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftline.operators.diagnostics import marks, of_moments
from driftline.operators.kalman import measured
from driftline.operators.matrices import log_det, log_sum_exp, mv, project_psd, psd_solve, safe_log, symmetric, transposed
from driftline.plans.fitting import PSD_MATRIX, STOCHASTIC_ROW, UNCONSTRAINED, Fit, Transform, by_gradient, converged, em, stacked
from driftline.plans.fold import evidence, fold, side_by_side, to_numpy, totals
from driftline.plans.lineage import reused

#: Smoothed covariances are held to this many times the trace of the filter's.
TRACE_CAP = 1e8


@dataclass(frozen=True)
class Switching:
    """K states: A, Q (K, d, d), prior moments m0 (K, d), P0 (K, d, d), chain Z (K, K) and its prior.

    observe(m, P, rows, state) updates means (..., d) and covariances of one state by a batch
    of observation rows and returns mean, covariance and log density. obs: its parameters.
    """

    A: np.ndarray
    Q: np.ndarray
    m0: np.ndarray
    P0: np.ndarray
    Z: np.ndarray
    prior: np.ndarray
    observe: Callable
    obs: Any = None

    @property
    def k(self) -> int:
        return len(self.prior)


@dataclass(frozen=True)
class GaussianObs:
    """H (K, n, d) and R (K, n, n)."""

    H: np.ndarray
    R: np.ndarray


def gaussian(obs: GaussianObs, m, P, y, j):
    n = m.ndim - y.ndim
    y = y.reshape(len(y), *[1] * n, y.shape[-1])
    return measured(m, P, np.broadcast_to(y, (*m.shape[:-1], y.shape[-1])), obs.H[j], obs.R[j])


def collapse(m: np.ndarray, P: np.ndarray, w: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Moments of mixtures along `axis` (of w), with weights that sum to 1 along it."""
    mean = (w[..., None] * m).sum(axis=axis)
    off = m - np.expand_dims(mean, axis)
    return mean, (w[..., None, None] * (P + off[..., :, None] * off[..., None, :])).sum(axis=axis)


def discrete_update(ll: np.ndarray, Z: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the destination, weights of sources given it, and log evidence, from pair log densities (rows, i, j).

    Chances that the chain rules out stay 0; where no pair explains the row the prediction stands.
    """
    base = safe_log(Z)[None] + safe_log(p)[:, :, None]
    joint = ll + base
    none = ~np.isfinite(joint).any(axis=(1, 2))
    joint[none] = base[none]
    to = log_sum_exp(joint, 1)
    z = log_sum_exp(to, 1)
    post = np.exp(to - z[:, None])
    held = np.isfinite(to)
    post = np.where(held, np.maximum(post, 1e-10), 0)
    post /= post.sum(axis=1, keepdims=True)
    with np.errstate(invalid="ignore"):
        w = np.where(held[:, None, :], np.exp(joint - np.where(held, to, 0)[:, None, :]), 1 / len(Z))
    return post, w, z


def steps_of(model: Switching, inputs: list[str], pairs: bool = False, scores: bool = False) -> tuple[Callable, Callable]:
    """start and step of the filter."""
    K, d = model.m0.shape

    def start(n):
        rep = lambda x: np.repeat(np.asarray(x, float)[None], n, 0)
        return {"m": rep(model.m0), "V": rep(model.P0), "p": rep(model.prior)}

    def observed(m, P, rows):
        """Along the state axis -2 of m."""
        got = [model.observe(model.obs, m[..., j, :], P[..., j, :, :], rows, j) for j in range(K)]
        return np.stack([g[0] for g in got], -2), np.stack([g[1] for g in got], -3), np.stack([g[2] for g in got], -1)

    def first(s, rows):
        m, P, ll = observed(s["m"], s["V"], rows)
        base = safe_log(s["p"])
        joint = ll + base
        none = ~np.isfinite(joint).any(axis=1)
        joint[none] = base[none]
        z = log_sum_exp(joint, 1)
        p = np.exp(joint - z[:, None])
        rep = lambda x: np.repeat(x[:, None], K, 1)
        return m, P, p, z, rep(m), rep(P), rep(p) / K, np.zeros((len(m), K, K))

    def later(s, rows):
        pm = np.einsum("jab,sib->sija", model.A, s["m"])
        pv = model.A[None, None] @ s["V"][:, :, None] @ transposed(model.A)[None, None] + model.Q[None, None]
        m, P, ll = observed(pm, symmetric(pv), rows)
        p, w, z = discrete_update(ll, model.Z, s["p"])
        cm, cP = collapse(m, P, w, 1)
        return cm, cP, p, z, m, P, w * p[:, None, :], ll

    def step(s, x, fresh):
        rows = x[inputs[0]] if len(inputs) == 1 else tuple(x[c] for c in inputs)
        pick = lambda at: ({k: v[at] for k, v in s.items()}, rows[at] if len(inputs) == 1 else tuple(r[at] for r in rows))
        if fresh.all():
            got = first(s, rows)
        elif not fresh.any():
            got = later(s, rows)
        else:
            a, b = first(*pick(fresh)), later(*pick(~fresh))
            got = []
            for u, v in zip(a, b):
                both = np.zeros((len(fresh), *u.shape[1:]))
                both[fresh], both[~fresh] = u, v
                got.append(both)
        m, P, p, z, pm, pP, pp, pll = got
        with np.errstate(invalid="ignore"):
            before = np.where(fresh[:, None, None], 0.0, safe_log(model.Z)[None] + safe_log(s["p"])[:, :, None])
        lost = ~fresh & ~np.isfinite(pll + before).any(axis=(1, 2))
        out = {"m": m, "V": P, "p": p, "ll": z, "diag": marks(unexplained=lost, **of_moments(m, P))}
        if scores:
            out |= {"pll": pll}
        if pairs:
            out |= {"pm": pm, "pV": pP, "pp": pp}
        return {"m": m, "V": P, "p": p}, out

    return start, step


def filtered(series: DataFrame, model: Switching, inputs: list[str], key: str = "series_id", order: str = "t", pairs: bool = False, keep=(), scores: bool = False) -> DataFrame:
    """(key, order, keep, m, P, p, ll, first, diag): moments of each state and its chance; with `pairs` also those given the state before.

    inputs: the observation columns; `observe` gets them as one array if there is one, else as a tuple. With
    `scores` also pll, the log density of the row given the state before and its own (zeros at first rows).
    """
    into = {"m": 2, "V": 3, "p": 1, "ll": 0, "first": 0, "diag": 0} | ({"pm": 3, "pV": 4, "pp": 2} if pairs else {}) | ({"pll": 2} if scores else {})
    return fold(series, key, order, *steps_of(model, inputs, pairs, scores), into, inputs, [*inputs, *keep])


def _rts(m, P, A, Q, sm, sP):
    """One step backward, batched: mean, covariance and gain times the next covariance."""
    ahead = symmetric(A @ P @ transposed(A) + Q)
    j = transposed(psd_solve(ahead, A @ P))
    return m + mv(j, sm - mv(A, m)), symmetric(P + j @ (sP - ahead) @ transposed(j)), j @ sP


def _capped(P: np.ndarray, most: np.ndarray) -> np.ndarray:
    t = np.trace(P, axis1=-2, axis2=-1)
    most = most.reshape(most.shape + (1,) * (t.ndim - 1))
    return P * np.where(t > most, most / np.maximum(t, 1e-300), 1.0)[..., None, None]


SMOOTHED = {"ms": 2, "Vs": 3, "ps": 1, "joint": 2, "pair_m": 3, "pair_P": 4, "cross": 4, "next_ms": 3, "next_Vs": 4, "last": 0, "diag": 0}


def smoothed(rows: DataFrame, model: Switching, key: str = "series_id", order: str = "t", second_order: bool = False, keep=()) -> DataFrame:
    """Adds smoothed moments and chances of each state and of each pair with the next row.

    First order: pairs (j, k) with the destination's dynamics, collapsed over k. Second order:
    from a filter with pairs, triples (i, j, k) that keep the middle state. pair_m, pair_P and
    cross are those of this row given both states, next_ms and next_Vs those of the next row; they
    are zeros at a series' last row.
    """
    start, step, inputs = smoother_steps(model, second_order)
    return fold(rows, key, order, start, step, SMOOTHED, inputs, keep, backward=True)


def smoother_steps(model: Switching, second_order: bool = False) -> tuple[Callable, Callable, list[str]]:
    """start, step and inputs of the smoother."""
    K, d = model.m0.shape
    lay = {"sm": (K, K, d), "sP": (K, K, d, d), "joint": (K, K)}

    def start(n):
        return {k: np.zeros((n, *v)) for k, v in lay.items()}

    A, Q = model.A[None, None], model.Q[None, None]

    def first_order(s, x):
        sm, sP, ps = s["sm"][:, 0], s["sP"][:, 0], s["joint"].sum(1)
        m, P, c = _rts(x["m"][:, :, None], x["V"][:, :, None], A, Q, sm[:, None], sP[:, None])
        u = x["p"][:, :, None] * model.Z[None]
        total = u.sum(1, keepdims=True)
        joint = np.where(total > 0, u / np.where(total > 0, total, 1), 0) * ps[:, None, :]
        return m, P, c, joint, np.broadcast_to(sm[:, None], m.shape), np.broadcast_to(sP[:, None], P.shape)

    def second_order_pairs(s, x):
        """Triples: x_t given i, j, k; returned also collapsed over i for the statistics."""
        m, P, c = _rts(x["pm"][:, :, :, None], x["pV"][:, :, :, None], A[:, :, None], Q[:, :, None], s["sm"][:, None], s["sP"][:, None])
        return m, P, c

    def step(s, x, fresh):
        end = fresh[:, None]
        if not second_order:
            m, P, c, joint, ahead, ahead_P = first_order(s, x)
            ps = np.where(end, x["p"], joint.sum(2))
            w = np.where(ps[:, :, None] > 0, joint / np.where(ps > 0, ps, 1)[:, :, None], 1 / K)
            ms, Ps = collapse(m, P, w, 2)
        else:
            m3, P3, c3 = second_order_pairs(s, x)
            joint = s["joint"]
            mid = joint.sum(2)
            ps = np.where(end, x["p"], mid)
            w = np.where(mid[:, :, None] > 0, joint / np.where(mid > 0, mid, 1)[:, :, None], 1 / K)
            pair_ms, pair_Ps = collapse(m3, P3, np.broadcast_to(w[:, None], m3.shape[:-1]), 3)
            e = fresh[:, None, None, None]
            pair_ms, pair_Ps = np.where(e, x["pm"], pair_ms), np.where(e[..., None], x["pV"], pair_Ps)
            total = x["pp"].sum(1, keepdims=True)
            v = np.where(total > 0, x["pp"] / np.where(total > 0, total, 1), 1 / K)  # source given middle
            ms, Ps = collapse(pair_ms, pair_Ps, v, 1)
            vi = np.broadcast_to(v[..., None], m3.shape[:-1])
            m, P = collapse(m3, P3, vi, 1)
            # cross covariance of mixtures: the next mean does not depend on the source
            c = (vi[..., None, None] * c3).sum(1)
            ahead, ahead_P = s["sm"], s["sP"]
        e = fresh[:, None, None]
        ms, Ps = np.where(e, x["m"], ms), np.where(e[..., None], x["V"], Ps)
        most = TRACE_CAP * np.trace(x["V"], axis1=-2, axis2=-1).max(axis=-1)
        held = np.trace(Ps, axis1=-2, axis2=-1).max(axis=-1) > most
        Ps = _capped(Ps, most)
        off = lambda a: np.where(fresh.reshape(-1, *[1] * (a.ndim - 1)), 0.0, a)
        out = {"ms": ms, "Vs": Ps, "ps": ps, "joint": off(joint), "pair_m": off(m), "pair_P": off(P), "cross": off(c), "next_ms": off(ahead), "next_Vs": off(ahead_P), "last": fresh.astype(float), "diag": marks(capped=held, **of_moments(ms, Ps))}
        if second_order:
            carry = {"sm": pair_ms, "sP": pair_Ps, "joint": v * ps[:, None, :]}
        else:
            rep = lambda a: np.repeat(a[:, None], K, 1)
            carry = {"sm": rep(ms), "sP": rep(Ps), "joint": rep(ps) / K}
        return carry, out

    return start, step, ["m", "V", "p", *(["pm", "pV", "pp"] if second_order else [])]


def path_scores(filtered_rows: DataFrame) -> DataFrame:
    """The most likely state of each row by the filter's chances."""
    from pyspark.sql import functions as F

    best = F.array_position("p", F.array_max("p")) - 1
    return filtered_rows.withColumn("state", best.cast("int"))


def path(series: DataFrame, model: Switching, inputs: list[str], key: str = "series_id", order: str = "t") -> DataFrame:
    """(key, order, state): the most likely joint path, with densities given the state before; ties go to the lower state.

    Scores of what follows run backward, then the path forward.
    """
    K, lz = model.k, safe_log(np.asarray(model.Z, float))
    rows = filtered(series, model, inputs, key, order, scores=True)

    def start(n):
        return {"s": np.zeros((n, K)), "e": np.zeros((n, K, K))}

    def score(s, x, fresh):
        after = lz[None] + s["e"] + s["s"][:, None, :]
        value = np.where(fresh[:, None], 0.0, after.max(axis=2))
        return {"s": value, "e": x["pll"]}, {"score": value, "to": np.where(fresh[:, None], 0, after.argmax(axis=2)).astype(float)}

    scored = fold(rows, key, order, start, score, {"score": 1, "to": 1}, ["pll"], ["p"], backward=True)

    def begin(n):
        return {"z": np.zeros(n, np.int64), "to": np.zeros((n, K))}

    def trace(s, x, fresh):
        first = (safe_log(x["p"]) + x["score"]).argmax(axis=1)
        z = np.where(fresh, first, s["to"][np.arange(len(fresh)), s["z"]].astype(np.int64))
        return {"z": z, "to": x["to"]}, {"state": z.astype(float)}

    got = fold(scored, key, order, begin, trace, {"state": 0}, ["p", "score", "to"])
    return got.withColumn("state", got["state"].cast("int"))


def _weighted(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.einsum("nk,nka,nkb->kab", w, x, y)


def statistics(rows: DataFrame, y: str | None = "y") -> dict[str, np.ndarray]:
    """Sums over all rows for the maximisation step, by state; rows keep the filter's ll and first."""

    make, used = _sums(y)
    return totals(rows, used, make)


def _sums(y: str | None) -> tuple[Callable, list[str]]:
    """What adds up the rows of a batch, and the columns that it reads."""

    def make(x):
        ms, Ps, ps, joint = x["ms"], x["Vs"], x["ps"], x["joint"]
        first = x["first"] > 0
        second = Ps + ms[..., :, None] * ms[..., None, :]
        pair = x["pair_P"] + x["pair_m"][..., :, None] * x["pair_m"][..., None, :]
        moved = transposed(x["cross"]) + x["next_ms"][..., :, None] * x["pair_m"][..., None, :]
        out = {
            "gamma": np.einsum("nk,nkab->kab", ps, second), "gamma2": np.einsum("nk,nkab->kab", ps[~first], second[~first]),
            "gamma1": np.einsum("njk,njkab->kab", joint, pair), "beta": np.einsum("njk,njkab->kab", joint, moved),
            "joint": joint.sum(0), "weight": ps.sum(0), "weight2": ps[~first].sum(0), "first": ps[first].sum(0),
            "m0": np.einsum("nk,nka->ka", ps[first], ms[first]), "P0": np.einsum("nk,nkab->kab", ps[first], second[first]),
            "n": np.array([len(ps), first.sum()], float), "ll": np.array(x["ll"].sum()),
        }
        if y:
            out |= {"delta": np.einsum("nk,no,nka->koa", ps, x[y], ms), "alpha": np.einsum("nk,no,np->kop", ps, x[y], x[y])}
        return out

    return make, ["first", "ms", "Vs", "ps", "joint", "pair_m", "pair_P", "cross", "next_ms", "ll", *([y] if y else [])]


def maximised(model: Switching, s: dict[str, np.ndarray], concentration: float = 1.0, stickiness: float = 0.0, learn: tuple[str, ...] = ("A", "Q", "Z", "prior", "init", "obs"), shared_R: bool = True) -> Switching:
    """Closed forms by state; the chain's rows with a Dirichlet prior; R pooled over states if shared."""
    K = model.k
    new = model
    w2 = np.maximum(s["weight2"], 1e-10)[:, None, None]
    A = transposed(psd_solve(s["gamma1"], transposed(s["beta"]))) if "A" in learn else model.A
    if "A" in learn:
        new = replace(new, A=A)
    if "Q" in learn:
        b = A @ transposed(s["beta"])
        q = s["gamma2"] - b - transposed(b) + A @ s["gamma1"] @ transposed(A)
        new = replace(new, Q=project_psd(q / w2))
    if "Z" in learn:
        z = np.maximum(s["joint"] + concentration + stickiness * np.eye(K) - 1, 0)
        total = z.sum(1, keepdims=True)
        new = replace(new, Z=np.where(total > 0, z / np.where(total > 0, total, 1), model.Z))
    if "prior" in learn:
        new = replace(new, prior=s["first"] / max(s["n"][1], 1))
    if "init" in learn:
        w = np.maximum(s["first"], 1e-10)[:, None]
        m0 = s["m0"] / w
        new = replace(new, m0=m0, P0=project_psd(s["P0"] / w[..., None] - m0[..., :, None] * m0[..., None, :], 1e-4))
    if "obs" in learn and isinstance(model.obs, GaussianObs):
        H = transposed(psd_solve(s["gamma"], transposed(s["delta"])))
        r = s["alpha"] - H @ transposed(s["delta"])
        R = np.repeat((r.sum(0) / s["weight"].sum())[None], K, 0) if shared_R else r / np.maximum(s["weight"], 1e-10)[:, None, None]
        new = replace(new, obs=GaussianObs(H, project_psd(R)))
    return new


def entropy_of_chain(ps: np.ndarray, joint: np.ndarray) -> float:
    """Entropy of a smoothed chain from one series' chances (rows, K) and joints (rows - 1, K, K)."""
    h = lambda p: -(p * np.where(p > 0, safe_log(np.maximum(p, 1e-300)), 0)).sum()
    return float(h(joint) - h(ps[1:-1]))


def gaussian_entropy(P: np.ndarray) -> np.ndarray:
    d = P.shape[-1]
    return 0.5 * (d * (1 + np.log(2 * np.pi)) + log_det(P))


def transition_value(A: np.ndarray, Q: np.ndarray, gamma1: np.ndarray, gamma2: np.ndarray, beta: np.ndarray, weight: float) -> float:
    """Expected log density of one state's steps, from its sums."""
    off = beta @ A.T
    left = gamma2 - off - off.T + A @ gamma1 @ A.T
    return float(-0.5 * (weight * (len(A) * np.log(2 * np.pi) + np.linalg.slogdet(Q)[1]) + np.trace(psd_solve(Q, left))))


def expected_log_likelihood(model: Switching, s: dict[str, np.ndarray]) -> float:
    """Expected log density of observations, states and chain under a first-order smoother, from `statistics`."""
    K, d = model.m0.shape
    xlogy = lambda w, p: float(np.where(w > 0, w * safe_log(np.where(w > 0, p, 1)), 0).sum())
    total = xlogy(s["first"], model.prior) + xlogy(s["joint"], model.Z)
    for k in range(K):
        m0, P0 = model.m0[k], model.P0[k]
        off = np.outer(s["m0"][k], m0)
        left = s["P0"][k] - off - off.T + s["first"][k] * np.outer(m0, m0)
        total -= 0.5 * (s["first"][k] * (d * np.log(2 * np.pi) + np.linalg.slogdet(P0)[1]) + np.trace(psd_solve(P0, left)))
        total += transition_value(model.A[k], model.Q[k], s["gamma1"][k], s["gamma2"][k], s["beta"][k], s["weight2"][k])
        H, R = model.obs.H[k], model.obs.R[k]
        cross = H @ s["delta"][k].T
        left = s["alpha"][k] - cross - cross.T + H @ s["gamma"][k] @ H.T
        total -= 0.5 * (s["weight"][k] * (len(R) * np.log(2 * np.pi) + np.linalg.slogdet(R)[1]) + np.trace(psd_solve(R, left)))
    return float(total)


def trajectory_entropy(rows: DataFrame) -> float:
    """Entropy of a first-order smoother's chain of states and Gaussians, summed over series; rows: of `smoothed`, with next_Vs and the filter's first."""

    def make(x):
        xlogx = lambda p: float(np.where(p > 0, p * safe_log(np.where(p > 0, p, 1)), 0).sum())
        last, first = x["last"] > 0, x["first"] > 0
        joint, ps = x["joint"][~last], x["ps"][~last]
        chain = -xlogx(x["ps"][first]) - (xlogx(joint) - xlogx(ps))
        ends = (x["ps"][last] * gaussian_entropy(x["Vs"][last])).sum()
        gain = transposed(psd_solve(x["next_Vs"][~last], transposed(x["cross"][~last])))
        left = x["pair_P"][~last] - gain @ transposed(x["cross"][~last])
        return {"h": np.array(chain + ends + (joint * gaussian_entropy(symmetric(left))).sum())}

    return float(totals(rows, ["first", "last", "ps", "Vs", "joint", "pair_P", "cross", "next_Vs"], make)["h"])


def bound(series: DataFrame, model: Switching, key: str = "series_id", order: str = "t", y: str = "y") -> dict[str, float]:
    """Evidence, expected log density, entropy and their sum, the bound; for one state it is the evidence itself."""
    rows = smoothed(filtered(series, model, [y], key, order), model, key, order, keep=[y, "ll", "first"])
    s = statistics(rows, y)
    expected, entropy = expected_log_likelihood(model, s), trajectory_entropy(rows)
    return {"log_likelihood": float(s["ll"]), "expected": expected, "entropy": entropy, "bound": expected + entropy}


def evidences(series: DataFrame, models: list[Switching], inputs: list[str], key: str = "series_id", order: str = "t") -> list[float]:
    """Log likelihoods of several models in one pass over the rows."""
    return evidence(series, [steps_of(m, inputs) for m in models], inputs, key, order)


def fit_gradient(series: DataFrame, at: dict[str, np.ndarray], spec: dict[str, Transform], build: Callable[[dict], Switching], inputs: list[str], steps: int = 50, key: str = "series_id", order: str = "t", **how) -> Fit:
    """Adam over the parameters that `build` makes a model of; the result holds them."""
    return by_gradient(at, spec, lambda ps: evidences(series, [build(p) for p in ps], inputs, key, order), series.count(), steps, **how)


def matrices(model: Switching, learn: tuple[str, ...] = ("A", "Q", "Z", "prior", "m0", "P0", "H", "R")) -> tuple[dict, dict, Callable]:
    """at, spec and build for fits of a Gaussian switching model's own matrices."""
    kinds = {"A": UNCONSTRAINED, "Q": stacked(PSD_MATRIX), "Z": STOCHASTIC_ROW, "prior": STOCHASTIC_ROW, "m0": UNCONSTRAINED, "P0": stacked(PSD_MATRIX), "H": UNCONSTRAINED, "R": stacked(PSD_MATRIX)}
    whole = {c: getattr(model, c) for c in ("A", "Q", "Z", "prior", "m0", "P0")} | {"H": model.obs.H, "R": model.obs.R}

    def build(p):
        v = whole | p
        return replace(model, **{c: v[c] for c in ("A", "Q", "Z", "prior", "m0", "P0")}, obs=GaussianObs(v["H"], v["R"]))

    return {c: np.asarray(whole[c], float) for c in learn}, {c: kinds[c] for c in learn}, build


def fit(series: DataFrame, model: Switching, inputs: list[str], max_iter: int = 20, tolerance: float = 1e-4, key: str = "series_id", order: str = "t", second_order: bool = False, project: Callable[[Switching], Switching] = lambda m: m, m_step: Callable | None = None, **how) -> Fit:
    """EM over all series; `project` maps each step's parameters into the model's family."""
    y = inputs[0] if isinstance(model.obs, GaussianObs) else None

    def e_step(model):
        got = filtered(series, model, inputs, key, order, second_order)
        rows = smoothed(got, model, key, order, second_order, [*inputs, "ll", "first"])
        s = statistics(rows, y)
        return float(s["ll"]), (s, rows)

    def step(model, held):
        new = maximised(model, held[0], **how)
        if m_step:
            new = m_step(new, held[1])
        return project(new)

    return em(model, e_step, step, max_iter, tolerance)


def window_moments(series: DataFrame, key: str = "series_id", order: str = "t", y: str = "y", window: int = 50) -> DataFrame:
    """(key, window, n, mean, cov) of whole stretches of rows: what tells states apart before any fit."""
    from pyspark.sql import functions as F

    n = len(series.select(y).first()[0])
    stretch = F.floor(F.col(order) / window).cast("long")
    sums = [F.sum(F.col(y)[i]).alias(f"s{i}") for i in range(n)] + [F.sum(F.col(y)[i] * F.col(y)[j]).alias(f"q{i}{j}") for i in range(n) for j in range(i, n)]
    got = series.groupBy(key, stretch.alias("window")).agg(F.count("*").alias("n"), *sums).filter(F.col("n") == window)
    cov = [[(F.col(f"q{min(i, j)}{max(i, j)}") - F.col(f"s{i}") * F.col(f"s{j}") / window) / (window - 1) for j in range(n)] for i in range(n)]
    return got.select(key, "window", "n", F.array(*[F.col(f"s{i}") / window for i in range(n)]).alias("mean"), F.array(*[F.array(*r) for r in cov]).alias("cov"))


def _upper(cov: np.ndarray) -> np.ndarray:
    """What tells windows apart: the upper triangle of their covariances."""
    i, j = np.triu_indices(cov.shape[-1])
    return cov[:, i, j]


def seeded(rows: DataFrame, k: int, starts: int = 5, rounds: int = 4, seed: int = 0) -> np.ndarray:
    """(starts, k, features): first centres of windows for several starts, spread out by k-means||.

    Each round draws windows with chances in proportion to their squared distance from the centres so far, 2k a round and
    start on average, by a hash of the window; two jobs a round serve all starts. The candidates, weighed by the windows nearest to them,
    are thinned to k on the driver by the same rule. A draw depends on the window and the seed alone.
    """
    from driftline.operators.coupling import _uniform

    rows = rows.select("cov", "__hash")
    first = rows.orderBy("__hash").limit(starts).toArrow()
    rng = np.random.default_rng(seed)
    held = [_upper(to_numpy(first.column("cov").combine_chunks()))[[s % first.num_rows]] for s in range(starts)]

    def far(f, centres):
        return ((f[:, None] - centres[None]) ** 2).sum(-1)

    for turn in range(rounds):
        total = totals(rows, ["cov"], lambda x, held=held: {"d": np.array([far(_upper(x["cov"]), c).min(1).sum() for c in held])})["d"]

        def drawn(batches, held=held, total=total, turn=turn):
            for batch in batches:
                f, h = _upper(to_numpy(batch.column("cov"))), batch.column("__hash").to_numpy().view(np.uint64)
                for s, c in enumerate(held):
                    with np.errstate(over="ignore"):
                        u = _uniform(h * np.uint64(31) + np.uint64(turn * len(held) + s + 1000 * seed))
                    at = np.flatnonzero(u * max(total[s], 1e-300) < 2 * k * far(f, c).min(1))
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s, np.int32)), pa.array(f[at].tolist(), pa.list_(pa.float64()))], names=["s", "f"])

        found = rows.mapInArrow(drawn, "s int, f array<double>").toArrow()
        for s in range(starts):
            own = [f for t, f in zip(found.column("s").to_pylist(), found.column("f").to_pylist()) if t == s]
            if own:
                held[s] = np.unique(np.concatenate([held[s], np.array(own)]), axis=0)

    def counted(x):
        f = _upper(x["cov"])
        return {str(s): np.bincount(far(f, c).argmin(1), minlength=len(c)) for s, c in enumerate(held)}

    weight, out = totals(rows, ["cov"], counted), []
    for s, c in enumerate(held):
        w = np.maximum(weight[str(s)], 1e-12)
        chosen = [int(rng.choice(len(c), p=w / w.sum()))]
        while len(chosen) < k:
            d = w * far(c, c[chosen]).min(1)
            chosen.append(int(rng.choice(len(c), p=d / d.sum() if d.sum() > 0 else w / w.sum())))
        out.append(c[chosen])
    return np.array(out)


def mixture(rows: DataFrame, k: int, rounds: int = 20, starts: int = 5, seed: int = 0, floor: float = 1e-6) -> dict[str, np.ndarray]:
    """A mixture of k Gaussians with full covariances over windows' covariances: share, centre, spread, means of windows, likelihood.

    Several starts run at once, one job a round for all of them, and the likeliest is taken; sums are matrices of the
    features' size, so what a round gathers does not grow with the windows. One of fewer windows than states is None.
    """
    every = totals(rows, ["cov"], lambda x: {"n": np.array(float(len(x["cov"]))), "f": _upper(x["cov"]).sum(0), "ff": _upper(x["cov"]).T @ _upper(x["cov"])})
    if not every or every["n"] < 2 * k:
        return {}
    mean = every["f"] / every["n"]
    whole = symmetric(every["ff"] / every["n"] - np.outer(mean, mean))
    lift = floor * max(float(np.trace(whole)) / len(mean), 1e-12) * np.eye(len(mean))
    centre, spread = seeded(rows, k, starts, seed=seed), np.tile(whole + lift, (starts, k, 1, 1))
    share = np.full((starts, k), 1 / k)
    for step in range(rounds + 1):
        def make(x, centre=centre, spread=spread, share=share):
            f = _upper(x["cov"])
            off = f[None, None] - centre[:, :, None]
            pull = np.linalg.solve(spread, np.swapaxes(off, -1, -2))
            quad = np.einsum("skwa,skaw->skw", off, pull)
            lp = np.log(np.maximum(share, 1e-300))[..., None] - 0.5 * (quad + np.linalg.slogdet(spread)[1][..., None] + f.shape[1] * np.log(2 * np.pi))
            z = log_sum_exp(lp, 1)
            r = np.exp(lp - z[:, None])
            return {"r": r.sum(2), "f": r @ f, "ff": np.einsum("skw,wa,wb->skab", r, f, f), "m": r @ x["mean"], "ll": z.sum(1)}

        s = totals(rows, ["mean", "cov"], make)
        if step == rounds:
            break
        w = np.maximum(s["r"], 1e-10)
        centre = s["f"] / w[..., None]
        spread = symmetric(s["ff"] / w[..., None, None] - centre[..., :, None] * centre[..., None, :]) + lift
        spread = project_psd(spread, float(lift[0, 0]))
        share = w / w.sum(1, keepdims=True)
    best = int(np.argmax(s["ll"]))
    return {"share": share[best], "centre": centre[best], "spread": spread[best], "mean": s["m"][best] / np.maximum(s["r"][best], 1e-10)[:, None], "log_likelihood": s["ll"][best]}


def warm_start(series: DataFrame, model: Switching, key: str = "series_id", order: str = "t", y: str = "y", window: int = 50, rounds: int = 20, seed: int = 0, starts: int = 5) -> Switching:
    """The model with a prior, first means and spread from a mixture over windows' covariances; unchanged with too few windows.

    The mixture has full covariances, centres spread out by k-means|| and several starts, all in one job a round.
    """
    from pyspark.sql import functions as F

    K, d = model.m0.shape
    if K < 2:
        return model
    rows = reused(window_moments(series, key, order, y, window).withColumn("__hash", F.xxhash64(F.lit(seed), key, "window")))
    got = mixture(rows, K, rounds, starts, seed)
    if not got:
        return model
    every = totals(rows, ["mean", "cov"], lambda x: {"n": np.array(float(len(x["mean"]))), "m": x["mean"].sum(0), "mm": (x["mean"] ** 2).sum(0), "v": np.einsum("waa->a", x["cov"])})
    prior = got["share"] * 0.9 + 0.1 / K
    total = every["v"] / every["n"] + every["mm"] / every["n"] - (every["m"] / every["n"]) ** 2
    new = replace(model, prior=prior / prior.sum(), P0=np.repeat(max(float(total.mean()), 1e-6) * np.eye(d)[None], K, 0))
    H = model.obs.H
    if np.allclose(H, H[:1]):  # only where all states see alike do means of windows say where they begin
        new = replace(new, m0=got["mean"] @ np.linalg.pinv(H[0]).T)
    return new


def statistics_of(series: DataFrame, models: list[Switching], inputs: list[str], key: str = "series_id", order: str = "t", second_order: bool = False, y: str | None = "y") -> list[dict[str, np.ndarray]]:
    """`statistics` under each of several models: all of them in one filter pass, one smoother pass and one sum."""
    into = {"m": 3, "V": 4, "p": 2, "ll": 1, "first": 0} | ({"pm": 4, "pV": 5, "pp": 3} if second_order else {})
    rows = fold(series, key, order, *side_by_side([steps_of(m, inputs, second_order) for m in models]), into, inputs, inputs)
    back = [smoother_steps(m, second_order) for m in models]
    given = back[0][2]
    start, step = side_by_side([(a, b) for a, b, _ in back], given)
    rows = fold(rows, key, order, start, step, {k: v + 1 for k, v in SMOOTHED.items()}, given, [*inputs, "ll", "first"], backward=True)
    make, used = _sums(y)
    shared = {"first", *([y] if y else [])}

    def each(x):
        return {f"{k} {name}": v for k in range(len(models)) for name, v in make({c: a if c in shared else a[:, k] for c, a in x.items()}).items()}

    got = totals(rows, used, each)
    return [{name.split(" ", 1)[1]: v for name, v in got.items() if name.startswith(f"{k} ")} for k in range(len(models))]


def fit_restarts(series: DataFrame, starts: list[Switching], inputs: list[str], max_iter: int = 20, tolerance: float = 1e-4, key: str = "series_id", order: str = "t", second_order: bool = False, project: Callable[[Switching], Switching] = lambda m: m, **how) -> tuple[Fit, list[Fit]]:
    """EM from several starts at once: the best fit, and that of each start.

    A step takes one filter, one smoother and one sum for all starts that are still moving. A start whose likelihood
    falls stops with its last good parameters; one whose numbers break down before its first likelihood is lost.
    """
    y = inputs[0] if isinstance(starts[0].obs, GaussianObs) else None
    fits, held = [Fit(m) for m in starts], {}
    trying, done = dict(enumerate(starts)), set()
    for step in range(max_iter + 1):
        if not trying:
            break
        got = statistics_of(series, list(trying.values()), inputs, key, order, second_order, y)
        for (k, model), s in zip(list(trying.items()), got):
            ll, fit = float(s["ll"]), fits[k]
            if not all(np.isfinite(v).all() for v in s.values()):  # a likelihood may stay finite where moments do not
                done.add(k)
                continue
            if fit.log_likelihoods:
                small, fell = converged(ll, fit.log_likelihood, tolerance)
                if fell:
                    done.add(k)
                    continue
                fit.converged = small
                if small:
                    done.add(k)
            fit.params, held[k] = model, s
            fit.log_likelihoods.append(ll)
        trying = {}
        for k in range(len(starts)) if step < max_iter else []:
            if k not in done:
                try:
                    trying[k] = project(maximised(fits[k].params, held[k], **how))
                except (np.linalg.LinAlgError, FloatingPointError, ValueError):
                    done.add(k)
    live = [f for f in fits if f.log_likelihoods]
    if not live:
        raise FloatingPointError("no start led to a fit")
    return max(live, key=lambda f: f.log_likelihood), fits


def best_of(starts: list[Switching], run: Callable[[Switching], Fit]) -> Fit:
    """The fit of the largest likelihood from several starts; starts that break down are passed over."""
    got = []
    for start in starts:
        try:
            got.append(run(start))
        except (np.linalg.LinAlgError, FloatingPointError):
            continue
    if not got:
        raise FloatingPointError("no start led to a fit")
    return max(got, key=lambda f: f.log_likelihood)
