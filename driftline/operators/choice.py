"""Choices among options whose values drift: softmax filters with covariates, their smoothers and fits.

Option 0 is the reference of value 0; the state holds the others. Noise is added before the
first choice as before any other. covariates of a trial drive the move into it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.matrices import log_det, mv, psd_solve, softmax, symmetric, transposed, vec_solve
from driftline.plans.fitting import Fit, best_on_grid, em
from driftline.plans.fold import fold, fold_sums, totals
from driftline.plans.lineage import reused

#: Trial inverse temperatures.
TEMPERATURES = [0.1, 0.5, 1.0, 2.0, 3.0, 5.0, 8.0, 12.0, 20.0]


@dataclass(frozen=True)
class Choice:
    """x_t = decay * x_{t-1} + gain u_t + N(0, noise I); choice ~ softmax(temperature * [0, x] + weights v_t).

    weights: a row for each option, or for each but the first, whose row is then 0.
    """

    n_options: int
    noise: float = 0.01
    temperature: float = 1.0
    decay: float = 1.0
    gain: np.ndarray | None = None
    weights: np.ndarray | None = None
    m0: np.ndarray | None = None
    P0: np.ndarray | None = None

    @property
    def d(self) -> int:
        return self.n_options - 1

    def offsets(self, features: np.ndarray) -> np.ndarray:
        w = np.asarray(self.weights, float)
        return features @ (w if len(w) == self.n_options else np.concatenate([np.zeros((1, w.shape[1])), w])).T

    def prior(self) -> tuple[np.ndarray, np.ndarray]:
        return (np.zeros(self.d) if self.m0 is None else self.m0), (np.eye(self.d) if self.P0 is None else self.P0)


def softmax_update(pm, pv, choice, temperature, offset=0.0, steps: int = 3):
    """Laplace update by Newton steps: mean, covariance, log evidence."""
    d = pm.shape[-1]
    prec = psd_solve(pv, np.broadcast_to(np.eye(d), pv.shape))
    chosen = np.eye(d + 1)[choice]

    def options(x):
        return temperature * np.concatenate([np.zeros((*x.shape[:-1], 1)), x], -1) + offset

    def information(p):
        q = p[..., 1:]
        return temperature**2 * (q[..., :, None] * np.eye(d) - q[..., :, None] * q[..., None, :])

    x = pm
    for _ in range(steps):
        p = softmax(options(x))
        x = x + vec_solve(prec + information(p), temperature * (chosen - p)[..., 1:] + mv(prec, pm - x))
    logits = options(x)
    p = softmax(logits)
    P = symmetric(psd_solve(prec + information(p), np.broadcast_to(np.eye(d), prec.shape)))
    loglik = (chosen * np.log(np.maximum(p, 1e-300))).sum(-1)
    off = x - pm
    return x, P, loglik - 0.5 * (off * mv(prec, off)).sum(-1) - 0.5 * log_det(pv) + 0.5 * log_det(P)


def _steps(tried: list[Choice], choice: str, covariates: str | None, features: str | None, several: bool):
    """start and step of one model's filter, or of several over the same rows."""

    def start(n):
        out = {}
        for k, c in enumerate(tried):
            m, P = c.prior()
            out |= {f"m{k}": np.repeat(m[None], n, 0).astype(float), f"P{k}": np.repeat(P[None], n, 0).astype(float)}
        return out

    def step(s, x, fresh):
        carry, lls = {}, []
        for k, c in enumerate(tried):
            pm = c.decay * s[f"m{k}"]
            if covariates and c.gain is not None:
                pm = pm + x[covariates] @ c.gain.T
            pv = c.decay**2 * s[f"P{k}"] + c.noise * np.eye(c.d)
            offset = c.offsets(x[features]) if features and c.weights is not None else 0.0
            m, P, ll = softmax_update(pm, pv, x[choice].astype(np.int64), c.temperature, offset)
            carry |= {f"m{k}": m, f"P{k}": P}
            lls.append(ll)
        if several:
            return carry, {"ll": np.stack(lls, 1)}
        shown = lambda x: softmax(c.temperature * np.concatenate([np.zeros((len(x), 1)), x], 1))
        return carry, {"m": m, "V": P, "pm": pm, "pV": pv, "ll": lls[0], "probs": shown(m), "pprobs": shown(pm)}

    return start, step


def filtered(trials: DataFrame, models: Choice | list[Choice], covariates: str | None = None, features: str | None = None, key: str = "series_id", order: str = "t", choice: str = "choice") -> DataFrame:
    """(key, order, choice, m, V, pm, pV, ll, probs, pprobs) under one model, probs of filtered and pprobs of predicted values; (key, order, ll) with an array of log evidences under several.

    Several models are valued in one pass over the rows.
    """
    several = isinstance(models, list)
    tried = models if several else [models]
    given = [choice, *[c for c in (covariates, features) if c]]
    into = {"ll": 1} if several else {"m": 1, "V": 2, "pm": 1, "pV": 2, "ll": 0, "probs": 1, "pprobs": 1}
    return fold(trials, key, order, *_steps(tried, choice, covariates, features, several), into, given, [] if several else given)


def log_evidence(trials: DataFrame, models: list[Choice], covariates: str | None = None, features: str | None = None, key: str = "series_id", order: str = "t", choice: str = "choice") -> list[float]:
    """Log evidence of each model, in one pass whose sums are made where the rows are valued."""
    given = [choice, *[c for c in (covariates, features) if c]]
    return fold_sums(trials, key, order, *_steps(models, choice, covariates, features, True), given)["ll"].tolist()


def smoothed(rows: DataFrame, model: Choice, key: str = "series_id", order: str = "t", keep=("choice", "ll"), covariates: str | None = None) -> DataFrame:
    """Backward with the stored predictions, so that covariates count: (key, order, keep, ms, Vs, cross, next_m, next_P, last).

    With `covariates`, also next_u, those of the next row, which drive the move into it.
    """
    d = model.d

    def start(n):
        return {"m": np.zeros((n, d)), "V": np.zeros((n, d, d)), "pm": np.zeros((n, d)), "pV": np.repeat(np.eye(d)[None], n, 0)}

    def step(s, x, fresh):
        j = transposed(psd_solve(s["pV"], model.decay * x["V"]))
        m = x["m"] + mv(j, s["m"] - s["pm"])
        P = symmetric(x["V"] + j @ (s["V"] - s["pV"]) @ transposed(j))
        c = j @ s["V"]
        e = fresh[:, None, None]
        m, P, c = np.where(e[..., 0], x["m"], m), np.where(e, x["V"], P), np.where(e, 0.0, c)
        out = {"ms": m, "Vs": P, "cross": c, "next_m": s["m"], "next_P": s["V"], "last": fresh.astype(float)}
        return {"m": m, "V": P, "pm": x["pm"], "pV": x["pV"]}, out

    def with_moves(s, x, fresh):
        carry, out = step({k: v for k, v in s.items() if k != "u"}, x, fresh)
        return carry | {"u": x[covariates]}, out | {"next_u": np.where(fresh[:, None], 0.0, s["u"])}

    into = {"ms": 1, "Vs": 2, "cross": 2, "next_m": 1, "next_P": 2, "last": 0}
    given = ["m", "V", "pm", "pV"]
    if covariates is None:
        return fold(rows, key, order, start, step, into, given, keep, backward=True)
    width = model.gain.shape[1]
    return fold(rows, key, order, lambda n: start(n) | {"u": np.zeros((n, width))}, with_moves, into | {"next_u": 1}, [*given, covariates], keep, backward=True)


def probabilities(values: Column, temperature: float) -> Column:
    """Softmax of [0, values] times the temperature."""
    from driftline.functions.links import softmax as sm
    from driftline.functions.uncertainty import append_reference_option

    return sm(F.transform(append_reference_option(values), lambda v: v * temperature))


def summaries(rows: DataFrame, choice: str = "choice") -> DataFrame:
    """Adds entropy, surprise and variances of the options to filtered rows; surprise is of the predicted values."""
    from driftline.functions import uncertainty

    return rows.withColumns(
        {
            "entropy": uncertainty.categorical_entropy(F.col("probs")),
            "surprise": uncertainty.surprise(F.col("pprobs"), F.col(choice).cast("int")),
            "variances": uncertainty.option_variances(F.col("V")),
        }
    )


def refit_weights(rows: DataFrame, model: Choice, features: str, steps: int = 5, choice: str = "choice") -> np.ndarray:
    """Weights of the observation's features at smoothed values: damped Newton steps, option by option, in one job each."""
    w = np.asarray(model.weights, float)
    theta = w if len(w) == model.n_options else np.concatenate([np.zeros((1, w.shape[1])), w])
    for _ in range(steps):
        def make(x, theta=theta):
            logits = model.temperature * np.concatenate([np.zeros((len(x["ms"]), 1)), x["ms"]], 1) + x[features] @ theta.T
            p = softmax(logits)
            chosen = np.eye(model.n_options)[x[choice].astype(np.int64)]
            return {"g": np.einsum("nk,nf->kf", chosen - p, x[features]), "h": np.einsum("nk,nf,ne->kfe", p * (1 - p), x[features], x[features])}

        s = totals(rows, ["ms", features, choice], make)
        theta = theta + 0.5 * vec_solve(s["h"], s["g"])
    return theta


def fit(trials: DataFrame, model: Choice, covariates: str | None = None, max_iter: int = 10, tolerance: float = 1e-4, learn: tuple[str, ...] = ("noise", "temperature"), grid: list[float] | None = None, key: str = "series_id", order: str = "t", features: str | None = None) -> Fit:
    """EM: gain, decay and noise by smoothed moments, weights by Newton steps, the temperature by its evidence on a grid and golden sections.

    learn: any of gain, weights, decay, noise, temperature, taken in that order.
    """
    moves = covariates if covariates and model.gain is not None else None
    how = {"covariates": covariates, "features": features, "key": key, "order": order}
    keep = ["choice", "ll", *([features] if features else [])]

    def e_step(model):
        rows = smoothed(filtered(trials, model, covariates, features, key, order), model, key, order, keep, moves)
        rows = reused(rows) if "weights" in learn and features else rows

        def make(x):
            go = x["last"] == 0
            m, P, n, Pn, c = x["ms"][go], x["Vs"][go], x["next_m"][go], x["next_P"][go], x["cross"][go]
            tr = lambda a: np.trace(a, axis1=1, axis2=2).sum()
            out = {
                "nn": np.array((n * n).sum()), "nm": np.array((n * m).sum()), "mm": np.array((m * m).sum()),
                "vn": np.array(tr(Pn)), "vm": np.array(tr(P)), "vc": np.array(tr(c)),
                "steps": np.array(float(go.sum())), "ll": np.array(x["ll"].sum()),
            }
            if moves:
                u = x["next_u"][go]
                out |= {"nu": n.T @ u, "mu": m.T @ u, "uu": u.T @ u}
            return out

        s = totals(rows, ["ms", "Vs", "cross", "next_m", "next_P", "last", "ll", *(["next_u"] if moves else [])], make)
        return float(s["ll"]), (s, rows)

    def m_step(model, held):
        s, rows = held
        new = model
        if "gain" in learn and moves:
            new = replace(new, gain=psd_solve(s["uu"], (s["nu"] - model.decay * s["mu"]).T).T)
        if "weights" in learn and features:
            new = replace(new, weights=refit_weights(rows, model, features))
        # what the covariates move is taken off the next value
        by = lambda x: float((new.gain * x).sum()) if moves else 0.0
        if "decay" in learn:
            new = replace(new, decay=float(np.clip((s["nm"] - by(s.get("mu"))) / max(s["mm"] + s["vm"], 1e-10), 0.01, 1.0)))
        if "noise" in learn:
            a, B = new.decay, new.gain
            off = s["nn"] - 2 * a * s["nm"] + a * a * s["mm"]
            if moves:
                off = off - 2 * by(s["nu"]) + 2 * a * by(s["mu"]) + np.einsum("af,fg,ag->", B, s["uu"], B)
            q = (off + s["vn"] + a * a * s["vm"] - 2 * a * s["vc"]) / max(s["steps"], 1) / model.d
            new = replace(new, noise=max(float(q), 1e-8))
        if "temperature" in learn:
            at = best_on_grid(lambda bs: log_evidence(trials, [replace(new, temperature=b) for b in bs], **how), grid or TEMPERATURES)
            new = replace(new, temperature=at)
        return new

    return em(model, e_step, m_step, max_iter, tolerance)


def fit_gradient(trials: DataFrame, model: Choice, steps: int = 50, key: str = "series_id", order: str = "t", covariates: str | None = None, rate: float = 1e-2) -> Fit:
    """Adam over noise, temperature and decay; each step values all differences in one pass over the rows."""
    from driftline.plans import fitting

    n = trials.count()
    spec = {"noise": fitting.POSITIVE, "temperature": fitting.POSITIVE, "decay": fitting.UNIT_INTERVAL}
    at = {k: np.array([getattr(model, k)], float) for k in spec}
    put = lambda p: replace(model, **{k: float(p[k][0]) for k in spec})
    losses = lambda ps: [-x / n for x in log_evidence(trials, [put(p) for p in ps], key=key, order=order, covariates=covariates)]
    got = fitting.adam(at, spec, losses, steps, rate)
    return Fit(put(got.params), [x * n for x in got.log_likelihoods], got.converged)


def bic(log_likelihood: float, n_params: int, n: int) -> float:
    return -2 * log_likelihood + n_params * float(np.log(n))


def aic(log_likelihood: float, n_params: int) -> float:
    return -2 * log_likelihood + 2 * n_params


def against_null(trials: DataFrame, model: Choice, n_params: int, **how) -> dict[str, float]:
    """The model against even choices; learning is detected where BIC falls by more than 2."""
    n = trials.count()
    ll = log_evidence(trials, [model], **how)[0]
    null = -n * float(np.log(model.n_options))
    gain = bic(null, 0, n) - bic(ll, n_params, n)
    return {"log_likelihood": ll, "null_log_likelihood": null, "delta_bic": gain, "detected": gain > 2}


def switching_softmax(obs, m, P, choice, j):
    """For operators.switching: obs has one inverse temperature for each state."""
    k = choice.astype(np.int64).reshape(len(choice), *[1] * (m.ndim - 2))
    return softmax_update(m, P, np.broadcast_to(k, m.shape[:-1]), obs[j])


def switching_model(n_options: int, noises, temperatures, decays, Z, prior=None):
    """A switching model whose states differ in noise, temperature and decay."""
    from driftline.operators.switching import Switching

    d, K = n_options - 1, len(noises)
    eye = np.eye(d)
    return Switching(
        np.array([a * eye for a in decays]), np.array([q * eye for q in noises]), np.zeros((K, d)), np.array([eye] * K),
        np.asarray(Z, float), np.full(K, 1 / K) if prior is None else np.asarray(prior, float), switching_softmax, np.asarray(temperatures, float),
    )


def fit_switching(trials: DataFrame, model, max_iter: int = 10, tolerance: float = 1e-4, key: str = "series_id", order: str = "t", choice: str = "choice") -> Fit:
    """EM of a switching choice model: the chain from expected moves, each state's noise from its smoothed steps; decays and temperatures stay."""
    from driftline.operators import switching

    K, d = model.m0.shape

    def e_step(model):
        rows = switching.smoothed(switching.filtered(trials, model, [choice], key, order), model, key, order, keep=[choice, "ll"])
        decay = model.A[:, 0, 0]

        def make(x):
            go = x["last"] == 0
            m, V, joint, n, Vn, c = (x[k][go] for k in ("ms", "Vs", "joint", "next_ms", "next_Vs", "cross"))
            out = {"joint": joint.sum(0), "ll": np.array(x["ll"].sum())}
            w = joint.sum(1)
            tr = lambda a: np.trace(a, axis1=-2, axis2=-1)
            off = ((n[:, 0] - decay[:, None] * m) ** 2).sum(-1) + tr(Vn[:, 0]) + decay**2 * tr(V)
            return out | {"w": w.sum(0), "q": (w * off).sum(0) - 2 * decay * (joint * tr(c)).sum(axis=(0, 1))}

        s = totals(rows, ["ms", "Vs", "joint", "next_ms", "next_Vs", "cross", "last", "ll"], make)
        return float(s["ll"]), s

    def m_step(model, s):
        q = np.maximum(s["q"] / (np.maximum(s["w"], 1e-10) * d), 1e-8)
        total = s["joint"].sum(1, keepdims=True)
        Z = np.where(total > 0, s["joint"] / np.where(total > 0, total, 1), model.Z)
        return replace(model, Q=q[:, None, None] * np.eye(d), Z=Z)

    return em(model, e_step, m_step, max_iter, tolerance)


def switching_family(n_options: int, prior=None):
    """spec and build for switching.fit_gradient over noises, temperatures, decays and the chain of a switching choice model."""
    from driftline.plans.fitting import POSITIVE, STOCHASTIC_ROW, UNIT_INTERVAL, positive_capped

    spec = {"noises": POSITIVE, "temperatures": positive_capped(50.0), "decays": UNIT_INTERVAL, "Z": STOCHASTIC_ROW}

    def build(fixed: dict):
        return lambda p: switching_model(n_options, *[(fixed | p)[c] for c in ("noises", "temperatures", "decays", "Z")], prior)

    return spec, build
