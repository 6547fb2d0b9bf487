"""Chains of few states: filters, smoothers, best paths, and beliefs over reward contingencies.

Two-state chains with constant transitions run as scans in SQL, others as sweeps over blocks of
K x K matrices; both cut a long series into blocks. The first row takes the prior without a transition.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame

from driftline.operators.matrices import log_sum_exp, safe_log, softmax
from driftline.plans import scan, stretch
from driftline.plans.fitting import POSITIVE, STOCHASTIC_ROW, UNCONSTRAINED, UNIT_INTERVAL, Fit, bfgs, by_gradient, em
from driftline.plans.fold import fold, totals
from driftline.plans.lineage import reused

# ---------------------------------------------------------------- two states, in SQL


def _pairs(of: str) -> str:
    return ", ".join(f"'m{i}{j}', {of.format(i=i, j=j)}" for i in (0, 1) for j in (0, 1))


def two_state_filter(series: DataFrame, stay: tuple[float, float], prior: tuple[float, float], longest: int | None = None, key: str = "series_id", order: str = "t", block: int = scan.BLOCK) -> DataFrame:
    """(key, order, l0, l1, p0, p1, ll): posterior of each row from likelihoods l0 and l1, and the log of what it was expected with."""
    t = {(0, 0): stay[0], (0, 1): 1 - stay[0], (1, 0): 1 - stay[1], (1, 1): stay[1]}
    element = "named_struct(" + ", ".join(
        f"'m{i}{j}', if(x.{order} = 0, {float(i == j)!r}D, {t[i, j]!r}D) * x.l{j}" for i in (0, 1) for j in (0, 1)
    ) + ")"
    product = lambda i, j: f"(a.m{i}0 * b.m0{j} + a.m{i}1 * b.m1{j})"
    size = "greatest(" + ", ".join(product(i, j) for i in (0, 1) for j in (0, 1)) + ")"
    compose = "named_struct(" + ", ".join(f"'m{i}{j}', {product(i, j)} / {size}" for i in (0, 1) for j in (0, 1)) + ")"
    identity = "named_struct('m00', 1D, 'm01', 0D, 'm10', 0D, 'm11', 1D)"
    a0, a1 = (f"({prior[0]!r}D * e.m0{j} + {prior[1]!r}D * e.m1{j})" for j in (0, 1))
    start = f"named_struct('p0', {a0} / ({a0} + {a1}), 'p1', {a1} / ({a0} + {a1}), 'll', 0D)"
    q = [f"(if(x.{order} = 0, s.p{j}, s.p0 * {t[0, j]!r}D + s.p1 * {t[1, j]!r}D) * x.l{j})" for j in (0, 1)]
    step = f"named_struct('p0', {q[0]} / ({q[0]} + {q[1]}), 'p1', {q[1]} / ({q[0]} + {q[1]}), 'll', ln({q[0]} + {q[1]}))"
    return scan.run(series.select(key, order, "l0", "l1"), key, order, scan.Scan(element, compose, identity, start, step), longest, block)


def two_state_smoother(filtered: DataFrame, stay: tuple[float, float], longest: int | None = None, key: str = "series_id", order: str = "t", block: int = scan.BLOCK) -> DataFrame:
    """Adds s0, s1, the posterior given the whole series: a backward scan of likelihood products, times the filter."""
    t = {(0, 0): stay[0], (0, 1): 1 - stay[0], (1, 0): 1 - stay[1], (1, 1): stay[1]}
    # beta before a row from beta after it: column b <- T diag(l) b
    element = "named_struct(" + ", ".join(f"'m{i}{j}', {t[i, j]!r}D * x.l{j}" for i in (0, 1) for j in (0, 1)) + ")"
    product = lambda i, j: f"(b.m{i}0 * a.m0{j} + b.m{i}1 * a.m1{j})"
    size = "greatest(" + ", ".join(product(i, j) for i in (0, 1) for j in (0, 1)) + ")"
    compose = "named_struct(" + ", ".join(f"'m{i}{j}', {product(i, j)} / {size}" for i in (0, 1) for j in (0, 1)) + ")"
    identity = "named_struct('m00', 1D, 'm01', 0D, 'm10', 0D, 'm11', 1D)"
    start = "named_struct('s0', 0D, 's1', 0D, 'b0', (e.m00 + e.m01) / (e.m00 + e.m01 + e.m10 + e.m11), 'b1', (e.m10 + e.m11) / (e.m00 + e.m01 + e.m10 + e.m11))"
    z = "(x.p0 * s.b0 + x.p1 * s.b1)"
    n = [f"({t[i, 0]!r}D * x.l0 * s.b0 + {t[i, 1]!r}D * x.l1 * s.b1)" for i in (0, 1)]
    step = f"named_struct('s0', x.p0 * s.b0 / {z}, 's1', x.p1 * s.b1 / {z}, 'b0', {n[0]} / ({n[0]} + {n[1]}), 'b1', {n[1]} / ({n[0]} + {n[1]}))"
    ready = filtered.select(key, order, "l0", "l1", "p0", "p1")
    return scan.run(ready, key, order, scan.Scan(element, compose, identity, start, step), longest, block, backward=True).drop("b0", "b1")


# ---------------------------------------------------------------- any number of states


def forward(rows: DataFrame, transition: np.ndarray | None, prior: np.ndarray, logits: str = "ll", matrix: str | None = None, key: str = "series_id", order: str = "t", keep=()) -> DataFrame:
    """(key, order, ll, p, pred, lz): rows hold an array of log likelihoods; `matrix` names a column of per-row transitions."""
    k = len(prior)

    def start(n):
        return {"p": np.repeat(np.asarray(prior, float)[None], n, 0)}

    def step(s, x, fresh):
        moved = np.einsum("si,sij->sj", s["p"], x[matrix]) if matrix else s["p"] @ transition
        pred = np.where(fresh[:, None], s["p"], moved)
        joint = np.log(np.maximum(pred, 1e-30)) + x[logits]
        z = log_sum_exp(joint, -1)
        p = np.exp(joint - z[:, None])
        return {"p": p}, {"p": p, "pred": pred, "lz": z}

    assert transition is None or np.shape(transition) == (k, k)
    return fold(rows, key, order, start, step, {"p": 1, "pred": 1, "lz": 0}, [logits, *([matrix] if matrix else [])], [logits, *keep, *([matrix] if matrix else [])])


def backward(filtered: DataFrame, transition: np.ndarray | None, n_states: int, matrix: str | None = None, key: str = "series_id", order: str = "t", keep=()) -> DataFrame:
    """Adds sp, the smoothed posterior, and pair, its joint with the next row (zeros at the last), with filter marginals on the from side."""

    def start(n):
        return {"s": np.zeros((n, n_states)), "pred": np.ones((n, n_states)), "T": np.zeros((n, n_states, n_states))}

    def step(s, x, fresh):
        T = s["T"] if matrix else np.asarray(transition)
        joint = x["p"][:, :, None] * T * (s["s"] / np.maximum(s["pred"], 1e-30))[:, None, :]
        total = joint.sum(axis=(1, 2), keepdims=True)
        joint = np.where(total > 0, joint / np.where(total > 0, total, 1), 0)
        sp = np.where(fresh[:, None], x["p"], joint.sum(axis=2))
        joint = np.where(fresh[:, None, None], 0.0, joint)
        held = {"s": sp, "pred": x["pred"]}
        return held | {"T": x[matrix] if matrix else s["T"]}, {"sp": sp, "pair": joint, "last": fresh.astype(float)}

    return fold(filtered, key, order, start, step, {"sp": 1, "pair": 2, "last": 0}, ["p", "pred", *([matrix] if matrix else [])], ["lz", *keep], backward=True)


# ---------------------------------------------------------------- any number of states, in blocks


def _chain_inputs(transition: np.ndarray | None, logits: str, matrix: str | None) -> tuple[list[str], object]:
    """Columns that a row's matrix needs, and the function of it: ln of moves into the row, and of the row's chance in each state."""

    def moves(x):
        n = len(x[logits])
        T = x[matrix] if matrix else np.broadcast_to(np.asarray(transition, float), (n, *np.shape(transition)))
        return safe_log(T) + x[logits][:, None, :]

    return [logits, *([matrix] if matrix else [])], moves


def _products(k: int, over) -> tuple:
    """identity and compose of stretches seen from their end: F, the matrix of the first row, and R, the product of the others'.

    over: what sums up (log_sum_exp, or the largest). The sweep runs backward, so b lies before a.
    """
    eye = np.where(np.eye(k) > 0, 0.0, -np.inf)

    def product(a, b):
        return over(a[:, :, :, None] + b[:, None], 2)

    def identity(n):
        return {"F": np.repeat(eye[None], n, 0), "R": np.repeat(eye[None], n, 0), "some": np.zeros(n)}

    def compose(a, b):
        both = product(b["R"], product(a["F"], a["R"]))
        only_a, only_b = b["some"] == 0, a["some"] == 0
        pick = lambda x, y, z: np.where(only_a[:, None, None], x, np.where(only_b[:, None, None], y, z))
        return {"F": pick(a["F"], b["F"], b["F"]), "R": pick(a["R"], b["R"], both), "some": np.maximum(a["some"], b["some"])}

    return identity, compose


def _largest(x: np.ndarray, axis: int) -> np.ndarray:
    return x.max(axis=axis)


def _ahead(k: int, moves, over, step) -> stretch.Recursion:
    """Backward over rows: the state has L, the matrix of the next row, and b, what follows that row; b is 0 at an end."""
    identity, compose = _products(k, over)

    def element(x, fresh):
        F = moves(x)
        return {"F": F, "R": identity(len(F))["R"], "some": np.ones(len(F))}

    def start(e, none):
        rest = over(e["R"], 2)
        return {"L": e["F"], "b": rest - rest.max(axis=1, keepdims=True)}

    def whole(s, x, fresh):
        after = over(s["L"] + s["b"][:, None, :], 2)
        after = np.where(fresh[:, None], 0.0, after - after.max(axis=1, keepdims=True))
        return {"L": moves(x), "b": after}, step(s, x, fresh, after)

    return stretch.Recursion(identity, element, compose, start, whole)


def blocks_posterior(blocks: stretch.Blocks, transition: np.ndarray | None, prior: np.ndarray, logits: str = "ll", matrix: str | None = None, keep=(), before: bool = False) -> stretch.Blocks:
    """The blocks with keep, logits, matrix, p, pred, lz, first (as of `forward`) and sp, pair, last (as of `backward`).

    Forward, matrices of K x K moves compose by sums of chances; backward, what follows a row does.
    A series is as many tasks as blocks both ways.
    """
    k, base = len(prior), safe_log(np.asarray(prior, float))
    inputs, moves = _chain_inputs(transition, logits, matrix)
    eye = np.where(np.eye(k) > 0, 0.0, -np.inf)

    def identity(n):
        return {"E": np.repeat(eye[None], n, 0)}

    def element(x, fresh):
        return {"E": np.where(fresh[:, None, None], eye + x[logits][:, None, :], moves(x))}

    def compose(a, b):
        return {"E": log_sum_exp(a["E"][:, :, :, None] + b["E"][:, None], 2)}

    def start(e, none):
        reached = log_sum_exp(base[None, :, None] + e["E"], 1)
        return {"p": softmax(np.maximum(reached, -1e300))}

    def step(s, x, fresh):
        moved = np.einsum("si,sij->sj", s["p"], x[matrix]) if matrix else s["p"] @ np.asarray(transition)
        pred = np.where(fresh[:, None], np.asarray(prior, float)[None], moved)
        joint = np.log(np.maximum(pred, 1e-30)) + x[logits]
        z = log_sum_exp(joint, -1)
        p = np.exp(joint - z[:, None])
        return {"p": p}, {"p": p, "pred": pred, "lz": z, "was": np.where(fresh[:, None], 0.0, s["p"])}

    kept = [*keep, *inputs]
    into = {"p": 1, "pred": 1, "lz": 0, "first": 0} | ({"was": 1} if before else {})
    got = stretch.sweep(blocks, stretch.Recursion(identity, element, compose, start, step), inputs, into, kept)
    got = got.written() if got.span > 1 else got

    def back(s, x, fresh, after):
        raw = safe_log(x["p"])[:, :, None] + np.where(fresh[:, None, None], 0.0, s["L"] + s["b"][:, None, :])
        top = raw.max(axis=(1, 2), keepdims=True)
        pair = np.exp(raw - np.where(np.isfinite(top), top, 0))
        total = pair.sum(axis=(1, 2), keepdims=True)
        pair = np.where(total > 0, pair / np.where(total > 0, total, 1), 0)
        end = fresh[:, None]
        sp = np.where(end, x["p"], pair.sum(axis=2))
        out = {"sp": sp, "pair": np.where(end[..., None], 0.0, pair), "last": fresh.astype(float)}
        if before:
            T = x[matrix] if matrix else np.asarray(transition, float)
            out["into"] = x["was"][:, :, None] * T * (sp / np.maximum(x["pred"], 1e-300))[:, None, :]
        return out

    more = ["was", "pred"] if before else []
    into = {"sp": 1, "pair": 2, "last": 0} | ({"into": 2} if before else {})
    return stretch.sweep(got, _ahead(k, moves, log_sum_exp, back), ["p", *inputs, *more], into, [*kept, "p", "pred", "lz", "first"], backward=True)


def posterior(rows: DataFrame, transition: np.ndarray | None, prior: np.ndarray, logits: str = "ll", matrix: str | None = None, key: str = "series_id", order: str = "t", keep=(), block: int = stretch.BLOCK, before: bool = False) -> DataFrame:
    """(key, order, and what blocks_posterior adds): filter and smoother of a chain of any number of states, rows shuffled once.

    With `before` also into, the joint of the row before and this one, zeros at first rows.
    """
    packed = stretch.pack(rows, key, order, [logits, *([matrix] if matrix else []), *keep], block)
    return blocks_posterior(packed, transition, prior, logits, matrix, keep, before).rows()


def viterbi(rows: DataFrame, transition: np.ndarray | None, prior: np.ndarray, logits: str = "ll", key: str = "series_id", order: str = "t", matrix: str | None = None, block: int = stretch.BLOCK) -> DataFrame:
    """(key, order, state): the most likely path; ties go to the lower state. Series are cut into blocks.

    Backward, the best score of what follows each state composes by the largest of sums, and each row learns where each
    of its states leads. Forward, these maps of states to states compose, so that a block knows where its path begins.
    """
    k, base = len(prior), safe_log(np.asarray(prior, float))
    inputs, moves = _chain_inputs(transition, logits, matrix)

    def lead(s, x, fresh, after):
        to = (s["L"] + s["b"][:, None, :]).argmax(axis=2)
        return {"score": after, "to": np.where(fresh[:, None], 0, to).astype(float)}

    packed = stretch.pack(rows, key, order, inputs, block)
    scored = stretch.sweep(packed, _ahead(k, moves, _largest, lead), inputs, {"score": 1, "to": 1}, [logits], backward=True)
    scored = scored.written() if scored.span > 1 else scored

    def begin(x):
        return (base + x[logits] + x["score"]).argmax(axis=1)

    def element(x, fresh):
        to = x["to"]
        return {"to": np.where(fresh[:, None], np.take_along_axis(to, begin(x)[:, None], 1), to)}

    def trace(s, x, fresh):
        z = np.where(fresh, begin(x), s["z"].astype(np.int64))
        return {"z": np.take_along_axis(x["to"], z[:, None], 1)[:, 0]}, {"state": z.astype(float)}

    maps = stretch.Recursion(
        lambda n: {"to": np.repeat(np.arange(k, dtype=float)[None], n, 0)}, element,
        lambda a, b: {"to": np.take_along_axis(b["to"], a["to"].astype(np.int64), 1)}, lambda e, none: {"z": e["to"][:, 0].copy()}, trace,
    )
    got = stretch.sweep(scored, maps, [logits, "score", "to"], {"state": 0}).rows()
    return got.withColumn("state", got["state"].cast("int"))


# ---------------------------------------------------------------- reward contingencies


@dataclass(frozen=True)
class Contingency:
    """States with a reward chance (and a value) for each option; transitions from logits whose last column is 0.

    weights: effect of transition covariates on the logits, (covariates, states, states - 1). shifts: effect of
    features of the choice on the options' values, (options, features) for all states or one such for each.
    """

    reward: np.ndarray
    value: np.ndarray
    logits: np.ndarray
    prior: np.ndarray
    temperature: float = 1.0
    weights: np.ndarray | None = None
    shifts: np.ndarray | None = None

    def transitions(self, covariates: np.ndarray | None = None) -> np.ndarray:
        base = self.logits if covariates is None or self.weights is None else self.logits + np.einsum("sd,dij->sij", covariates, self.weights)
        return centred_softmax(base)


def centred_softmax(free: np.ndarray) -> np.ndarray:
    """Softmax with a fixed last logit of 0."""
    return softmax(np.concatenate([free, np.zeros((*free.shape[:-1], 1))], axis=-1))


def centred_softmax_inverse(p: np.ndarray) -> np.ndarray:
    p = np.maximum(p, 1e-10)
    return np.log(p[..., :-1]) - np.log(p[..., -1:])


def transition_prior(concentration: float, stickiness: float, n: int) -> np.ndarray:
    return np.full((n, n), concentration) + stickiness * np.eye(n)


def trial_log_likelihood(choice: np.ndarray, reward: np.ndarray, c: Contingency, features: np.ndarray | None = None) -> np.ndarray:
    """(rows, states): log chance of the choice under each state's values, shifted by features, and of its reward."""
    k = choice.astype(np.int64)
    if features is None or c.shifts is None:
        chosen = np.log(softmax(c.temperature * c.value))[:, k].T
    else:
        shifts = np.broadcast_to(c.shifts, (len(c.value), *np.shape(c.shifts)[-2:]))
        logits = c.temperature * c.value[None] + np.einsum("nf,skf->nsk", features, shifts)
        chosen = np.log(softmax(logits))[np.arange(len(k)), :, k]
    p = np.clip(c.reward[:, k].T, 1e-10, 1 - 1e-10)
    return chosen + np.where(reward[:, None] > 0, np.log(p), np.log1p(-p))


def contingency_steps(c: Contingency, covariates: str | None = None, features: str | None = None):
    """start and step of the forward pass over trials."""
    n = len(c.prior)

    def start(m):
        return {"p": np.repeat(np.asarray(c.prior, float)[None], m, 0)}

    def step(s, x, fresh):
        T = c.transitions(x[covariates] if covariates else None)
        T = np.broadcast_to(T, (len(fresh), n, n))
        pred = np.where(fresh[:, None], s["p"], np.einsum("si,sij->sj", s["p"], T))
        joint = np.log(np.maximum(pred, 1e-30)) + trial_log_likelihood(x["choice"], x["reward"], c, x[features] if features else None)
        z = log_sum_exp(joint, -1)
        p = np.exp(joint - z[:, None])
        return {"p": p}, {"p": p, "pred": pred, "lz": z, "ll": z, "moves": T}

    return start, step


def contingency_posterior(trials: DataFrame, c: Contingency, covariates: str | None = None, key: str = "series_id", order: str = "t", features: str | None = None, block: int = stretch.BLOCK, beliefs_before: bool = False) -> DataFrame:
    """(key, order, choice, reward, covariates, features, lz, first, sp, pair, last): smoothed belief of every trial.

    With beliefs_before also moves, the chances of moves into the row, and into, the joint with the row before.
    """
    packed = contingency_trials(trials, covariates, key, order, features, block)
    return contingency_blocks(packed, c, covariates, features, beliefs_before).rows()


def contingency_trials(trials: DataFrame, covariates: str | None = None, key: str = "series_id", order: str = "t", features: str | None = None, block: int = stretch.BLOCK) -> stretch.Blocks:
    """Trials in blocks, with no more than their chances are made of."""
    return stretch.pack(trials, key, order, ["choice", "reward", *[x for x in (covariates, features) if x]], block)


def contingency_blocks(packed: stretch.Blocks, c: Contingency, covariates: str | None = None, features: str | None = None, beliefs_before: bool = False) -> stretch.Blocks:
    """As contingency_posterior, over packed trials: the chances of a slice of blocks are made where it is smoothed."""
    given = ["choice", "reward", *[x for x in (covariates, features) if x]]

    def make(x):
        n = len(x["choice"])
        T = np.broadcast_to(c.transitions(x[covariates] if covariates else None), (n, *[len(c.prior)] * 2))
        return {"log_chance": trial_log_likelihood(x["choice"], x["reward"], c, x[features] if features else None), "moves": T}

    blocks = stretch.derived(packed, given, {"log_chance": 1, "moves": 2}, make)
    return blocks_posterior(blocks, None, c.prior, "log_chance", "moves", given, beliefs_before)


def contingency_score(trials: DataFrame | stretch.Blocks, c: Contingency, covariates: str | None = None, key: str = "series_id", order: str = "t", features: str | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Log evidence and its gradient in reward, value, temperature, shifts, logits, weights and prior.

    By Fisher's identity: the expected gradient of the log chance of choices, rewards and moves under the smoothed
    belief, so one filter and one smoother give all of it, however many parameters there are. trials: rows, or packed.
    """
    n_options, k = c.reward.shape[1], len(c.prior)
    packed = trials if isinstance(trials, stretch.Blocks) else contingency_trials(trials, covariates, key, order, features)
    rows = contingency_blocks(packed, c, covariates, features, beliefs_before=True)
    shifted = features is not None and c.shifts is not None

    def make(x):
        n = len(x["choice"])
        chosen = np.eye(n_options)[x["choice"].astype(np.int64)]
        logits = np.broadcast_to(c.temperature * c.value[None], (n, k, n_options))
        if shifted:
            logits = logits + np.einsum("nf,skf->nsk", x[features], np.broadcast_to(c.shifts, (k, *np.shape(c.shifts)[-2:])))
        off = x["sp"][:, :, None] * (chosen[:, None, :] - softmax(logits))
        won = x["reward"] > 0
        p = np.clip(c.reward, 1e-10, 1 - 1e-10)
        out = {
            "reward": np.einsum("ns,no->so", x["sp"] * won[:, None], chosen) / p - np.einsum("ns,no->so", x["sp"] * ~won[:, None], chosen) / (1 - p),
            "value": c.temperature * off.sum(0), "temperature": np.array([(off * c.value).sum()]),
            "prior": (x["sp"][x["first"] > 0] / np.maximum(c.prior, 1e-300)).sum(0), "ll": np.array(x["lz"].sum()),
        }
        if shifted:
            each = np.einsum("nsk,nf->skf", off, x[features])
            out["shifts"] = each if np.ndim(c.shifts) == 3 else each.sum(0)
        into = x["into"]  # joint of the row before and this one, zeros at first rows
        moved = (into - into.sum(2, keepdims=True) * x["moves"])[..., :-1]
        out["logits"] = moved.sum(0)
        if covariates and c.weights is not None:
            out["weights"] = np.einsum("nd,nij->dij", x[covariates], moved)
        return out

    given = [v for v in (covariates, features) if v]
    s = stretch.totals(rows, ["choice", "reward", *given, "lz", "sp", "first", "into", "moves"], make)
    return float(s.pop("ll")), s


def fit_contingency_gradient(trials: DataFrame, c: Contingency, covariates: str | None = None, steps: int = 50, rate: float = 1e-2, learn: tuple[str, ...] = ("reward", "logits", "weights", "prior", "temperature"), key: str = "series_id", order: str = "t", features: str | None = None) -> Fit:
    """Adam over any of the parameters by the evidence, shifts and value among them; weights only with covariates, shifts with features."""
    spec = {"reward": UNIT_INTERVAL, "value": UNCONSTRAINED, "logits": UNCONSTRAINED, "weights": UNCONSTRAINED, "shifts": UNCONSTRAINED, "prior": STOCHASTIC_ROW, "temperature": POSITIVE}
    has = {"weights": covariates and c.weights is not None, "shifts": features and c.shifts is not None}
    learn = tuple(x for x in learn if has.get(x, True))
    at = {x: np.atleast_1d(np.asarray(getattr(c, x), float)) for x in learn}
    put = lambda p: replace(c, **{x: float(v[0]) if x == "temperature" else v for x, v in p.items()})

    packed = contingency_trials(trials, covariates, key, order, features).written()

    def value(p):
        ll, g = contingency_score(packed, put(p), covariates, key, order, features)
        return ll, {x: g[x] for x in learn}

    got = by_gradient(at, {x: spec[x] for x in learn}, None, trials.count(), steps, rate, score=value)
    return Fit(put(got.params), got.log_likelihoods, got.converged)


def fit_contingency(trials: DataFrame, c: Contingency, max_iter: int = 20, tolerance: float = 1e-4, concentration: float = 1.0, stickiness: float = 0.0, ridge: float = 1e-5, key: str = "series_id", order: str = "t", covariates: str | None = None) -> Fit:
    """EM: reward chances by weighted counts, transition rows by the expected counts with a Dirichlet prior.

    With covariates, a row's logits and its weights are fitted together by quasi-Newton steps, whose values and
    gradients are summed over all steps in one job each; `ridge` holds the weights.
    """
    k, n_options = c.reward.shape
    moved = bool(covariates and c.weights is not None)
    packed = contingency_trials(trials, covariates if moved else None, key, order).written()

    def e_step(c):
        def make(x):
            chosen = np.eye(n_options)[x["choice"].astype(np.int64)]
            first = x["first"] > 0
            return {
                "count": np.einsum("ns,no->so", x["sp"], chosen), "won": np.einsum("ns,no,n->so", x["sp"], chosen, x["reward"]),
                "pair": x["pair"].sum(0), "first": x["sp"][first].sum(0), "n": np.array([len(first), first.sum()], float), "ll": np.array(x["lz"].sum()),
            }

        blocks = contingency_blocks(packed, c, covariates if moved else None)
        got = stretch.totals(blocks, ["first", "choice", "reward", "lz", "sp", "pair"], make)
        return float(got["ll"]), got | ({"rows": blocks.rows()} if moved else {})

    def refit(c, rows):
        """Logits and weights: Newton steps of a multinomial regression of the expected moves on the next trial's covariates."""
        from pyspark.sql import functions as F
        from pyspark.sql.window import Window

        ahead = F.lead(covariates).over(Window.partitionBy(key).orderBy(order))
        moves = reused(rows.select(ahead.alias("__u"), "pair").filter("__u IS NOT NULL"))
        d = c.weights.shape[0]
        logits, weights = c.logits.copy(), c.weights.copy()
        for _ in range(8):
            def make(x, logits=logits, weights=weights):
                v = np.concatenate([np.ones((len(x["__u"]), 1)), x["__u"]], 1)
                p = centred_softmax(logits + np.einsum("sd,dij->sij", x["__u"], weights))
                row = x["pair"].sum(2)
                g = np.einsum("sij,sd->ijd", (x["pair"] - row[..., None] * p)[..., :-1], v)
                q = p[..., :-1]
                h = np.einsum("si,sij,jk,sd,se->ijdke", row, q, np.eye(k - 1), v, v) - np.einsum("si,sij,sik,sd,se->ijdke", row, q, q, v, v)
                return {"g": g, "h": h}

            s = totals(moves, ["__u", "pair"], make)
            for i in range(k):
                size = (k - 1) * (d + 1)
                hold = np.tile([0.0, *[ridge] * d], k - 1)
                now = np.concatenate([logits[i][:, None], weights[:, i].T], 1)
                pull = s["g"][i].ravel() - hold * now.ravel()
                step = np.linalg.solve(s["h"][i].reshape(size, size) + np.diag(hold + 1e-9), pull).reshape(k - 1, d + 1)
                step = step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
                logits[i], weights[:, i] = now[:, 0] + step[:, 0], (now[:, 1:] + step[:, 1:]).T
        return logits, weights

    def m_step(c, s):
        reward = np.where(s["count"] > 0, s["won"] / np.where(s["count"] > 0, s["count"], 1), c.reward)
        alpha = np.maximum(transition_prior(concentration, stickiness, k), 1.0)
        steps = max(s["n"][0] - s["n"][1], 1.0)

        def row_loss(free, i):
            lp = np.log(np.maximum(centred_softmax(free), 1e-300))
            return -(s["pair"][i] * lp).sum() / steps - ((alpha[i] - 1) * lp).sum() / steps

        new = replace(c, reward=np.clip(reward, 1e-6, 1 - 1e-6), prior=s["first"] / max(s["n"][1], 1))
        if moved:
            logits, weights = refit(c, s["rows"])
            return replace(new, logits=logits, weights=weights)
        return replace(new, logits=np.stack([bfgs(lambda f, i=i: row_loss(f, i), c.logits[i]) for i in range(k)]))

    return em(c, e_step, m_step, max_iter, tolerance)
