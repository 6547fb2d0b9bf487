"""Parameters of coupled oscillators: transition and noise matrices, their projections, and ready switching models.

An oscillator is two numbers; a 2 x 2 block of a matrix says how one turns another.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from driftline.operators.matrices import block_diagonal, project_psd, shift_to_psd
from driftline.operators.switching import GaussianObs, Switching, gaussian


def rotation(angle) -> np.ndarray:
    a = np.asarray(angle, float)
    c, s = np.cos(a), np.sin(a)
    return np.stack([np.stack([c, -s], -1), np.stack([s, c], -1)], -2)


def to_blocks(m: np.ndarray) -> np.ndarray:
    """(2n, 2n) to (n, n, 2, 2)."""
    n = len(m) // 2
    return m.reshape(n, 2, n, 2).swapaxes(1, 2)


def from_blocks(b: np.ndarray) -> np.ndarray:
    n = len(b)
    return b.swapaxes(1, 2).reshape(2 * n, 2 * n)


def common_transition(freqs, damping, fs: float = 1.0) -> np.ndarray:
    """Damped rotations side by side; damping is held within 0 and 1."""
    turn = rotation(2 * np.pi * np.asarray(freqs) / fs)
    return block_diagonal(np.clip(np.asarray(damping, float), 0, 1)[:, None, None] * turn)


def common_noise(variance) -> np.ndarray:
    return np.diag(np.repeat(np.asarray(variance, float), 2))


def upper_pairs(phase: np.ndarray, strength: np.ndarray, tolerance: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Pair parameters given in either triangle, as their upper one; conflicting values are an error."""
    n = len(strength)
    up, low = np.triu_indices(n, 1), np.tril_indices(n, -1)
    p, s = np.zeros((n, n)), np.zeros((n, n))
    s[up], p[up] = strength[up], phase[up]
    for i, j in zip(*low):
        if abs(strength[i, j]) > tolerance:
            if abs(s[j, i]) > tolerance and (abs(s[j, i] - strength[i, j]) > tolerance or abs(np.angle(np.exp(1j * (p[j, i] + phase[i, j])))) > tolerance):
                raise ValueError("the two triangles disagree")
            s[j, i], p[j, i] = strength[i, j], -phase[i, j]
    return p, s


def correlated_noise(variance, phase, strength) -> np.ndarray:
    """Noise of oscillators that share some, turned by a phase: symmetric, upper blocks mirrored."""
    phase, strength = upper_pairs(np.asarray(phase, float), np.asarray(strength, float))
    n = len(variance)
    blocks = np.zeros((n, n, 2, 2))
    for i in range(n):
        blocks[i, i] = variance[i] * np.eye(2)
        for j in range(i + 1, n):
            blocks[i, j] = strength[i, j] * rotation(phase[i, j])
            blocks[j, i] = blocks[i, j].T
    return from_blocks(blocks)


def directed_transition(freqs, damping, strength, phase, fs: float = 1.0) -> np.ndarray:
    """Own rotations less what comes in, and turned influence of others."""
    n, strength = len(freqs), np.asarray(strength, float) * (1 - np.eye(len(freqs)))
    blocks = strength[..., None, None] * rotation(phase)
    own = np.asarray(damping)[:, None, None] * rotation(2 * np.pi * np.asarray(freqs) / fs)
    for i in range(n):
        blocks[i, i] = own[i] - strength[i].sum() * np.eye(2)
    return from_blocks(blocks)


def stability_scale(freqs, damping, strength, fs: float, most: float = 0.99) -> float:
    """At most 1: what keeps every block row's norm, and so the spectral radius, below `most`."""
    s = np.asarray(strength, float) * (1 - np.eye(len(freqs)))
    a, total = np.asarray(damping, float), s.sum(1)
    own = np.sqrt(np.maximum(a**2 + total**2 - 2 * a * total * np.cos(2 * np.pi * np.asarray(freqs) / fs), 0))
    return float(min(1.0, most / max((own + np.abs(s).sum(1)).max(), 1e-300)))


def noise_measurement(n_sources: int) -> np.ndarray:
    """Each source sees the first number of its oscillator."""
    return np.kron(np.eye(n_sources), [[1.0, 0.0]])


def directed_measurement(n_sources: int) -> np.ndarray:
    return np.kron(np.eye(n_sources), [[1.0, 1.0]]) / np.sqrt(2)


def closest_rotation(m: np.ndarray) -> np.ndarray:
    u, _, v = np.linalg.svd(m)
    fix = np.eye(2)
    fix[1, 1] = np.sign(np.linalg.det(u @ v))
    return u @ fix @ v


def scale_and_angle(block: np.ndarray) -> tuple[float, float]:
    """Of the nearest scaled rotation."""
    a, b = (block[0, 0] + block[1, 1]) / 2, (block[1, 0] - block[0, 1]) / 2
    return float(np.hypot(a, b)), float(np.arctan2(b, a))


def scaled_rotation(block: np.ndarray) -> np.ndarray:
    r, angle = scale_and_angle(block)
    return r * rotation(angle)


def project_blocks(m: np.ndarray) -> np.ndarray:
    """Every 2 x 2 block to its nearest scaled rotation."""
    b = to_blocks(m)
    return from_blocks(np.array([[scaled_rotation(x) for x in row] for row in b]))


def project_noise(q: np.ndarray, least: float = 1e-8) -> np.ndarray:
    """To the family of correlated noise: symmetric under a quarter turn of all oscillators, then lifted until positive."""
    j = np.kron(np.eye(len(q) // 2), [[0.0, -1.0], [1.0, 0.0]])
    return shift_to_psd((q + j @ q @ j.T) / 2, least)


def noise_parameters(q: np.ndarray) -> dict[str, np.ndarray]:
    """variance, phase and strength that project_noise(q) is made of."""
    b = to_blocks(q)
    n = len(b)
    phase, strength = np.zeros((n, n)), np.zeros((n, n))
    for i in range(n):
        for k in range(i + 1, n):
            strength[i, k], phase[i, k] = scale_and_angle(b[i, k])
    return {"variance": np.array([np.trace(b[i, i]) / 2 for i in range(n)]), "phase": phase, "strength": strength}


def directed_parameters(a: np.ndarray, fs: float) -> dict[str, np.ndarray]:
    """freqs, damping, strength and phase that a directed transition is made of."""
    b = to_blocks(a)
    n = len(b)
    strength, phase = np.zeros((n, n)), np.zeros((n, n))
    for i in range(n):
        for k in range(n):
            if i != k:
                strength[i, k], phase[i, k] = scale_and_angle(b[i, k])
    own = [scale_and_angle(b[i, i] + strength[i].sum() * np.eye(2)) for i in range(n)]
    return {"damping": np.array([o[0] for o in own]), "freqs": np.array([o[1] for o in own]) * fs / (2 * np.pi), "strength": strength, "phase": phase}


def influence(H: np.ndarray) -> np.ndarray:
    """(sources, oscillators): norm of each 1 x 2 block."""
    return np.linalg.norm(H.reshape(len(H), -1, 2), axis=-1)


def phase_difference(H: np.ndarray, one: int, two: int, oscillator: int) -> float:
    b = H.reshape(len(H), -1, 2)[:, oscillator]
    at = np.arctan2(b[:, 1], b[:, 0])
    return float(np.angle(np.exp(1j * (at[one] - at[two]))))


def sticky_chain(stay, n: int) -> np.ndarray:
    """Stays with the given chance, and moves to all others evenly."""
    stay = np.broadcast_to(np.asarray(stay, float), (n,))
    if n == 1:
        return np.ones((1, 1))
    return np.diag(stay) + (1 - stay)[:, None] * (1 - np.eye(n)) / (n - 1)


def _switching(A, Q, H, R, stay) -> Switching:
    K, d = len(A), A.shape[-1]
    return Switching(A, Q, np.zeros((K, d)), np.array([np.eye(d)] * K), sticky_chain(stay, K), np.full(K, 1 / K), gaussian, GaussianObs(H, R))


def common_model(freqs, damping, variance, H, r, stay=0.98, fs: float = 1.0) -> Switching:
    """States differ in how the sources see the oscillators (H: states, sources, 2n)."""
    K, n = H.shape[:2]
    A, Q = common_transition(freqs, damping, fs), common_noise(variance)
    return _switching(np.array([A] * K), np.array([Q] * K), H, np.array([r * np.eye(n)] * K), stay)


def correlated_model(freqs, damping, variance, phase, strength, r, stay=0.98, fs: float = 1.0) -> Switching:
    """States differ in the noise that oscillators share (variance, phase, strength: one for each state)."""
    K, n = len(variance), len(freqs)
    A, H = common_transition(freqs, damping, fs), noise_measurement(n)
    Q = np.array([project_psd(correlated_noise(variance[k], phase[k], strength[k])) for k in range(K)])
    return _switching(np.array([A] * K), Q, np.array([H] * K), np.array([r * np.eye(n)] * K), stay)


def directed_model(freqs, damping, variance, phase, strength, r, stay=0.98, fs: float = 1.0) -> Switching:
    """States differ in the influence of oscillators on one another (phase, strength: one for each state)."""
    K, n = len(strength), len(freqs)
    A = np.array([directed_transition(freqs, damping, np.asarray(strength[k]), phase[k], fs) for k in range(K)])
    A = np.array([a * stability_scale(freqs, damping, strength[k], fs) for k, a in enumerate(A)])
    return _switching(A, np.array([common_noise(variance)] * K), np.array([directed_measurement(n)] * K), np.array([r * np.eye(n)] * K), stay)


def project_common(model: Switching) -> Switching:
    return model


def project_correlated(model: Switching) -> Switching:
    from dataclasses import replace

    return replace(model, Q=np.array([project_noise(q) for q in model.Q]))


def project_directed(model: Switching) -> Switching:
    from dataclasses import replace

    from driftline.operators.matrices import stabilised

    return replace(model, A=stabilised(np.array([project_blocks(a) for a in model.A])))


def transition_objective(A: np.ndarray, gamma1: np.ndarray, beta: np.ndarray, Q: np.ndarray | None = None) -> float:
    """Quadratic form of the expected log likelihood in A, larger is better."""
    W = np.eye(len(A)) if Q is None else np.linalg.inv(Q)
    return float(np.trace(W @ (beta @ A.T)) - 0.5 * np.trace(W @ A @ gamma1 @ A.T))


def refit_directed(gamma1: np.ndarray, beta: np.ndarray, start: dict[str, np.ndarray], fs: float, Q: np.ndarray | None = None, most_damping: float = 0.995) -> dict[str, np.ndarray]:
    """Oscillator parameters by quasi-Newton descent on the sums of one state, instead of a free A; the result is stable."""
    from driftline.plans.fitting import bfgs

    n = len(start["freqs"])
    off = ~np.eye(n, dtype=bool)
    scale = max(np.abs(gamma1).max(), 1e-12)

    def unpack(x):
        s, p = np.zeros((n, n)), np.zeros((n, n))
        s[off], p[off] = x[2 * n : 2 * n + n * (n - 1)], x[2 * n + n * (n - 1) :]
        return {"damping": most_damping / (1 + np.exp(-x[:n])), "freqs": x[n : 2 * n], "strength": s, "phase": p}

    def matrix(p):
        return directed_transition(p["freqs"], p["damping"], p["strength"], p["phase"], fs)

    ratio = np.clip(start["damping"] / most_damping, 1e-6, 1 - 1e-6)
    x = np.concatenate([np.log(ratio / (1 - ratio)), start["freqs"], start["strength"][off], start["phase"][off]])
    got = unpack(bfgs(lambda x: -transition_objective(matrix(unpack(x)), gamma1 / scale, beta / scale, Q), x))
    shrink = stability_scale(got["freqs"], got["damping"], np.abs(got["strength"]), fs)
    return got | {"strength": got["strength"] * shrink, "damping": got["damping"] * shrink}


def couplings(A: np.ndarray) -> list[tuple[int, int, int, float]]:
    """Edge rows (state, i, j, c) of transitions (states, 2n, 2n), for the penalties."""
    return [(k, i, j, scale_and_angle(b[i, j])[0]) for k, a in enumerate(A) for b in [to_blocks(a)] for i in range(len(b)) for j in range(len(b))]


# ---------------------------------------------------------------- gradient fits


@dataclass(frozen=True)
class Penalty:
    """Weights of the pulls on couplings (states, n, n): edge by edge, by blocks of areas in each state, and by blocks over all states."""

    edge: float = 0.0
    area: float = 0.0
    shared: float = 0.0
    areas: tuple[int, ...] | None = None
    eps: float = 1e-8

    def __post_init__(self):
        if min(self.edge, self.area, self.shared) < 0 or self.eps <= 0:
            raise ValueError("weights of penalties are not negative, eps is positive")
        if (self.area or self.shared) and self.areas is None:
            raise ValueError("penalties of areas need the area of each oscillator")

    def of(self, strength: np.ndarray) -> float:
        s = np.asarray(strength, float) * (1 - np.eye(np.shape(strength)[-1]))
        norm = lambda q: np.sqrt(q + self.eps) - np.sqrt(self.eps)
        off = ~np.eye(s.shape[-1], dtype=bool)
        total = self.edge * norm(s[:, off] ** 2).sum()
        if self.areas is not None:
            who = (np.unique(self.areas)[:, None] == np.asarray(self.areas)).astype(float)
            blocks = np.einsum("ai,sij,bj->sab", who, s**2, who)
            some = np.einsum("ai,ij,bj->ab", who, off.astype(float), who) > 0
            total += self.area * norm(blocks[:, some]).sum() + self.shared * norm(blocks.sum(0)[some]).sum()
        return float(total)


def gradient_family(kind: str, fs: float = 1.0, penalty: Penalty | None = None):
    """spec, build and penalty for switching.fit_gradient: `common`, `correlated` or `directed` oscillators, by their own parameters.

    Parameters: freqs, damping, variance, H and r, stay (common); variance, phase and strength of each state (correlated,
    directed, whose variance is one for all). Whatever `at` holds of them is learned; the rest is passed to build in `fixed`.
    """
    from driftline.plans.fitting import POSITIVE, UNCONSTRAINED, UNIT_INTERVAL

    spec = {"freqs": POSITIVE, "damping": UNIT_INTERVAL, "variance": POSITIVE, "H": UNCONSTRAINED, "r": POSITIVE, "stay": UNIT_INTERVAL, "phase": UNCONSTRAINED, "strength": UNCONSTRAINED}
    make = {"common": common_model, "correlated": correlated_model, "directed": directed_model}[kind]

    def build(fixed: dict):
        one = lambda v: float(np.ravel(v)[0])
        return lambda p: make(fs=fs, **{c: one(v) if c in ("r", "stay") else v for c, v in (fixed | p).items()})

    pull = (lambda p: penalty.of(p["strength"])) if penalty else (lambda p: 0.0)
    return spec, build, pull


def with_spikes(model: Switching, baseline: np.ndarray, weights: np.ndarray, dt: float) -> Switching:
    """The model's oscillators seen by counts of units instead: baseline (units) and weights (units, 2n), for all states or one such for each."""
    from dataclasses import replace

    from driftline.operators.point_process import SpikeObs, spikes

    K, d = model.m0.shape
    weights = np.asarray(weights, float)
    baseline = np.broadcast_to(np.asarray(baseline, float), (K, weights.shape[-2]))
    return replace(model, observe=spikes, obs=SpikeObs(baseline, np.broadcast_to(weights, (K, *weights.shape[-2:])), dt))


def spike_family(kind: str, dt: float, fs: float = 1.0, penalty: Penalty | None = None):
    """spec, build and penalty for switching.fit_gradient of oscillators seen by counts of spikes: as `gradient_family`, with baseline and weights in place of H and r."""
    from driftline.plans.fitting import UNCONSTRAINED

    spec, _, pull = gradient_family(kind, fs, penalty)
    spec = {c: t for c, t in spec.items() if c not in ("H", "r")} | {"baseline": UNCONSTRAINED, "weights": UNCONSTRAINED}
    make = {"common": common_model, "correlated": correlated_model, "directed": directed_model}[kind]

    def build(fixed: dict):
        def model(p):
            v = dict(fixed | p)
            baseline, weights = v.pop("baseline"), np.asarray(v.pop("weights"), float)
            if "stay" in v:
                v["stay"] = float(np.ravel(v["stay"])[0])
            if kind == "common":  # what its sources would see; counts take their place
                K = weights.shape[0] if weights.ndim == 3 else np.shape(baseline)[0] if np.ndim(baseline) == 2 else 1
                v["H"] = np.zeros((K, 1, weights.shape[-1]))
            return with_spikes(make(fs=fs, r=1.0, **v), baseline, weights, dt)

        return model

    return spec, build, pull
