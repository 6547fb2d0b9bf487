"""Small dense algebra, batched over a leading axis of series."""

from __future__ import annotations

import numpy as np


def symmetric(a: np.ndarray) -> np.ndarray:
    return (a + np.swapaxes(a, -1, -2)) / 2


def transposed(a: np.ndarray) -> np.ndarray:
    return np.swapaxes(a, -1, -2)


def boosted(s: np.ndarray) -> np.ndarray:
    """With max(1e-9, 1e-12 times the largest diagonal entry) on the diagonal."""
    d = np.abs(np.diagonal(s, axis1=-2, axis2=-1)).max(axis=-1)
    return s + np.maximum(1e-9, 1e-12 * d)[..., None, None] * np.eye(s.shape[-1])


def psd_solve(s: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = boosted(s)
    return _solved_pairs(s, b) if s.shape[-1] == 2 and s.ndim > 2 else np.linalg.solve(s, b)


def _solved_pairs(s: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Systems of two unknowns, all at once: elimination from the larger entry of the first column."""
    turn = np.abs(s[..., 1, 0]) > np.abs(s[..., 0, 0])
    if turn.any():
        s, b = (np.where(turn[..., None, None], x[..., ::-1, :], x) for x in (s, b))
    pivot = s[..., 0, 0]
    if (pivot == 0).any():
        raise np.linalg.LinAlgError("Singular matrix")
    down = s[..., 1, 0] / pivot
    left = s[..., 1, 1] - down * s[..., 0, 1]
    if (left == 0).any():
        raise np.linalg.LinAlgError("Singular matrix")
    second = (b[..., 1, :] - down[..., None] * b[..., 0, :]) / left[..., None]
    first = (b[..., 0, :] - s[..., 0, 1, None] * second) / pivot[..., None]
    return np.stack([first, second], -2)


def vec_solve(s: np.ndarray, b: np.ndarray) -> np.ndarray:
    return psd_solve(s, b[..., None])[..., 0]


def log_det(s: np.ndarray) -> np.ndarray:
    return np.linalg.slogdet(boosted(s))[1]


def mv(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (a @ x[..., None])[..., 0]


def gaussian_log_density(x: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """ln N(x; 0, cov)."""
    return -0.5 * (x.shape[-1] * np.log(2 * np.pi) + log_det(cov) + (x * vec_solve(cov, x)).sum(axis=-1))


def project_psd(q: np.ndarray, least: float = 1e-8) -> np.ndarray:
    """Eigenvalues below `least` lifted to it."""
    w, v = np.linalg.eigh(symmetric(q))
    return symmetric((v * np.maximum(w, least)[..., None, :]) @ transposed(v))


def shift_to_psd(q: np.ndarray, least: float = 1e-8) -> np.ndarray:
    """Lifted by a multiple of the identity until no eigenvalue is below `least`."""
    w = np.linalg.eigvalsh(symmetric(q))[..., 0]
    return symmetric(q) + np.maximum(least - w, 0)[..., None, None] * np.eye(q.shape[-1])


def spectral_radius(a: np.ndarray) -> np.ndarray:
    return np.abs(np.linalg.eigvals(a)).max(axis=-1)


def stabilised(a: np.ndarray, most: float = 0.99) -> np.ndarray:
    """Scaled down to a spectral radius of at most `most`."""
    return a * np.minimum(1.0, most / np.maximum(spectral_radius(a), 1e-300))[..., None, None]


def block_diagonal(blocks: np.ndarray) -> np.ndarray:
    n, d, _ = blocks.shape
    out = np.zeros((n * d, n * d))
    for k in range(n):
        out[k * d : (k + 1) * d, k * d : (k + 1) * d] = blocks[k]
    return out


def softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    e = np.exp(x - np.max(x, axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def log_sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def safe_log(p: np.ndarray) -> np.ndarray:
    """ln with 0 to minus infinity."""
    with np.errstate(divide="ignore"):
        return np.log(p)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series after moving x above 7."""
    x = np.asarray(x, float)
    moved = sum(np.log(x + k) for k in range(7))
    z = x + 7
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - moved


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)
