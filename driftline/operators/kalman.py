"""Linear-Gaussian filters, smoothers and their maximisation step.

Series in one dimension run as scans in SQL, series in more dimensions as sweeps over blocks;
both cut a long series into blocks, and a smoother runs on the blocks of its filter. A fold, which
takes a whole series in one task, is there for steps that need it. The prior is that of the state
before the first observation, so that a prediction comes first.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.diagnostics import marks, of_moments
from driftline.operators.matrices import gaussian_log_density, mv, project_psd, psd_solve, symmetric, transposed
from driftline.plans import scan, stretch
from driftline.plans.fitting import PSD_MATRIX, UNCONSTRAINED, Fit, by_gradient, em
from driftline.plans.fold import fold

# ---------------------------------------------------------------- one dimension, in SQL


@dataclass(frozen=True)
class Scalar:
    """x_t = a x_{t-1} + N(0, q); y_t = h x_t + N(0, r); x_0 ~ N(m0, p0)."""

    a: float = 1.0
    q: float = 1.0
    h: float = 1.0
    r: float = 1.0
    m0: float = 0.0
    p0: float = 1.0


def _scalar_filter(k: Scalar) -> scan.Scan:
    s = k.h * k.q * k.h + k.r
    gain = k.q * k.h / s
    left = 1 - gain * k.h
    element = (
        f"named_struct('A', {left * k.a!r}D, 'b', {gain!r}D * x.y, 'C', {left * k.q!r}D, "
        f"'n', {k.a * k.h / s!r}D * x.y, 'J', {(k.a * k.h) ** 2 / s!r}D)"
    )
    d = "(1 + a.C * b.J)"
    compose = (
        f"named_struct('A', b.A * a.A / {d}, 'b', b.A * (a.b + a.C * b.n) / {d} + b.b, 'C', b.A * b.A * a.C / {d} + b.C, "
        f"'n', a.A * (b.n - b.J * a.b) / {d} + a.n, 'J', a.A * a.A * b.J / {d} + a.J)"
    )
    identity = "named_struct('A', 1D, 'b', 0D, 'C', 0D, 'n', 0D, 'J', 0D)"
    p0, m0 = f"{k.p0!r}D", f"{k.m0!r}D"
    start = (
        f"named_struct('m', e.A * ({m0} + {p0} * e.n) / (1 + {p0} * e.J) + e.b, "
        f"'v', e.A * e.A * {p0} / (1 + {p0} * e.J) + e.C, 'pm', 0D, 'pv', 0D)"
    )
    pm, pv = f"({k.a!r}D * s.m)", f"({k.a * k.a!r}D * s.v + {k.q!r}D)"
    total = f"({k.h * k.h!r}D * {pv} + {k.r!r}D)"
    step = (
        f"named_struct('m', {pm} + {pv} * {k.h!r}D / {total} * (x.y - {k.h!r}D * {pm}), "
        f"'v', {pv} * {k.r!r}D / {total}, 'pm', {pm}, 'pv', {pv})"
    )
    return scan.Scan(element, compose, identity, start, step)


def scalar_filter(series: DataFrame, model: Scalar, longest: int | None = None, key: str = "series_id", order: str = "t", block: int = scan.BLOCK) -> DataFrame:
    """(key, order, y, m, v, pm, pv, ll): filtered and predicted moments and the log density of each observation."""
    got = scan.run(series.select(key, order, "y"), key, order, _scalar_filter(model), longest, block)
    s = F.lit(model.h**2) * F.col("pv") + model.r
    off = F.col("y") - model.h * F.col("pm")
    return got.withColumn("ll", -0.5 * (F.ln(2 * np.pi * s) + off * off / s))


def scalar_smoother(filtered: DataFrame, model: Scalar, longest: int | None = None, key: str = "series_id", order: str = "t", block: int = scan.BLOCK) -> DataFrame:
    """(key, order, ..., sm, sv, cross): smoothed moments and the covariance with the next state, 0 at the last row.

    Every row but the last of a series is affine in the one after it: gain j, offset g, spread l.
    """
    own = F.max(order).over(_by(key))
    j = F.when(F.col(order) == F.col("__end"), 0.0).otherwise(model.a * F.col("v") / (model.a**2 * F.col("v") + model.q))
    ready = filtered.withColumn("__end", own).withColumn("j", j)
    ready = ready.withColumn("g", F.col("m") - F.col("j") * model.a * F.col("m")).withColumn(
        "l", F.col("v") - F.col("j") ** 2 * (model.a**2 * F.col("v") + model.q)
    )
    sweep = scan.Scan(
        element="named_struct('E', x.j, 'g', x.g, 'L', x.l)",
        compose="named_struct('E', b.E * a.E, 'g', b.E * a.g + b.g, 'L', b.E * b.E * a.L + b.L)",
        identity="named_struct('E', 1D, 'g', 0D, 'L', 0D)",
        start="named_struct('sm', e.g, 'sv', e.L, 'cross', 0D)",
        step="named_struct('sm', x.j * s.sm + x.g, 'sv', x.j * x.j * s.sv + x.l, 'cross', x.j * s.sv)",
    )
    return scan.run(ready.drop("__end"), key, order, sweep, longest, block, backward=True).drop("g", "l")


def _by(key: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(key)


# ---------------------------------------------------------------- more dimensions


@dataclass(frozen=True)
class Linear:
    """x_t = A x_{t-1} + N(0, Q); y_t = H x_t + N(0, R); x_0 ~ N(m0, P0)."""

    A: np.ndarray
    Q: np.ndarray
    H: np.ndarray
    R: np.ndarray
    m0: np.ndarray
    P0: np.ndarray

    def __post_init__(self):
        d, n = len(self.m0), len(self.R)
        if self.A.shape != (d, d) or self.Q.shape != (d, d) or self.P0.shape != (d, d) or self.H.shape != (n, d):
            raise ValueError("shapes of a linear model do not agree")
        if not all(np.isfinite(x).all() for x in (self.A, self.Q, self.H, self.R, self.m0, self.P0)):
            raise ValueError("a linear model needs finite numbers")


def measured(pm: np.ndarray, pv: np.ndarray, y: np.ndarray, H: np.ndarray, R: np.ndarray, offset=0.0):
    """Update of predicted moments by observations: mean, covariance (Joseph form) and log density."""
    s = symmetric(H @ pv @ transposed(H) + R)
    k = transposed(psd_solve(s, H @ pv))
    off = y - mv(H, pm) - offset
    left = np.eye(pm.shape[-1]) - k @ H
    return pm + mv(k, off), symmetric(left @ pv @ transposed(left) + k @ R @ transposed(k)), gaussian_log_density(off, s)


def gain_by_inversion_lemma(p: np.ndarray, H: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Kalman gain for diagonal noise r, by a system of the state's size instead of the observations'; p and r of one case, or of many in front."""
    weighed = transposed(H) / r[..., None, :]
    inner = np.eye(p.shape[-1]) + weighed @ H @ p
    return p @ np.linalg.solve(inner, weighed)


def filtered(series: DataFrame, model: Linear, key: str = "series_id", order: str = "t", y: str = "y") -> DataFrame:
    """(key, order, y, m, V, ll, first, diag): y holds one array of observations for each row, first marks that of each series."""
    d = len(model.m0)
    step = _filter_step(model, y)

    def start(n):
        return {"m": np.repeat(model.m0[None], n, 0).astype(float), "V": np.repeat(model.P0[None], n, 0).astype(float)}

    assert d == len(model.Q)
    return fold(series, key, order, start, step, FILTERED, [y], [y])


FILTERED = {"m": 1, "V": 2, "ll": 0, "first": 0, "diag": 0}
SMOOTHED = {"ms": 1, "Vs": 2, "cross": 2, "next_m": 1, "next_P": 2, "last": 0}


def _filter_step(model: Linear, y: str):
    def step(s, x, fresh):
        if not np.isfinite(x[y]).all():
            raise ValueError("observations must be finite")
        pm, pv = mv(model.A, s["m"]), symmetric(model.A @ s["V"] @ model.A.T + model.Q)
        m, P, ll = measured(pm, pv, x[y], model.H, model.R)
        return {"m": m, "V": P}, {"m": m, "V": P, "ll": ll, "diag": marks(**of_moments(m, P))}

    return step


def _smoother_step(A: np.ndarray, Q: np.ndarray):
    def step(s, x, fresh):
        m, P, c = rts(x["m"], x["V"], A, Q, (s["m"], s["V"]))
        last = fresh[:, None, None]
        m, P, c = np.where(last[..., 0], x["m"], m), np.where(last, x["V"], P), np.where(last, 0.0, c)
        return {"m": m, "V": P}, {"ms": m, "Vs": P, "cross": c, "next_m": s["m"], "next_P": s["V"], "last": fresh.astype(float)}

    return step


def _filter_recursion(k: Linear, y: str) -> stretch.Recursion:
    """Elements (A, b, C, eta, J): the state given the one before the stretch, and what its observations say of that one."""
    d = len(k.m0)
    eye = np.eye(d)
    s = symmetric(k.H @ k.Q @ k.H.T + k.R)
    gain = psd_solve(s, k.H @ k.Q).T
    seen = psd_solve(s, k.H @ k.A).T
    A, C, J = (eye - gain @ k.H) @ k.A, symmetric((eye - gain @ k.H) @ k.Q), symmetric(seen @ k.H @ k.A)

    def identity(n):
        zero = np.zeros((n, d, d))
        return {"A": zero + eye, "b": np.zeros((n, d)), "C": zero.copy(), "n": np.zeros((n, d)), "J": zero.copy()}

    def element(x, fresh):
        n = len(fresh)
        many = lambda a: np.repeat(a[None], n, 0)
        return {"A": many(A), "b": x[y] @ gain.T, "C": many(C), "n": x[y] @ seen.T, "J": many(J)}

    def compose(a, b):
        down = b["A"] @ np.linalg.inv(eye + a["C"] @ b["J"])
        up = transposed(a["A"]) @ np.linalg.inv(eye + b["J"] @ a["C"])
        return {
            "A": down @ a["A"],
            "b": mv(down, a["b"] + mv(a["C"], b["n"])) + b["b"],
            "C": symmetric(down @ a["C"] @ transposed(b["A"]) + b["C"]),
            "n": mv(up, b["n"] - mv(b["J"], a["b"])) + a["n"],
            "J": symmetric(up @ b["J"] @ a["A"] + a["J"]),
        }

    def start(e, none):
        n = len(none)
        zero = np.zeros((n, d, d))
        prior = {"A": zero, "b": np.repeat(k.m0[None], n, 0).astype(float), "C": zero + k.P0, "n": np.zeros((n, d)), "J": zero}
        got = compose(prior, e)
        return {"m": got["b"], "V": got["C"]}

    return stretch.Recursion(identity, element, compose, start, _filter_step(k, y))


def _smoother_recursion(A: np.ndarray, Q: np.ndarray) -> stretch.Recursion:
    """Elements (E, g, L): the state as E times the one after the stretch, plus g, with spread L; a last row has no E."""
    d = len(A)

    def identity(n):
        zero = np.zeros((n, d, d))
        return {"E": zero + np.eye(d), "g": np.zeros((n, d)), "L": zero.copy()}

    def element(x, fresh):
        ahead = symmetric(A @ x["V"] @ A.T + Q)
        E = np.where(fresh[:, None, None], 0.0, transposed(psd_solve(ahead, A @ x["V"])))
        return {"E": E, "g": x["m"] - mv(E, mv(A, x["m"])), "L": symmetric(x["V"] - E @ ahead @ transposed(E))}

    def compose(a, b):
        return {"E": b["E"] @ a["E"], "g": mv(b["E"], a["g"]) + b["g"], "L": symmetric(b["E"] @ a["L"] @ transposed(b["E"]) + b["L"])}

    def start(e, none):
        return {"m": e["g"].copy(), "V": e["L"].copy()}

    return stretch.Recursion(identity, element, compose, start, _smoother_step(A, Q))


def blocks_filtered(blocks: stretch.Blocks, model: Linear, y: str = "y", keep=()) -> stretch.Blocks:
    """As `filtered`, over packed blocks: a series of any length is as many tasks as blocks."""
    return stretch.sweep(blocks, _filter_recursion(model, y), [y], FILTERED, [y, *keep])


def blocks_smoothed(got: stretch.Blocks, A: np.ndarray, Q: np.ndarray, keep=("y", "ll", "first")) -> stretch.Blocks:
    """As `smoothed`, over filtered blocks, which several blocks of a series have to be written for."""
    got = got.written() if got.span > 1 else got
    return stretch.sweep(got, _smoother_recursion(A, Q), ["m", "V"], SMOOTHED, [*keep, "m", "V"], backward=True)


def path(series: DataFrame, model: Linear, key: str = "series_id", order: str = "t", y: str = "y", block: int = stretch.BLOCK, keep=()) -> DataFrame:
    """(key, order, y, keep, ll, first, m, V, ms, Vs, cross, next_m, next_P, last): filter and smoother, rows shuffled once.

    Orders are whole numbers, beginning anywhere, with gaps or without; a step is from one row to the next.
    """
    return blocks_path(series, model, key, order, y, block, keep).rows()


def blocks_path(series: DataFrame, model: Linear, key: str = "series_id", order: str = "t", y: str = "y", block: int = stretch.BLOCK, keep=()) -> stretch.Blocks:
    """As `path`, in blocks; sums over them run in the tasks that smooth."""
    blocks = stretch.pack(series, key, order, [y, *keep], block)
    return blocks_smoothed(blocks_filtered(blocks, model, y, keep), model.A, model.Q, [y, *keep, "ll", "first"])


def rts(m, P, A, Q, s):
    """One step backward from s (mean, covariance of the next state): mean, covariance, covariance with the next state."""
    ahead = symmetric(A @ P @ transposed(A) + Q)
    j = transposed(psd_solve(ahead, A @ P))
    return m + mv(j, s[0] - mv(A, m)), symmetric(P + j @ (s[1] - ahead) @ transposed(j)), j @ s[1]


def smoothed(filtered_rows: DataFrame, A: np.ndarray, Q: np.ndarray, key: str = "series_id", order: str = "t", keep=("y", "ll")) -> DataFrame:
    """(key, order, keep, ms, Ps, cross, next_m, next_P): cross is the covariance with the next state, zeros at the last row."""
    d = len(A)

    def start(n):
        return {"m": np.zeros((n, d)), "V": np.zeros((n, d, d))}

    return fold(filtered_rows, key, order, start, _smoother_step(A, Q), SMOOTHED, ["m", "V"], keep, backward=True)


def statistics(rows: DataFrame | stretch.Blocks, model, y: str = "y") -> dict[str, np.ndarray]:
    """Sums of smoothed moments: gamma and gamma2 over all rows, gamma1 over the states before them, beta over both, delta, alpha, counts.

    The state before a series' first row, which the prior is of, is smoothed too, by one more step back; so the
    first transition counts, and m0 and P0 are sums of that state's moments. model: its A, Q, m0, P0 are those of rows.
    """

    def make(x):
        ms, Ps, go, first = x["ms"], x["Vs"], x["last"] == 0, x["first"] > 0
        outer = Ps + ms[:, :, None] * ms[:, None, :]
        m0, P0, c0 = rts(model.m0, model.P0, model.A, model.Q, (ms[first], Ps[first]))
        began = P0 + m0[:, :, None] * m0[:, None, :]
        beta = transposed(x["cross"][go]) + x["next_m"][go][:, :, None] * ms[go][:, None, :]
        return {
            "gamma": outer.sum(0), "gamma1": outer[go].sum(0) + began.sum(0), "gamma2": outer.sum(0),
            "beta": beta.sum(0) + (transposed(c0) + ms[first][:, :, None] * m0[:, None, :]).sum(0),
            "delta": np.einsum("ni,nj->ij", x[y], ms), "alpha": np.einsum("ni,nj->ij", x[y], x[y]),
            "m0": m0.sum(0), "P0": began.sum(0), "n": np.array([len(ms), first.sum()], float), "ll": np.array(x["ll"].sum()),
        }

    return stretch.totals(rows, [y, "ms", "Vs", "last", "first", "cross", "next_m", "ll"], make)


def maximised(s: dict[str, np.ndarray], floor: float = 1e-8) -> Linear:
    """Closed form from the sums: A, Q over all steps into a row, H, R over rows, and the moments of the states before them."""
    if s["n"][0] < 1:
        raise ValueError("rows are needed")
    A = transposed(psd_solve(s["gamma1"], s["beta"].T))
    H = transposed(psd_solve(s["gamma"], s["delta"].T))
    Q = project_psd((s["gamma2"] - A @ s["beta"].T) / s["n"][0], floor)
    R = project_psd((s["alpha"] - H @ s["delta"].T) / s["n"][0], floor)
    m0 = s["m0"] / s["n"][1]
    return Linear(A, Q, H, R, m0, project_psd(s["P0"] / s["n"][1] - np.outer(m0, m0), floor))


def score(s: dict[str, np.ndarray], model: Linear) -> dict[str, np.ndarray]:
    """Gradient of the log evidence in A, Q, H, R, m0 and P0, from `statistics` under the model.

    By Fisher's identity it is the expected gradient of the complete log density, so one filter and one smoother
    give all of it, however many parameters there are. Those of symmetric matrices are symmetric.
    """
    n, first = s["n"]

    def of(inverse, sums, count):
        return -0.5 * (count * inverse - inverse @ symmetric(sums) @ inverse)

    q, r, p = (np.linalg.inv(x) for x in (model.Q, model.R, model.P0))
    A, H, m0 = model.A, model.H, np.asarray(model.m0, float)
    b, c, off = A @ s["beta"].T, H @ s["delta"].T, np.outer(s["m0"], m0)
    return {
        "A": q @ (s["beta"] - A @ s["gamma1"]), "Q": of(q, s["gamma2"] - b - b.T + A @ s["gamma1"] @ A.T, n),
        "H": r @ (s["delta"] - H @ s["gamma"]), "R": of(r, s["alpha"] - c - c.T + H @ s["gamma"] @ H.T, n),
        "m0": p @ (s["m0"] - first * m0), "P0": of(p, s["P0"] - off - off.T + first * np.outer(m0, m0), first),
    }


def fit_gradient(series: DataFrame, model: Linear, steps: int = 50, rate: float = 1e-2, learn: tuple[str, ...] = ("A", "Q", "H", "R", "m0"), key: str = "series_id", order: str = "t", **how) -> Fit:
    """Adam over any of the model's matrices: each step is one filter and one smoother, whatever their size."""
    kinds = {"A": UNCONSTRAINED, "Q": PSD_MATRIX, "H": UNCONSTRAINED, "R": PSD_MATRIX, "m0": UNCONSTRAINED, "P0": PSD_MATRIX}
    blocks = stretch.pack(series, key, order, ["y"]).written()

    def value(p):
        now = replace(model, **p)
        s = statistics(blocks_smoothed(blocks_filtered(blocks, now), now.A, now.Q), now)
        g = score(s, now)
        return float(s["ll"]), {c: g[c] for c in learn}

    at = {c: np.asarray(getattr(model, c), float) for c in learn}
    got = by_gradient(at, {c: kinds[c] for c in learn}, None, series.count(), steps, rate, score=value, **how)
    return Fit(replace(model, **got.params), got.log_likelihoods, got.converged)


def fit(series: DataFrame, model: Linear, max_iter: int = 20, tolerance: float = 1e-4, key: str = "series_id", order: str = "t") -> Fit:
    """EM over all series together, long or short, whose whole-number orders begin anywhere and may have gaps."""
    blocks = stretch.pack(series, key, order, ["y"]).written()

    def e_step(model):
        got = statistics(blocks_smoothed(blocks_filtered(blocks, model), model.A, model.Q), model)
        return float(got["ll"]), got

    return em(model, e_step, lambda _, s: maximised(s), max_iter, tolerance)
