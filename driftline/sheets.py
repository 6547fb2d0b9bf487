"""SQL of recursions over small matrices, for the engine's oracles.

A sheet names the cells of a computation, matrix by matrix, and writes them as nested selects: each
select adds the cells that need only those of the ones within it. Matrices are NumPy arrays of
cells and numbers, so that the text of a recursion is written with the usual operators; what
runs is plain SQL, in DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


class Cell:
    """An SQL expression over named cells, and how many selects deep these are."""

    __slots__ = ("sql", "depth")

    def __init__(self, sql: str, depth: int = 0):
        self.sql, self.depth = sql, depth

    def __add__(self, x):
        return NotImplemented if isinstance(x, np.ndarray) else self if _is(x, 0) else _join(self, "+", x)

    def __radd__(self, x):
        return self if _is(x, 0) else _join(x, "+", self)

    def __sub__(self, x):
        return NotImplemented if isinstance(x, np.ndarray) else self if _is(x, 0) else _join(self, "-", x)

    def __rsub__(self, x):
        return _join(x, "-", self)

    def __mul__(self, x):
        if isinstance(x, np.ndarray):
            return NotImplemented  # it multiplies its own cells
        return 0.0 if _is(x, 0) else self if _is(x, 1) else _join(self, "*", x)

    def __rmul__(self, x):
        return self * x

    def __truediv__(self, x):
        return NotImplemented if isinstance(x, np.ndarray) else _join(self, "/", x)

    def __rtruediv__(self, x):
        return 0.0 if _is(x, 0) else _join(x, "/", self)

    def __neg__(self):
        return Cell(f"(-{self.sql})", self.depth)


def _is(x, value: float) -> bool:
    return not isinstance(x, Cell) and x == value


def _text(x) -> str:
    if isinstance(x, Cell):
        return x.sql
    shown = repr(float(x))
    shown = shown if "e" in shown or "n" in shown else f"{shown}e0"
    return f"({shown})" if shown.startswith("-") else shown


def _join(a, sign: str, b) -> Cell:
    return Cell(f"({_text(a)} {sign} {_text(b)})", max(getattr(a, "depth", 0), getattr(b, "depth", 0)))


def call(name: str, *given) -> Cell:
    return Cell(f"{name}({', '.join(_text(x) for x in given)})", max(getattr(x, "depth", 0) for x in given))


def each(name: str, x: np.ndarray) -> np.ndarray:
    return np.array([call(name, v) for v in np.ravel(x)], object).reshape(np.shape(x))


def when(condition: str, yes, no) -> Cell:
    """condition: over columns of the base only."""
    return Cell(f"CASE WHEN {condition} THEN {_text(yes)} ELSE {_text(no)} END", max(getattr(yes, "depth", 0), getattr(no, "depth", 0)))


def column(name: str) -> Cell:
    return Cell(name)


def number(x: float) -> Cell:
    return Cell(f"({float(x)!r}::DOUBLE)")


def columns(name: str, *shape: int) -> np.ndarray:
    """name0, name1 ..., or name00, name01 ..."""
    out = np.empty(shape, object)
    for at in np.ndindex(*shape):
        out[at] = Cell(name + "".join(map(str, at)))
    return out


class Sheet:
    def __init__(self):
        self.levels: list[list[str]] = []
        self.count = 0

    def let(self, x):
        """x with its cells named; numbers stay."""
        if isinstance(x, np.ndarray):
            out = np.empty(x.shape, object)
            for at in np.ndindex(*x.shape):
                out[at] = self.let(x[at])
            return out
        if not isinstance(x, Cell):
            return x
        while len(self.levels) <= x.depth:
            self.levels.append([])
        name = f"c{self.count}"
        self.count += 1
        self.levels[x.depth].append(f"{x.sql} AS {name}")
        return Cell(name, x.depth + 1)

    def over(self, base: str, given: Sequence[str], out: dict[str, object]) -> str:
        """SELECT of `given` columns of the base and the cells of `out`, by name."""
        sql = base
        for level in self.levels:
            if level:
                sql = f"(SELECT *, {', '.join(level)} FROM {sql})"
        shown = [f"({_text(v)})::DOUBLE AS {k}" for k, v in out.items()]
        return f"SELECT {', '.join([*given, *shown])} FROM {sql}"


def named(**arrays) -> dict[str, object]:
    """Cells of arrays by name and place; a number alone keeps its name."""
    out = {}
    for name, x in arrays.items():
        for at in np.ndindex(*np.shape(x)):
            out[name + "".join(map(str, at))] = x[at] if np.shape(x) else x
    return out


def recursion(name: str, rows: str, first: Callable, later: Callable, keys: Sequence[str] = ("series_id",), order: str = "t", carry: Sequence[str] = (), backward: bool = False) -> str:
    """CTE `name` (keys, order, carry, cells): row by row of each series of `rows`, a table.

    first(sheet) and later(sheet) give the cells of a series' first row and of later ones; columns of
    rows have their names, cells of the row before have `z_` in front. backward: last row first.
    """
    kept = [*keys, order, *carry]
    one, two = Sheet(), Sheet()
    cells, more = first(one), later(two)
    if list(cells) != list(more):
        raise ValueError(f"{name}: first and later rows differ in their cells")
    match = " AND ".join(f"r.{k} = z.{k}" for k in keys)
    start = f"(SELECT * FROM {rows} WHERE {order} = 0)"
    if backward:
        start = f"(SELECT * FROM {rows} QUALIFY {order} = max({order}) OVER (PARTITION BY {', '.join(keys)}))"
    held = ", ".join(f"z.{c} AS z_{c}" for c in cells)
    step = f"(SELECT r.*, {held} FROM {name} z JOIN {rows} r ON {match} AND r.{order} = z.{order} {'-' if backward else '+'} 1)"
    return f"{name}({', '.join([*kept, *cells])}) AS ({one.over(start, kept, cells)} UNION ALL {two.over(step, kept, more)})"


def back(name: str, *shape: int) -> np.ndarray | Cell:
    """Cells of the row before."""
    return columns(f"z_{name}", *shape) if shape else column(f"z_{name}")


# ---------------------------------------------------------------- algebra


def _boost(a: np.ndarray):
    """What is added to the diagonal before a system is solved: 1e-9, or 1e-12 of its largest entry."""
    top = call("greatest", *[call("abs", a[k, k]) for k in range(len(a))])
    return call("greatest", 1e-9, 1e-12 * top)


def eliminated(s: Sheet, a: np.ndarray, b: np.ndarray, boost: bool = True) -> tuple[np.ndarray, object]:
    """Solution of the positive system a x = b, boosted, and ln of its determinant."""
    n, up = len(a), s.let(_boost(a)) if boost else 0.0
    a, b = np.array(a, object), np.array(b, object).reshape(n, -1)
    for k in range(n):
        a[k, k] = a[k, k] + up
    a = s.let(a)
    logs = 0.0
    for k in range(n):
        logs = logs + call("ln", a[k, k])
        for i in range(k + 1, n):
            f = s.let(a[i, k] / a[k, k])
            for j in range(k + 1, n):
                a[i, j] = s.let(a[i, j] - f * a[k, j])
            for j in range(b.shape[1]):
                b[i, j] = s.let(b[i, j] - f * b[k, j])
    x = np.zeros(b.shape, object)
    for i in reversed(range(n)):
        for j in range(b.shape[1]):
            rest = b[i, j]
            for k in range(i + 1, n):
                rest = rest - a[i, k] * x[k, j]
            x[i, j] = s.let(rest / a[i, i]) if isinstance(rest, Cell) or rest != 0 else 0.0
    return x, s.let(logs)


def solved(s: Sheet, a: np.ndarray, b: np.ndarray, boost: bool = True) -> np.ndarray:
    x = eliminated(s, a, b, boost)[0]
    return x[:, 0] if np.ndim(b) == 1 else x


def even(a: np.ndarray) -> np.ndarray:
    return 0.5 * (a + a.T)


def log_sum_exp(s: Sheet, xs: Sequence) -> Cell:
    top = s.let(call("greatest", *xs))
    return s.let(top + call("ln", sum(call("exp", x - top) for x in xs)))


def predicted(s: Sheet, m, P, A, Q):
    return s.let(A @ m), s.let(even(A @ s.let(P @ A.T) + Q))


def measured(s: Sheet, m, P, y, H, R, offset=0.0):
    """Kalman update by y = H x + offset + noise R: mean, covariance, log density."""
    n = len(y)
    off = s.let(y - H @ m - offset)
    hp = s.let(H @ P)
    S = s.let(even(hp @ H.T + R))
    got, log_det = eliminated(s, S, np.concatenate([hp, off[:, None]], 1))
    K, pull = got[:, :-1].T, got[:, -1]
    left = s.let(np.eye(len(m)) - K @ H)
    P = s.let(even(s.let(left @ P) @ left.T + s.let(K @ R) @ K.T))
    return s.let(m + K @ off), P, s.let(-0.5 * (n * float(np.log(2 * np.pi)) + log_det + off @ pull))


def smoothed_back(s: Sheet, m, P, A, Q, sm, sP):
    """Rauch-Tung-Striebel step: mean, covariance, covariance with the next state."""
    ap = s.let(A @ P)
    ahead = s.let(even(ap @ A.T + Q))
    J = solved(s, ahead, ap).T
    return s.let(m + J @ s.let(sm - A @ m)), s.let(even(P + s.let(J @ s.let(sP - ahead)) @ J.T)), s.let(J @ sP)


def counted(s: Sheet, m, P, y, Z, offset, log_dt: float = 0.0):
    """One Fisher step for Poisson counts of log rate Z x + offset: mode, covariance, Laplace evidence."""
    eye = np.eye(len(m))
    prec, log_det = eliminated(s, P, eye)

    def rate(x):
        eta = Z @ x + offset
        return s.let(np.array([call("least", call("greatest", e + log_dt, -20.0), 20.0) for e in eta], object))

    mu = s.let(each("exp", rate(m)))
    info = s.let(even(prec + Z.T @ (mu[:, None] * Z)))
    got, _ = eliminated(s, info, np.concatenate([(Z.T @ (y - mu))[:, None], eye], 1))
    x, V = s.let(m + got[:, 0]), s.let(even(got[:, 1:]))
    eta = rate(x)
    off = s.let(x - m)
    ll = sum(y[k] * eta[k] - call("exp", eta[k]) - call("lgamma", y[k] + 1.0) for k in range(len(y)))
    log_v = eliminated(s, V, eye)[1]
    return x, V, s.let(ll - 0.5 * (off @ s.let(prec @ off)) - 0.5 * log_det + 0.5 * log_v)


def mixed(s: Sheet, ms: Sequence[np.ndarray], Ps: Sequence[np.ndarray], ws: Sequence):
    """Mean and covariance of a mixture."""
    mean = s.let(sum(w * m for w, m in zip(ws, ms)))
    offs = [s.let(m - mean) for m in ms]
    return mean, s.let(sum(w * (P + o[:, None] * o[None, :]) for w, P, o in zip(ws, Ps, offs)))
