"""SQL of the models' recursions, as CTEs over a table of rows; parameters are numbers or columns of the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from driftline.sheets import (
    Cell, Sheet, back, call, column, columns, counted, eliminated, even, log_sum_exp, measured, mixed, named, number, predicted, recursion, smoothed_back, solved,
)

__all__ = [
    "Cell", "Sheet", "back", "call", "chain_filter", "chain_smoother", "choice_filter", "choice_smoother", "column", "columns", "counted", "eliminated", "linear_filter",
    "linear_smoother", "linear_step", "linear_sums", "measured", "mixed", "named", "names", "number", "predicted", "recursion", "rounded", "smoothed_back", "softmax_update", "solved",
    "switching_filter", "switching_path", "switching_smoother", "switching_step", "switching_sums", "switching_values",
]


def rounded(rows: str, cells: dict[str, int] | Sequence[str], to: int = 5, given: Sequence[str] = ("series_id", "t")) -> str:
    """SELECT of given columns and of cells, rounded, without negative zeros."""
    return f"SELECT {', '.join([*given, *[f'round({c}, {to}) + 0.0 AS {c}' for c in cells]])} FROM {rows}"


def names(**shapes: tuple[int, ...]) -> list[str]:
    """Names of the cells of arrays of these shapes."""
    return [n + "".join(map(str, at)) for n, shape in shapes.items() for at in np.ndindex(*shape)]


# ---------------------------------------------------------------- linear models


def linear_filter(name: str, rows: str, y: np.ndarray, A, Q, H, R, m0, P0, offset=0.0, carry=(), keys=("series_id",)) -> str:
    d = len(m0)

    def step(s, m, P):
        m, P = predicted(s, m, P, A, Q)
        m, P, ll = measured(s, m, P, y, H, R, offset)
        return named(m=m, V=P, ll=ll)

    first = lambda s: step(s, np.asarray(m0, object), np.asarray(P0, object))
    return recursion(name, rows, first, lambda s: step(s, back("m", d), back("V", d, d)), keys, carry=carry)


def linear_smoother(name: str, filtered: str, A, Q, d: int, carry=(), keys=("series_id",)) -> str:
    """ms, Vs, cross with the next row, and that row's moments nm, nV."""
    m, V = columns("m", d), columns("V", d, d)
    zero = np.zeros((d, d))

    def later(s):
        sm, sV = back("ms", d), back("Vs", d, d)
        ms, Vs, c = smoothed_back(s, m, V, A, Q, sm, sV)
        return named(ms=ms, Vs=Vs, cross=c, nm=sm, nV=sV)

    return recursion(name, filtered, lambda s: named(ms=m, Vs=V, cross=zero, nm=np.zeros(d), nV=zero), later, keys, carry=carry, backward=True)


def linear_sums(name: str, smoothed: str, y: Sequence[str], model: tuple) -> str:
    """One row: sums for the maximisation step, over every step into a row, that from the state before the first one too."""
    A, Q, _, _, m0, P0 = model
    n, d = len(y), len(m0)
    s = Sheet()
    m, P, c = smoothed_back(s, np.asarray(m0, object), np.asarray(P0, object), A, Q, columns("ms", d), columns("Vs", d, d))
    began = f"{name}B AS ({s.over(f'(SELECT * FROM {smoothed} WHERE t = 0)', names(ms=(d,)), named(bm=m, bV=P, bc=c))})"
    out = []
    last = "t = max(t) OVER (PARTITION BY series_id)"
    for i in range(d):
        for j in range(d):
            outer = f"(Vs{i}{j} + ms{i} * ms{j})"
            start = lambda what: f"(SELECT sum({what}) FROM {name}B)"
            before = start(f"bV{i}{j} + bm{i} * bm{j}")
            out += [f"sum({outer}) AS gamma{i}{j}", f"coalesce(sum({outer}) FILTER (WHERE NOT last), 0) + {before} AS gone{i}{j}", f"{before} AS pzero{i}{j}"]
            out += [f"coalesce(sum(cross{j}{i} + nm{i} * ms{j}) FILTER (WHERE NOT last), 0) + {start(f'bc{j}{i} + ms{i} * bm{j}')} AS beta{i}{j}"]
        out += [f"sum({c} * ms{i}) AS delta{k}{i}" for k, c in enumerate(y)] + [f"(SELECT sum(bm{i}) FROM {name}B) AS mzero{i}"]
    out += [f"sum({a} * {b}) AS alpha{k}{j}" for k, a in enumerate(y) for j, b in enumerate(y)]
    out += ["count(*)::DOUBLE AS nrows", "(count(*) FILTER (WHERE t = 0))::DOUBLE AS nfirst"]
    assert n
    return f"{began}, {name} AS (SELECT {', '.join(out)} FROM (SELECT *, {last} AS last FROM {smoothed}))"


def linear_step(name: str, sums: str, d: int, n: int) -> str:
    """One row: A, Q, H, R, mstart, Pstart that maximise the expected likelihood."""
    s = Sheet()
    c = lambda x, *shape: columns(x, *shape)
    beta, delta = c("beta", d, d), c("delta", n, d)
    A = solved(s, c("gone", d, d), beta.T).T
    H = solved(s, c("gamma", d, d), delta.T).T
    Q = s.let(even((c("gamma", d, d) - A @ beta.T) / column("nrows")))
    R = s.let(even((c("alpha", n, n) - H @ delta.T) / column("nrows")))
    m0 = s.let(c("mzero", d) / column("nfirst"))
    P0 = s.let(even(c("pzero", d, d) / column("nfirst") - m0[:, None] * m0[None, :]))
    return f"{name} AS ({s.over(sums, (), named(A=A, Q=Q, H=H, R=R, mstart=m0, Pstart=P0))})"


# ---------------------------------------------------------------- switching models


def switching_filter(name: str, rows: str, K: int, d: int, A, Q, m0, P0, Z, prior, observe: Callable, carry=(), keys=("series_id",), pairs: bool = False) -> str:
    """m, V and p of each state, ll of each row; observe(sheet, m, P, state) updates one state. Columns m{k}{a}, V{k}{a}{b}, p{k}."""

    def shown(m, P, p, ll, more):
        out = named(p=np.array(p, object), ll=ll)
        for k in range(K):
            out |= named(**{f"m{k}": m[k], f"V{k}": P[k]})
        return out | (more if pairs else {})

    def pair_cells(s, ms, Ps, ps):
        out = {}
        for i in range(K):
            for j in range(K):
                out |= named(**{f"pm{i}{j}": ms[i][j], f"pV{i}{j}": Ps[i][j], f"pp{i}{j}": ps[i][j]})
        return out

    def first(s):
        got = [observe(s, m0[j], P0[j], j) for j in range(K)]
        joint = [s.let(got[j][2] + call("ln", prior[j]) if isinstance(prior[j], Cell) else got[j][2] + float(np.log(prior[j]))) for j in range(K)]
        z = log_sum_exp(s, joint)
        p = [s.let(call("exp", x - z)) for x in joint]
        m, P = [g[0] for g in got], [g[1] for g in got]
        more = pair_cells(s, [m] * K, [P] * K, [[p[j] / float(K) for j in range(K)]] * K)
        return shown(m, P, p, z, more | named(pll=np.zeros((K, K))))

    def later(s):
        ms, Ps, ps = [back(f"m{k}", d) for k in range(K)], [back(f"V{k}", d, d) for k in range(K)], back("p", K)
        got = [[observe(s, *predicted(s, ms[i], Ps[i], A[j], Q[j]), j) for j in range(K)] for i in range(K)]
        lz = lambda x: call("ln", x) if isinstance(x, Cell) else float(np.log(x))
        joint = [[s.let(got[i][j][2] + lz(Z[i][j]) + call("ln", ps[i])) for j in range(K)] for i in range(K)]
        to = [log_sum_exp(s, [joint[i][j] for i in range(K)]) for j in range(K)]
        z = log_sum_exp(s, to)
        raw = [s.let(call("greatest", call("exp", x - z), 1e-10)) for x in to]
        total = s.let(sum(raw))
        p = [s.let(x / total) for x in raw]
        w = [[s.let(call("exp", joint[i][j] - to[j])) for j in range(K)] for i in range(K)]
        m, P = [], []
        for j in range(K):
            a, b = mixed(s, [got[i][j][0] for i in range(K)], [got[i][j][1] for i in range(K)], [w[i][j] for i in range(K)])
            m.append(a)
            P.append(b)
        more = pair_cells(s, [[g[0] for g in row] for row in got], [[g[1] for g in row] for row in got], [[w[i][j] * p[j] for j in range(K)] for i in range(K)])
        more |= named(pll=np.array([[g[2] for g in row] for row in got], object))
        return shown(m, P, p, z, more)

    return recursion(name, rows, first, later, keys, carry=carry)


def switching_smoother(name: str, filtered: str, K: int, d: int, A, Q, Z, carry=(), keys=("series_id",), second_order: bool = False) -> str:
    """ms, Vs, ps of each state and, of each pair with the next row, joint, pairm, pairP, cross, nextm."""
    m, V, p = [columns(f"m{k}", d) for k in range(K)], [columns(f"V{k}", d, d) for k in range(K)], columns("p", K)
    zero = np.zeros((d, d))

    def shown(ms, Ps, ps, pairs, hidden):
        out = named(ps=np.array(ps, object))
        for k in range(K):
            out |= named(**{f"ms{k}": ms[k], f"Vs{k}": Ps[k]})
        for j in range(K):
            for k in range(K):
                a, b, c, w, n = pairs[j][k]
                out |= named(**{f"joint{j}{k}": w, f"pairm{j}{k}": a, f"pairP{j}{k}": b, f"cross{j}{k}": c, f"nextm{j}{k}": n})
        return out | hidden

    nothing = [[(np.zeros(d), zero, zero, 0.0, np.zeros(d))] * K] * K
    if not second_order:
        def later(s):
            sm, sP, nps = [back(f"ms{k}", d) for k in range(K)], [back(f"Vs{k}", d, d) for k in range(K)], back("ps", K)
            step = [[smoothed_back(s, m[j], V[j], A[k], Q[k], sm[k], sP[k]) for k in range(K)] for j in range(K)]
            total = [s.let(sum(p[j] * Z[j][k] for j in range(K))) for k in range(K)]
            joint = [[s.let(p[j] * Z[j][k] / total[k] * nps[k]) for k in range(K)] for j in range(K)]
            ps = [s.let(sum(joint[j])) for j in range(K)]
            got = [mixed(s, [x[0] for x in step[j]], [x[1] for x in step[j]], [s.let(joint[j][k] / ps[j]) for k in range(K)]) for j in range(K)]
            pairs = [[(*step[j][k], joint[j][k], sm[k]) for k in range(K)] for j in range(K)]
            return shown([g[0] for g in got], [g[1] for g in got], ps, pairs, {})

        return recursion(name, filtered, lambda s: shown(m, V, list(p), nothing, {}), later, keys, carry=carry, backward=True)

    pm = [[columns(f"pm{i}{j}", d) for j in range(K)] for i in range(K)]
    pV = [[columns(f"pV{i}{j}", d, d) for j in range(K)] for i in range(K)]
    pp = columns("pp", K, K)

    def source(s, i, j):
        return s.let(pp[i, j] / s.let(sum(pp[a, j] for a in range(K))))

    def carried(s, ms, Ps, v, ps):
        """Moments of the row given the state before and its own, and their chances, which the row before smooths with."""
        out = {}
        for i in range(K):
            for j in range(K):
                out |= named(**{f"hm{i}{j}": ms[i][j], f"hV{i}{j}": Ps[i][j], f"hw{i}{j}": s.let(v[i][j] * ps[j])})
        return out

    def begin(s):
        v = [[source(s, i, j) for j in range(K)] for i in range(K)]
        got = [mixed(s, [pm[i][j] for i in range(K)], [pV[i][j] for i in range(K)], [v[i][j] for i in range(K)]) for j in range(K)]
        del got  # the last row's moments are the filter's
        return shown(m, V, list(p), nothing, carried(s, pm, pV, v, p))

    def later(s):
        sm = [[back(f"hm{j}{k}", d) for k in range(K)] for j in range(K)]
        sP = [[back(f"hV{j}{k}", d, d) for k in range(K)] for j in range(K)]
        joint = back("hw", K, K)
        ps = [s.let(sum(joint[j])) for j in range(K)]
        w = [[s.let(joint[j, k] / ps[j]) for k in range(K)] for j in range(K)]
        three = [[[smoothed_back(s, pm[i][j], pV[i][j], A[k], Q[k], sm[j][k], sP[j][k]) for k in range(K)] for j in range(K)] for i in range(K)]
        two = [[mixed(s, [x[0] for x in three[i][j]], [x[1] for x in three[i][j]], w[j]) for j in range(K)] for i in range(K)]
        v = [[source(s, i, j) for j in range(K)] for i in range(K)]
        got = [mixed(s, [two[i][j][0] for i in range(K)], [two[i][j][1] for i in range(K)], [v[i][j] for i in range(K)]) for j in range(K)]
        pairs = []
        for j in range(K):
            row = []
            for k in range(K):
                a, b = mixed(s, [three[i][j][k][0] for i in range(K)], [three[i][j][k][1] for i in range(K)], [v[i][j] for i in range(K)])
                c = s.let(sum(v[i][j] * three[i][j][k][2] for i in range(K)))
                row.append((a, b, c, joint[j, k], sm[j][k]))
            pairs.append(row)
        hidden = carried(s, [[x[0] for x in r] for r in two], [[x[1] for x in r] for r in two], v, ps)
        return shown([g[0] for g in got], [g[1] for g in got], ps, pairs, hidden)

    return recursion(name, filtered, begin, later, keys, carry=carry, backward=True)


def switching_sums(name: str, smoothed: str, K: int, d: int, y: Sequence[str]) -> str:
    out = []
    for k in range(K):
        for i in range(d):
            for j in range(d):
                outer = f"ps{k} * (Vs{k}{i}{j} + ms{k}{i} * ms{k}{j})"
                out += [f"sum({outer}) AS gamma{k}{i}{j}", f"sum({outer}) FILTER (WHERE t > 0) AS gtwo{k}{i}{j}", f"sum({outer}) FILTER (WHERE t = 0) AS pzero{k}{i}{j}"]
                out.append(f"sum({' + '.join(f'joint{a}{k} * (pairP{a}{k}{i}{j} + pairm{a}{k}{i} * pairm{a}{k}{j})' for a in range(K))}) AS gone{k}{i}{j}")
                out.append(f"sum({' + '.join(f'joint{a}{k} * (cross{a}{k}{j}{i} + nextm{a}{k}{i} * pairm{a}{k}{j})' for a in range(K))}) AS beta{k}{i}{j}")
            out += [f"sum(ps{k} * {c} * ms{k}{i}) AS delta{k}{n}{i}" for n, c in enumerate(y)] + [f"sum(ps{k} * ms{k}{i}) FILTER (WHERE t = 0) AS mzero{k}{i}"]
        out += [f"sum(ps{k} * {a} * {b}) AS alpha{k}{n}{j}" for n, a in enumerate(y) for j, b in enumerate(y)]
        out += [f"sum(joint{k}{a}) AS moved{k}{a}" for a in range(K)]
        out += [f"sum(ps{k}) AS weight{k}", f"sum(ps{k}) FILTER (WHERE t > 0) AS later{k}", f"sum(ps{k}) FILTER (WHERE t = 0) AS first{k}"]
    return f"{name} AS (SELECT {', '.join(out)}, (count(*) FILTER (WHERE t = 0))::DOUBLE AS nfirst FROM {smoothed})"


def switching_step(name: str, sums: str, K: int, d: int, n: int, learn: Sequence[str], model) -> str:
    """One row: A, Q, Z, prior, mstart, Pstart, H and the shared R; what is not learned is the model's."""
    s = Sheet()
    c = lambda x, *shape: columns(x, *shape)
    out: dict[str, object] = {}
    for k in range(K):
        beta, gone = c(f"beta{k}", d, d), c(f"gone{k}", d, d)
        A = solved(s, gone, beta.T).T if "A" in learn else model.A[k]
        Q = model.Q[k]
        if "Q" in learn:
            b = s.let(A @ beta.T)
            Q = s.let(even((c(f"gtwo{k}", d, d) - b - b.T + s.let(A @ gone) @ A.T) / call("greatest", column(f"later{k}"), 1e-10)))
        m0, P0 = model.m0[k], model.P0[k]
        if "init" in learn:
            w = s.let(call("greatest", column(f"first{k}"), 1e-10))
            m0 = s.let(c(f"mzero{k}", d) / w)
            P0 = s.let(even(c(f"pzero{k}", d, d) / w - m0[:, None] * m0[None, :]))
        out |= named(**{f"A{k}": A, f"Q{k}": Q, f"mstart{k}": m0, f"Pstart{k}": P0})
    total = [s.let(sum(column(f"moved{j}{k}") for k in range(K))) for j in range(K)]
    Z = np.array([[s.let(column(f"moved{j}{k}") / total[j]) if "Z" in learn else model.Z[j, k] for k in range(K)] for j in range(K)], object)
    prior = np.array([s.let(column(f"first{k}") / column("nfirst")) if "prior" in learn else model.prior[k] for k in range(K)], object)
    H, rest = [], 0.0
    for k in range(K):
        delta = c(f"delta{k}", n, d)
        H.append(solved(s, c(f"gamma{k}", d, d), delta.T).T if "obs" in learn else model.obs.H[k])
        rest = rest + (c(f"alpha{k}", n, n) - H[k] @ delta.T)
    R = s.let(even(rest / sum(column(f"weight{k}") for k in range(K)))) if "obs" in learn else model.obs.R[0]
    for k in range(K):
        out |= named(**{f"H{k}": H[k]})
    return f"{name} AS ({s.over(sums, (), out | named(Z=Z, prior=prior, R=R))})"


def switching_values(K: int, d: int, n: int) -> dict:
    """The columns of switching_step as a model's arrays."""
    c = columns
    return {
        "A": [c(f"A{k}", d, d) for k in range(K)], "Q": [c(f"Q{k}", d, d) for k in range(K)], "Z": c("Z", K, K), "prior": c("prior", K),
        "m0": [c(f"mstart{k}", d) for k in range(K)], "P0": [c(f"Pstart{k}", d, d) for k in range(K)], "H": [c(f"H{k}", n, d) for k in range(K)], "R": c("R", n, n),
    }


def switching_path(filtered: str, K: int, Z, path: str = "PATH", scores: str = "SCORE") -> str:
    """CTEs of what may follow each state, and of the most likely joint path; `filtered` was made with pairs."""
    hidden = lambda: named(held=columns("pll", K, K))

    def later(s):
        after = [[s.let(float(np.log(Z[i][j])) + back("held", K, K)[i, j] + back("score", K)[j]) for j in range(K)] for i in range(K)]
        best = [s.let(call("greatest", *row)) for row in after]
        to = [Cell("CASE " + " ".join(f"WHEN {after[i][j].sql} >= {best[i].sql} THEN {j}e0" for j in range(K)) + " END", best[i].depth) for i in range(K)]
        return named(score=np.array(best, object), to_=np.array(to, object)) | hidden()

    zero = np.zeros(K)
    one = recursion(scores, filtered, lambda s: named(score=zero, to_=zero) | hidden(), later, carry=names(p=(K,)), backward=True)
    total = [call("ln", column(f"p{k}")) + column(f"score{k}") for k in range(K)]

    def first(s):
        t = [s.let(x) for x in total]
        top = s.let(call("greatest", *t))
        return named(state=Cell("CASE " + " ".join(f"WHEN {x.sql} >= {top.sql} THEN {k}e0" for k, x in enumerate(t)) + " END", top.depth)) | named(next=columns("to_", K))

    def follow(s):
        at = Cell("CASE z_state " + " ".join(f"WHEN {k} THEN z_next{k}" for k in range(K)) + " END")
        return named(state=at) | named(next=columns("to_", K))

    return f"{one}, {recursion(path, scores, first, follow)}"


# ---------------------------------------------------------------- choices


def softmax_update(s: Sheet, m, P, choice: Cell, temperature, steps: int = 3, offset=None):
    """Newton steps of a softmax over [0, x] and offsets: mode, covariance, Laplace evidence. choice: a column."""
    d, eye = len(m), np.eye(len(m))
    prec, log_v = eliminated(s, P, eye)
    chosen = [Cell(f"(CASE WHEN {choice.sql} = {k} THEN 1e0 ELSE 0e0 END)") for k in range(d + 1)]

    def options(x):
        logits = [s.let(temperature * v + (offset[k] if offset is not None else 0.0)) for k, v in enumerate([Cell("0e0"), *x])]
        z = log_sum_exp(s, logits)
        return logits, z, [s.let(call("exp", v - z)) for v in logits]

    def information(p):
        t2 = temperature * temperature
        return np.array([[t2 * (p[i + 1] * float(i == j) - p[i + 1] * p[j + 1]) for j in range(d)] for i in range(d)], object)

    x = m
    for k in range(steps):
        _, _, p = options(x)
        pull = np.array([temperature * (chosen[i + 1] - p[i + 1]) for i in range(d)], object)
        if k:
            pull = pull + s.let(prec @ s.let(m - x))
        x = s.let(x + solved(s, s.let(prec + information(p)), s.let(pull)))
    logits, z, p = options(x)
    V = s.let(even(eliminated(s, s.let(prec + information(p)), eye)[0]))
    off = s.let(x - m)
    ll = sum(chosen[k] * (logits[k] - z) for k in range(d + 1))
    return x, V, s.let(ll - 0.5 * (off @ s.let(prec @ off)) - 0.5 * log_v + 0.5 * eliminated(s, V, eye)[1])


def choice_filter(name: str, rows: str, d: int, noise, temperature, decay, m0, P0, gain=None, u=None, carry=("choice",), keys=("series_id",), offset=None) -> str:
    def step(s, m, P):
        pm = s.let(decay * m + (gain @ u if gain is not None else 0.0))
        pV = s.let(decay * decay * P + noise * np.eye(d))
        x, V, ll = softmax_update(s, pm, pV, column("choice"), temperature, offset=offset)
        shown = {}
        for name_, at in (("probs", x), ("pprobs", pm)):
            z = log_sum_exp(s, [Cell("0e0"), *[s.let(temperature * v) for v in at]])
            shown |= named(**{name_: np.array([s.let(call("exp", v - z)) for v in [Cell("0e0"), *[temperature * v for v in at]]], object)})
        return named(m=x, V=V, pm=pm, pV=pV, ll=ll) | shown

    first = lambda s: step(s, np.array(m0, object), np.array(P0, object))
    return recursion(name, rows, first, lambda s: step(s, back("m", d), back("V", d, d)), keys, carry=carry)


def choice_smoother(name: str, filtered: str, d: int, decay, carry=(), keys=("series_id",)) -> str:
    m, V = columns("m", d), columns("V", d, d)
    zero = np.zeros((d, d))
    hidden = lambda: named(hm=columns("pm", d), hV=columns("pV", d, d))

    def later(s):
        sm, sV, pm, pV = back("ms", d), back("Vs", d, d), back("hm", d), back("hV", d, d)
        J = solved(s, pV, s.let(decay * V)).T
        ms, Vs = s.let(m + J @ s.let(sm - pm)), s.let(even(V + s.let(J @ s.let(sV - pV)) @ J.T))
        return named(ms=ms, Vs=Vs, cross=s.let(J @ sV), nm=sm, nV=sV) | hidden()

    first = lambda s: named(ms=m, Vs=V, cross=zero, nm=np.zeros(d), nV=zero) | hidden()
    return recursion(name, filtered, first, later, keys, carry=carry, backward=True)


# ---------------------------------------------------------------- chains


def chain_filter(name: str, rows: str, K: int, prior, transition: Callable, loglik: Callable, carry=(), keys=("series_id",)) -> str:
    """p, pred, T of each row and lz: transition(sheet) gives the moves into a row, loglik(sheet) its log chances."""

    def step(s, pred):
        T = transition(s)
        pred = [s.let(x) for x in pred(s, T)]
        joint = [s.let(call("ln", call("greatest", pred[k], 1e-30)) + x) for k, x in enumerate(loglik(s))]
        z = log_sum_exp(s, joint)
        return named(p=np.array([s.let(call("exp", x - z)) for x in joint], object), pred=np.array(pred, object), T=T, lz=z)

    p = back("p", K)
    return recursion(
        name, rows, lambda s: step(s, lambda s, T: [x if isinstance(x, Cell) else number(x) for x in prior]),
        lambda s: step(s, lambda s, T: [sum(p[i] * T[i, j] for i in range(K)) for j in range(K)]), keys, carry=carry,
    )


def chain_smoother(name: str, filtered: str, K: int, carry=(), keys=("series_id",)) -> str:
    """sp, and pair with the next row (0 at the last)."""
    p = columns("p", K)
    hidden = lambda: named(hpred=columns("pred", K), hT=columns("T", K, K))

    def later(s):
        sp, pred, T = back("sp", K), back("hpred", K), back("hT", K, K)
        raw = [[s.let(p[i] * T[i, j] * (sp[j] / call("greatest", pred[j], 1e-30))) for j in range(K)] for i in range(K)]
        total = s.let(sum(x for row in raw for x in row))
        pair = np.array([[s.let(x / total) for x in row] for row in raw], object)
        return named(sp=np.array([s.let(sum(row)) for row in pair], object), pair=pair) | hidden()

    return recursion(name, filtered, lambda s: named(sp=p, pair=np.zeros((K, K))) | hidden(), later, keys, carry=carry, backward=True)


