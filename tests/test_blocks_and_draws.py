"""Block-wise count models against dense ones, line searches, exact Polya-Gamma draws, restarts."""

import numpy as np
import pytest

from driftline.operators import coupling, diagnostics, hamiltonian, kalman, oscillators, point_process, spatial, switching
from driftline.operators.matrices import block_diagonal, project_psd, psd_solve, symmetric
from driftline.plans.fold import totals
from driftline.sources import simulated


def dense_model(r):
    """Blocks of 2, 1 and 3 states, seen by 3, 1 and 2 units, in a mixed order."""
    sizes, order = (2, 1, 3), np.array([4, 0, 2, 5, 1, 3])
    A, Q = np.zeros((6, 6)), np.zeros((6, 6))
    weights, at, unit = np.zeros((6, 6)), 0, 0
    for d, u in zip(sizes, (3, 1, 2)):
        own = order[at : at + d]
        A[np.ix_(own, own)] = 0.7 * np.eye(d) + 0.1 * r.normal(size=(d, d))
        Q[np.ix_(own, own)] = 0.1 * np.eye(d) + 0.02
        weights[np.ix_(range(unit, unit + u), own)] = 0.5 * r.normal(size=(u, d))
        at, unit = at + d, unit + u
    return point_process.Counts(A, Q, 0.1 * r.normal(size=6), np.eye(6), 1.0), weights


def dense_pass(model, weights, counts):
    """Filter and smoother of one series with the whole state, the state before the first row too."""
    family, m, P, got, ll = point_process.poisson(model.dt), model.m0, model.P0, [], 0.0
    for y in counts:
        m, P, one = point_process.laplace(model.A @ m, symmetric(model.A @ P @ model.A.T + model.Q), np.array(y, float), weights, 0.0, family, 1)
        got.append((m, P))
        ll += float(one)
    out = [(*got[-1], np.zeros_like(P))]
    for m, P in reversed([(model.m0, model.P0), *got[:-1]]):
        out.append(kalman.rts(m, P, model.A, model.Q, out[-1][:2]))
    return out[::-1], ll


def test_block_smoother_and_em_as_dense(spark):
    r = np.random.default_rng(1)
    model, weights = dense_model(r)
    series = {k: r.poisson(1.0, (9 + k, 6)).tolist() for k in range(4)}
    keys = ["a", "", None, "b"]
    rows = [(keys[k], t + 11, y) for k, ys in series.items() for t, y in enumerate(ys)]
    df = spark.createDataFrame(rows, "series_id string, t int, counts array<int>")
    parts = point_process.blocks_of(model, weights)
    got = point_process.smoothed_blocks(df, model, weights).collect()
    want = {k: dense_pass(model, weights, ys) for k, ys in series.items()}
    assert sum(x["ll"] for x in got) == pytest.approx(sum(v[1] for v in want.values()), abs=1e-6)
    for x in got:
        own = parts[x["block"]][0]
        ms, Vs, cross = want[keys.index(x["series_id"])][0][x["t"] - 10]
        at = np.ix_(own, own)
        assert x["ms"] == pytest.approx(ms[own], abs=1e-7)
        assert np.array(x["Vs"]) == pytest.approx(Vs[at], abs=1e-7) and np.array(x["cross"]) == pytest.approx(cross[at], abs=1e-7)
    # one step of EM by hand on the dense sums, block by block
    fit = point_process.fit_blocks(df, model, weights, max_iter=1, tolerance=1e9).params
    g1, g2, beta, n = np.zeros((6, 6)), np.zeros((6, 6)), np.zeros((6, 6)), 0
    for states, _ in want.values():
        for (a, Pa, ca), (b, Pb, _) in zip(states[:-1], states[1:]):
            g1, g2, beta, n = g1 + Pa + np.outer(a, a), g2 + Pb + np.outer(b, b), beta + ca.T + np.outer(b, a), n + 1
    for own, _ in parts:
        at = np.ix_(own, own)
        A = psd_solve(g1[at], beta[at].T).T
        c = A @ beta[at].T
        assert fit.A[at] == pytest.approx(A, abs=1e-7)
        assert fit.Q[at] == pytest.approx(project_psd((g2[at] - c - c.T + A @ g1[at] @ A.T) / n), abs=1e-7)
    outside = block_diagonal(np.ones((1, 6, 6))) > 0
    for own, _ in parts:
        outside[np.ix_(own, own)] = False
    assert not fit.A[outside].any() and not fit.Q[outside].any()
    assert np.diff(point_process.fit_blocks(df, model, weights, max_iter=3).log_likelihoods).min() > -1e-3


def test_losses_of_spikes_never_rise(spark):
    """From starts where a full Newton step overshoots; each state and unit is looked at by itself."""
    r = np.random.default_rng(2)
    n = 200
    rows = [(k, r.poisson([0.2, 3.0]).tolist(), (2 * r.normal(size=(2, 1))).tolist(), np.full((2, 1, 1), 0.2).tolist(), [0.3, 0.7]) for k in range(n)]
    df = spark.createDataFrame(rows, "id long, y array<int>, ms array<array<double>>, Vs array<array<array<double>>>, ps array<double>").coalesce(1).cache()

    def losses(obs, ridge=1e-2):
        def make(x):
            out = np.zeros((2, 2))
            for k in range(2):
                for u in range(2):
                    b, c = obs.baseline[k, u], obs.weights[k, u]
                    m = x["ms"][:, k] @ c
                    mu = np.exp(b + m + 0.5 * np.einsum("a,nab,b->n", c, x["Vs"][:, k], c)) * obs.dt
                    out[k, u] = (x["ps"][:, k] * (mu - x["y"][:, u] * (b + m))).sum()
            return {"l": out}

        return totals(df, ["y", "ms", "Vs", "ps"], make)["l"] + 0.5 * ridge * (obs.weights**2).sum(-1)

    obs = point_process.SpikeObs(np.array([[-4.0, 3.0], [0.0, -5.0]]), np.array([[[1.5], [-2.0]], [[0.0], [2.5]]]), 1.0)
    before = losses(obs)
    for _ in range(4):
        obs = point_process.refit_spikes(df, obs)
        now = losses(obs)
        assert (now <= before + 1e-9).all()
        before = now
    many = point_process.refit_spikes(df, obs, rounds=12)
    assert (losses(many) <= before + 1e-9).all()


@pytest.mark.parametrize("eta", [0.0, 0.3, 1.0, 3.0, 8.0, 40.0, -2.0])
def test_polya_gamma_draws_are_exact(eta):
    """Mean and variance within four standard errors; seeds alone decide."""
    n = 200_000
    x = coupling.draw_polya_gamma(np.full(n, eta), np.arange(n, dtype=np.uint64) + np.uint64(7))
    e = abs(eta)
    mean = 0.25 if e == 0 else np.tanh(e / 2) / (2 * e)
    variance = 1 / 24 if e == 0 else (np.sinh(e) - e) / (4 * e**3 * np.cosh(e / 2) ** 2)
    assert x.min() > 0 and abs(x.mean() - mean) < 4 * np.sqrt(variance / n)
    spread = ((x - mean) ** 2).std() / np.sqrt(n)
    assert abs(((x - mean) ** 2).mean() - variance) < 4 * spread
    again = coupling.draw_polya_gamma(np.full((2, 3), eta), np.arange(6, dtype=np.uint64).reshape(2, 3) + np.uint64(7))
    assert np.array_equal(again.ravel(), x[:6])


def regimes(scale=1.0):
    obs = switching.GaussianObs(np.array([np.eye(2)] * 2), np.array([0.3 * np.eye(2)] * 2))
    A = np.array([0.95 * np.eye(2), scale * 0.3 * np.eye(2)])
    return switching.Switching(A, np.array([0.1 * np.eye(2), np.eye(2)]), np.zeros((2, 2)), np.array([np.eye(2)] * 2), np.array([[0.95, 0.05], [0.05, 0.95]]), np.array([0.5, 0.5]), switching.gaussian, obs)


def test_five_restarts_as_five_fits(spark):
    """All starts share each pass; one that breaks down leaves the others alone."""
    rows = simulated.switching(spark, 3, 60, regimes(), seed=9).coalesce(1).cache()
    base = regimes(0.5)
    broken = switching.Switching(base.A * np.nan, base.Q, base.m0, base.P0, base.Z, base.prior, base.observe, base.obs)
    starts = [base, regimes(1.5), broken, switching.Switching(base.A, 4 * base.Q, base.m0, base.P0, base.Z, base.prior, base.observe, base.obs), regimes(0.1)]
    best, fits = switching.fit_restarts(rows, starts, ["y"], max_iter=2)
    for k, fit in enumerate(fits):
        if k == 2:
            assert not fit.log_likelihoods
            continue
        alone = switching.fit(rows, starts[k], ["y"], max_iter=2)
        assert fit.log_likelihoods == pytest.approx(alone.log_likelihoods, rel=1e-9)
        assert fit.params.A == pytest.approx(alone.params.A, rel=1e-7)
    assert best.log_likelihood == max(f.log_likelihood for f in fits if f.log_likelihoods)
    with pytest.raises(FloatingPointError):
        switching.fit_restarts(rows, [broken], ["y"], max_iter=1)


def test_a_mixture_finds_regimes_that_differ_in_correlation_only(spark):
    """Same variances and means, correlation of 0.8 or -0.8, in stretches of 50 rows."""
    r = np.random.default_rng(12)
    rows, truth = [], {}
    for k in range(4):
        for w in range(30):
            sign = 1 if r.random() < 0.6 else -1
            truth[k, w] = sign
            draws = r.multivariate_normal([0, 0], [[1, 0.8 * sign], [0.8 * sign, 1]], 50)
            rows += [(k, 50 * w + i, y.tolist()) for i, y in enumerate(draws)]
    df = spark.createDataFrame(rows, "series_id long, t int, y array<double>")
    from pyspark.sql import functions as F

    windows = switching.window_moments(df, "series_id", "t", "y", 50).withColumn("__hash", F.xxhash64("series_id", "window")).cache()
    got = switching.mixture(windows, 2, rounds=15)
    order = np.argsort(got["centre"][:, 1])
    assert got["centre"][order, 1] == pytest.approx([-0.8, 0.8], abs=0.08)
    assert got["share"][order[1]] == pytest.approx(np.mean([v > 0 for v in truth.values()]), abs=0.02)
    assert got["spread"].shape == (2, 3, 3) and np.linalg.eigvalsh(got["spread"]).min() > 0
    again = switching.mixture(windows.repartition(7), 2, rounds=15)
    assert sorted(again["centre"][:, 1]) == pytest.approx(sorted(got["centre"][:, 1]), abs=1e-6)  # partitions do not matter
    assert switching.mixture(windows.limit(3), 2) == {}


@pytest.mark.parametrize("kind", ["common", "correlated", "directed"])
def test_gradient_fits_of_oscillators_seen_by_spikes(spark, kind):
    r = np.random.default_rng(13)
    rows = [(k, t, r.poisson(np.exp(0.2 + 0.8 * np.cos(2 * np.pi * 0.1 * t + np.arange(2)))).tolist()) for k in range(3) for t in range(40)]
    df = spark.createDataFrame(rows, "series_id long, t int, y array<int>").coalesce(1).cache()
    spec, build, pull = oscillators.spike_family(kind, 1.0, penalty=oscillators.Penalty(edge=0.01) if kind == "directed" else None)
    each = r.normal(size=(2, 2, 4)) * 0.3
    at = {"damping": np.array([0.8, 0.7]), "weights": each if kind == "common" else each[0], "baseline": np.zeros(2)}
    fixed = {"freqs": [0.12, 0.2], "variance": [0.2, 0.2]}
    if kind != "common":
        turn = np.array([[0.0, 0.5], [0.5, 0.0]])
        fixed |= {"phase": [np.triu(turn)] * 2 if kind == "correlated" else [turn] * 2}
        strength = np.array([np.zeros((2, 2)), [[0.0, 0.1], [0.0, 0.0]]])
        at, fixed = (at, fixed | {"strength": strength, "variance": [[0.2, 0.2]] * 2}) if kind == "correlated" else (at | {"strength": strength}, fixed)
    model = build(fixed)(at)
    assert model.obs.weights.shape == (2, 2, 4) and model.obs.baseline.shape == (2, 2)
    got = switching.fit_gradient(df, at, {c: spec[c] for c in at}, build(fixed), ["y"], steps=4, rate=0.05, penalty=pull)
    assert np.diff(got.log_likelihoods).min() > 0


def test_kernels_in_cells_stay_within_their_bound(spark):
    """A million positions; sums against all of them at some places, and slopes against differences."""
    n = 1_000_000
    table = spark.range(n).selectExpr(
        "100 * (0.5 + 0.5 * sin(id * 0.001)) AS x", "100 * (0.5 + 0.5 * cos(id * 0.00137)) AS y", "0.004 AS weight", "array(CAST(id % 7 = 0 AS int), CAST(id % 11 = 0 AS int)) AS spikes")
    k = spatial.cell_kernels(table, 25.0, np.array([1.0, 2.0]), 0.1)
    assert k.rows.sum() == n and len(k.codes) < 10_000
    i = np.arange(n)
    at = np.stack([100 * (0.5 + 0.5 * np.sin(i * 0.001)), 100 * (0.5 + 0.5 * np.cos(i * 0.00137))], 1)
    mass = np.stack([np.full(n, 0.004), i % 7 == 0, i % 11 == 0], 1)
    places = np.array([[50.0, 50.0], [3.0, 97.0], [20.0, 71.5], [-10.0, 40.0], [99.9, 0.2]])
    value, slope = k.sums(places)
    for p, got in zip(places, value):
        want = np.exp(-((p - at) ** 2).sum(1) / 50) @ mass
        assert (np.abs(got - want) <= k.error * mass.sum(0)).all()
        assert got == pytest.approx(want, rel=2e-4, abs=1e-6)
    rate, grad = k.at(places)
    for c in (0, 1):
        e = np.eye(2)[c] * 1e-4
        assert grad[..., c] == pytest.approx((k.at(places + e)[0] - k.at(places - e)[0]) / 2e-4, abs=1e-3)
    few = spatial.Kernels(at[::50_000], mass[::50_000, 1:], mass[::50_000, 0], 25.0, np.array([1.0, 2.0]), 0.1)
    small = spatial.cell_kernels(table.filter("id % 50000 = 0"), 25.0, np.array([1.0, 2.0]), 0.1)
    assert small.at(places)[0] == pytest.approx(few.at(places)[0], abs=1e-6) and small.at(places)[1] == pytest.approx(few.at(places)[1], abs=1e-6)


def test_nets_of_three_layers(spark):
    """Slopes and curvature against differences, a symplectic step, its Jacobian, energy kept, and a fit that rises."""
    r = np.random.default_rng(15)
    h = hamiltonian.made(2, 0.1, (5, 4, 3), seed=1, C=np.eye(4), offset=np.zeros(4), R=0.5 * np.eye(4))
    h = hamiltonian.with_parameters(h, {"v": 3 * h.v, "U1": 2 * h.inner[1][0], "c0": r.normal(size=4)})
    assert [U.shape for U, _ in h.layers] == [(5, 2), (4, 5), (3, 4)]
    q, e = r.normal(size=(7, 2)), 1e-5 * np.eye(2)
    value, slope, curve = hamiltonian.potential(q, h)
    for c in (0, 1):
        up, down = hamiltonian.potential(q + e[c], h), hamiltonian.potential(q - e[c], h)
        assert slope[:, c] == pytest.approx((up[0] - down[0]) / 2e-5, abs=1e-8)
        assert curve[:, :, c] == pytest.approx((up[1] - down[1]) / 2e-5, abs=1e-8)
    x = r.normal(size=(7, 4))
    after, F = hamiltonian.leapfrog(x, h)
    S = np.block([[np.zeros((2, 2)), np.eye(2)], [-np.eye(2), np.zeros((2, 2))]])
    assert np.swapaxes(F, 1, 2) @ S @ F == pytest.approx(np.tile(S, (7, 1, 1)), abs=1e-10)
    for c in range(4):
        d = 1e-5 * np.eye(4)[c]
        assert F[:, :, c] == pytest.approx((hamiltonian.leapfrog(x + d, h)[0] - hamiltonian.leapfrog(x - d, h)[0]) / 2e-5, abs=1e-8)
    far = x
    for _ in range(500):
        far, _ = hamiltonian.leapfrog(far, h)
    assert hamiltonian.energy(far, h) == pytest.approx(hamiltonian.energy(x, h), rel=0.02)
    rows = [(k, t, (np.sin(0.1 * t + np.arange(4)) + 0.1 * r.normal(size=4)).tolist()) for k in range(2) for t in range(25)]
    df = spark.createDataFrame(rows, "series_id long, t int, lfp array<double>").coalesce(1).cache()
    got = hamiltonian.fit(df, h, steps=3, rate=0.02, learn=("omega", "b", "v", "inner"))
    assert np.diff(got.log_likelihoods).min() > 0 and not np.allclose(got.params.inner[1][0], h.inner[1][0])


def counted(rows, **how):
    return {x["flag"]: x for x in diagnostics.report(rows, **how).collect()}


def test_ill_posed_models_say_where(spark):
    """Saturated rates, rows that no state explains, capped covariances; a sound model reports zeros."""
    df = spark.createDataFrame([(1, t, 5, [1.0 if t < 6 else 100.0]) for t in range(10)], "unit_id long, t int, n int, z array<double>")
    model = point_process.Counts(np.eye(1), 0.5 * np.eye(1), np.zeros(1), np.eye(1), 1.0)
    got = counted(point_process.filtered(df, model), key="unit_id")
    assert got["saturated"]["n"] >= 1 and got["saturated"]["first"] == 6 and got["saturated"]["n_keys"] == 1
    rows = simulated.switching(spark, 3, 30, regimes(), seed=2)
    sound = counted(switching.filtered(rows, regimes(), ["y"]))
    assert {x["n"] for x in sound.values()} == {0} and set(sound) == set(diagnostics.FLAGS) and sound["capped"]["first"] is None
    base = regimes()
    broken = switching.Switching(base.A * np.array([np.nan, 1.0])[:, None, None], base.Q, base.m0, base.P0, base.Z, base.prior, base.observe, base.obs)
    bad = counted(switching.filtered(rows, broken, ["y"]))
    assert bad["not_finite"]["n"] == 3 * 29 and bad["not_finite"]["first"] == 1 and bad["not_finite"]["share"] == pytest.approx(29 / 30)
    far = switching.Switching(np.array([1e-6 * np.eye(2)] * 2), base.Q, base.m0, base.P0, base.Z, base.prior, base.observe, base.obs)
    assert counted(switching.smoothed(switching.filtered(rows, far, ["y"]), far))["not_finite"]["n"] == 0
