import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import (
    checks,
    choice,
    coupling,
    gaussian_process,
    hamiltonian,
    hidden_markov,
    kalman,
    learning,
    oscillators,
    point_process,
    preprocessing,
    spatial,
    statistics,
    switching,
)
from driftline.operators.matrices import spectral_radius
from driftline.plans import fitting
from driftline.sources import simulated


def two_states(d=2):
    A = np.array([[[0.95, 0.1], [-0.1, 0.95]], [[0.4, 0.0], [0.0, 0.4]]])
    obs = switching.GaussianObs(np.array([np.eye(2), 2 * np.eye(2)]), np.array([0.2 * np.eye(2)] * 2))
    return switching.Switching(A, np.array([0.1 * np.eye(2), 0.4 * np.eye(2)]), np.zeros((2, 2)), np.array([np.eye(2)] * 2), np.array([[0.95, 0.05], [0.1, 0.9]]), np.array([0.5, 0.5]), switching.gaussian, obs)


def exact(model, ys):
    """Smoothed chances and evidence by running every discrete path."""
    K, n = model.k, len(ys)
    weights, paths = [], list(itertools.product(range(K), repeat=n))
    for z in paths:
        lw, m, P = np.log(model.prior[z[0]]), model.m0[z[0]], model.P0[z[0]]
        for t, y in enumerate(ys):
            if t:
                lw += np.log(model.Z[z[t - 1], z[t]])
                m, P = model.A[z[t]] @ m, model.A[z[t]] @ P @ model.A[z[t]].T + model.Q[z[t]]
            m, P, ll = kalman.measured(m[None], P[None], y[None], model.obs.H[z[t]], model.obs.R[z[t]])
            m, P, lw = m[0], P[0], lw + ll[0]
        weights.append(lw)
    w = np.array(weights)
    top = w.max()
    p = np.exp(w - top)
    z = np.array(paths)
    return np.array([[p[z[:, t] == k].sum() / p.sum() for k in range(K)] for t in range(n)]), np.log(p.sum()) + top


def test_switching_is_near_enumeration_and_exact_for_one_state(spark):
    model = two_states()
    rows = simulated.switching(spark, 4, 8, model, seed=3)
    ys = {i: np.array([r["y"] for r in rows.filter(f"series_id = {i}").orderBy("t").collect()]) for i in range(4)}
    off = {False: [], True: []}
    for second in (False, True):
        first = switching.filtered(rows, model, ["y"], pairs=second)
        got = switching.smoothed(first, model, second_order=second).orderBy("series_id", "t").collect()
        total = {r["series_id"]: r["ll"] for r in first.groupBy("series_id").agg(F.sum("ll").alias("ll")).collect()}
        for i in range(4):
            want, evidence = exact(model, ys[i])
            p = np.array([r["ps"] for r in got if r["series_id"] == i])
            off[second].append(np.abs(p - want).mean())
            assert np.allclose(p.sum(1), 1) and abs(total[i] - evidence) < 0.3
    # both smoothers are approximations; the second order keeps more of the pairs
    assert np.mean(off[True]) < 0.06 < 0.25 > np.mean(off[False]) > np.mean(off[True])
    one = switching.Switching(model.A[:1], model.Q[:1], model.m0[:1], model.P0[:1], np.ones((1, 1)), np.ones(1), switching.gaussian, switching.GaussianObs(model.obs.H[:1], model.obs.R[:1]))
    for second in (False, True):
        s = switching.smoothed(switching.filtered(rows, one, ["y"], pairs=second), one, second_order=second).orderBy("series_id", "t").collect()
        y = ys[0]
        m, P = [], []
        a, b = one.m0[0], one.P0[0]
        for t in range(len(y)):
            if t:
                a, b = one.A[0] @ a, one.A[0] @ b @ one.A[0].T + one.Q[0]
            a, b, _ = (x[0] for x in kalman.measured(a[None], b[None], y[t][None], one.obs.H[0], one.obs.R[0]))
            m.append(a)
            P.append(b)
        sm, sP = m[-1], P[-1]
        for t in range(len(y) - 2, -1, -1):
            sm, sP, _ = kalman.rts(m[t], P[t], one.A[0], one.Q[0], (sm, sP))
            assert np.allclose(s[t]["ms"][0], sm) and np.allclose(s[t]["Vs"][0], sP)


def test_switching_em_rises_and_finds_the_regimes(spark):
    model = two_states()
    rows = simulated.switching(spark, 4, 300, model, seed=5).cache()
    fit = switching.fit(rows, model, ["y"], max_iter=2)
    assert fit.log_likelihoods[-1] >= fit.log_likelihoods[0]
    got = switching.path_scores(switching.filtered(rows, model, ["y"], keep=["state"]).withColumnRenamed("state", "truth"))
    table = got.groupBy("truth", "state").count().collect()
    overlap = np.zeros((2, 2))
    for r in table:
        overlap[r["truth"], r["state"]] = r["count"]
    p = fitting.assignment(overlap)
    assert sum(overlap[i, p[i]] for i in range(2)) / overlap.sum() > 0.8
    assert np.all(spectral_radius(fit.params.A) < 1.2)


def test_laplace_of_flat_prior_is_the_regression_fixed_point():
    r = np.random.default_rng(0)
    Z, x = r.normal(size=(1, 200, 2)), np.array([0.5, -0.3])
    y = r.poisson(np.exp(Z[0] @ x))[None].astype(float)
    m, P, _ = point_process.laplace(np.zeros((1, 2)), 1e6 * np.eye(2)[None], y, Z, 0.0, point_process.poisson(1.0), steps=30)
    w = np.zeros(2)
    for _ in range(50):
        mu = np.exp(Z[0] @ w)
        w += np.linalg.solve(Z[0].T @ (mu[:, None] * Z[0]), Z[0].T @ (y[0] - mu))
    assert np.allclose(m[0], w, atol=1e-4) and np.allclose(P[0], np.linalg.inv(Z[0].T @ (np.exp(Z[0] @ w)[:, None] * Z[0])), rtol=1e-3)


def test_spike_regression_recovers_weights(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(4000, 2))
    y = r.poisson(np.exp(0.2 + x @ [0.6, -0.4]) * 0.5)
    rows = spark.createDataFrame([(float(n), v.tolist()) for n, v in zip(y, x)], "n double, m array<double>")
    w = point_process.regression(rows, "n", "m", None, 0.5, np.zeros(3))
    assert np.allclose(w, [0.2, 0.6, -0.4], atol=0.08)


def test_counts_em_and_switching_spikes(spark):
    rows = spark.range(4 * 80).selectExpr("id % 4 AS unit_id", "cast(id / 4 AS int) AS t", "cast(2 + 2 * sin(id / 40.0) AS int) AS n", "array(1.0D) AS z")
    model = point_process.Counts(np.eye(1), 0.1 * np.eye(1), np.zeros(1), np.eye(1), 1.0)
    fit = point_process.fit(rows, model, 3, structure="diagonal", fixed_A=True)
    assert fit.log_likelihoods[-1] >= fit.log_likelihoods[0] - 1e-6
    obs = point_process.SpikeObs(np.array([[0.0, 0.0], [1.5, 1.5]]), np.array([np.eye(2) * 0.3] * 2), 1.0)
    m = switching.Switching(np.array([0.8 * np.eye(2)] * 2), np.array([0.1 * np.eye(2)] * 2), np.zeros((2, 2)), np.array([np.eye(2)] * 2), np.array([[0.95, 0.05]] * 1 + [[0.05, 0.95]]), np.array([0.5, 0.5]), point_process.spikes, obs)
    seen = simulated.switching(spark, 3, 200, m, 7, "spikes")
    first = switching.filtered(seen, m, ["y"], keep=["state"])
    got = switching.path_scores(first.withColumnRenamed("state", "truth")).filter("state = truth").count()
    assert got > 0.75 * 600
    again = point_process.refit_spikes(switching.smoothed(first, m, keep=["y"]), obs)
    assert np.isfinite(again.weights).all() and again.baseline[1].mean() > again.baseline[0].mean()


def test_choices(spark):
    p, d = choice.softmax_update(np.zeros((1, 1)), np.eye(1)[None], np.array([1]), 1.0, steps=30)[:2]
    x = 0.0  # two options are a logistic regression
    for _ in range(100):
        s = 1 / (1 + np.exp(-x))
        x += (1 - s - x) / (s * (1 - s) + 1)
    assert p[0, 0] == pytest.approx(x) and d[0, 0, 0] == pytest.approx(1 / (1 + s * (1 - s)))
    rows = simulated.choices(spark, 5, 60, 3, seed=2).cache()
    fit = choice.fit(rows, choice.Choice(3, 0.02), max_iter=2, grid=[0.5, 2.0, 5.0])
    assert fit.log_likelihoods[-1] >= fit.log_likelihoods[0]
    many = choice.log_evidence(rows, [choice.Choice(3, 0.02), fit.params])
    assert many[1] == pytest.approx(fit.log_likelihood, rel=1e-6)
    assert set(choice.against_null(rows, fit.params, 2)) == {"log_likelihood", "null_log_likelihood", "delta_bic", "detected"}
    got = choice.fit_gradient(rows, choice.Choice(3, 0.02), steps=3, rate=0.1)
    assert got.log_likelihoods[-1] > got.log_likelihoods[0]


def test_learning(spark):
    rows = simulated.learning(spark, 4, 60, 0.2, 0.9, 0.3, 25.0, 1)
    fit = learning.fit(rows, learning.Learner(0.3, 0.25), max_iter=5)
    assert np.all(np.diff(fit.log_likelihoods) > -1e-3 * abs(fit.log_likelihoods[0]))
    shown = learning.curve(learning.smoothed(learning.filtered(rows, fit.params)), fit.params)
    late = shown.filter("t > 50").agg(F.avg("p50"), F.avg("above")).first()
    assert late[0] > 0.6 and late[1] > 0.9
    trials = {r["series_id"]: r["trial"] for r in learning.criterion_trial(shown).collect()}
    assert len(trials) == 4 and any(x is not None and 0 < x < 60 for x in trials.values())
    n = 6
    for k in (2, 3):
        want = sum(0.4 ** sum(z) * 0.6 ** (n - sum(z)) for z in itertools.product((0, 1), repeat=n) if "1" * k in "".join(map(str, z)))
        assert learning.chance_of_run(0.4, k, n) == pytest.approx(want)
    smooth = learning.smoothed(learning.filtered(rows.filter("series_id = 0"), fit.params)).select("series_id", "t", F.col("ms").alias("m"), F.col("vs").alias("v"), "g")
    pairs = statistics.trial_comparisons(smooth)
    assert pairs.count() == 60 * 59 // 2 and pairs.filter("i = 0 AND j = 59").first()["p"] < 0.05


def test_rate_process_mode_is_a_fixed_point(spark):
    rows = spark.createDataFrame([(u, t, int(3 + 2 * np.sin(t / 5) + u)) for u in range(2) for t in range(40)], "unit_id long, t int, n int")
    model = gaussian_process.RateProcess(1.0, 0.6, 6.0, 1.0)
    a, b = (gaussian_process.infer(rows, model, k) for k in (6, 9))
    diff = a.join(b.withColumnRenamed("g", "h").select("unit_id", "t", "h"), ["unit_id", "t"]).agg(F.max(F.abs(F.col("g") - F.col("h")))).first()[0]
    assert diff < 1e-5
    shown = gaussian_process.rates(b, model)
    assert shown.filter("low < rate AND rate < high").count() == 80


def test_oscillator_algebra():
    freqs, damping = [4.0, 9.0], [0.95, 0.9]
    strength, phase = np.array([[0, 0.05], [0.02, 0]]), np.array([[0, 0.7], [-0.4, 0]])
    A = oscillators.directed_transition(freqs, damping, strength, phase, 100.0)
    got = oscillators.directed_parameters(A, 100.0)
    assert np.allclose(got["freqs"], freqs) and np.allclose(got["damping"], damping)
    assert np.allclose(got["strength"], strength) and np.allclose(got["phase"], phase)
    assert np.allclose(oscillators.project_blocks(A), A)
    strong = strength * 30
    scale = oscillators.stability_scale(freqs, damping, strong, 100.0)
    assert spectral_radius(scale * oscillators.directed_transition(freqs, damping, strong, phase, 100.0)) <= 0.99 + 1e-9
    Q = oscillators.correlated_noise([1.0, 2.0], phase, np.array([[0, 0.3], [0, 0]]))
    assert np.allclose(Q, Q.T) and np.allclose(oscillators.project_noise(Q), Q)
    back = oscillators.noise_parameters(Q)
    assert np.allclose(back["variance"], [1, 2]) and back["strength"][0, 1] == pytest.approx(0.3) and back["phase"][0, 1] == pytest.approx(0.7)
    r = np.random.default_rng(0).normal(size=(2, 2))
    assert np.allclose(oscillators.closest_rotation(r) @ oscillators.closest_rotation(r).T, np.eye(2))
    x = np.random.default_rng(1).normal(size=(4, 5000))
    gamma, beta = x @ x.T, A @ x @ x.T
    start = {"freqs": np.array([4.5, 8.5]), "damping": np.array([0.9, 0.85]), "strength": np.full((2, 2), 0.01), "phase": np.zeros((2, 2))}
    again = oscillators.refit_directed(gamma, beta, start, 100.0)
    assert np.allclose(again["freqs"], freqs, atol=0.2) and np.allclose(again["damping"], damping, atol=0.03)


def test_couplings_are_recovered_by_both_estimators(spark):
    params = coupling.Field(np.array([6.0]), np.array([0.99]), np.array([0.02]), 0.25, 0.01)
    beta, base = np.array([[1.2, -0.6], [0.0, 0.0]]), np.array([-1.5, -1.5])
    rows = simulated.coupled_field(spark, 1, 4000, params, beta, base, 3)
    latent = coupling.smoothed_field(rows, params, keep=("spikes",)).cache()
    mean, cov = coupling.laplace_couplings(latent, base)
    exact_mean, _, draws = coupling.gibbs_couplings(latent, base, 40, 15)
    assert np.abs(mean - beta).max() < 0.5 and np.abs(mean - exact_mean).max() < 0.25 and draws.shape == (25, 2, 2)
    made = spark.createDataFrame(coupling.coupling_rows(mean, cov), "neuron int, band int, re double, im double, var_re double, var_im double, cov double")
    p = {r["neuron"]: r["p"] for r in made.withColumn("p", statistics.wald(*[F.col(c) for c in ("re", "im", "var_re", "var_im", "cov")])[1]).collect()}
    assert p[0] < 1e-3 < p[1]


def test_leapfrog_is_symplectic_and_smoothing_helps(spark):
    h = hamiltonian.made(2, 0.05, 6, 1, 1e-4, C=np.eye(4), offset=np.zeros(4), R=0.1 * np.eye(4))
    r = np.random.default_rng(2)
    x = r.normal(size=(5, 4))
    J = np.block([[np.zeros((2, 2)), np.eye(2)], [-np.eye(2), np.zeros((2, 2))]])
    y, D = hamiltonian.leapfrog(x, h)
    assert np.abs(np.swapaxes(D, 1, 2) @ J @ D - J).max() < 1e-10
    for k in range(4):
        e = 1e-6 * np.eye(4)[k]
        assert np.allclose((hamiltonian.leapfrog(x + e, h)[0] - hamiltonian.leapfrog(x - e, h)[0]) / 2e-6, D[:, :, k], atol=1e-6)
    assert np.abs(hamiltonian.energy(y, h) - hamiltonian.energy(x, h)).max() < 0.02
    state, rows = np.array([[1.0, -0.5, 0.0, 0.3]]), []
    for t in range(80):
        state = hamiltonian.leapfrog(state, h)[0]
        rows.append((0, t, (state[0] + r.normal(0, 0.3, 4)).tolist(), state[0].tolist()))
    frame = spark.createDataFrame(rows, "series_id long, t int, lfp array<double>, x array<double>")
    truth = {t: x for _, t, _, x in rows}
    first = hamiltonian.filtered(frame, h)
    err = lambda got, c: np.mean([np.abs(np.array(g[c]) - truth[g["t"]]).mean() for g in got.collect() if g["t"] > 10])
    assert err(hamiltonian.smoothed(first, 2), "ms") < err(first, "m") < 0.3


def test_splines_and_decoding(spark):
    track = simulated.moving_field(spark, 20_000, 0.02, drift=0.0)
    basis = spatial.spline_basis(track, 3)
    z = basis.evaluate(np.array([5.0, 50.0, 99.0]), np.array([5.0, 50.0, 95.0]))
    assert z.shape == (3, basis.size) and (z >= 0).all() and z.sum(1).max() <= 1 + 1e-9
    rows = spatial.with_design(track.select("t", "x", "y", "n"), basis).withColumn("unit_id", F.lit(1))
    w, _ = spatial.stationary_field(rows, 0.02, basis.size + 1)
    got = np.exp(np.concatenate([[1], basis.evaluate(np.array([33.0]), np.array([33.0]))[0]]) @ w)
    assert 12 < got < 60
    centres = [(x, y) for x in (20, 50, 80) for y in (20, 50, 80)]
    xs = (np.arange(20) + 0.5) * 5
    X, Y = np.meshgrid(xs, xs, indexing="ij")
    maps = spatial.Maps(np.array([np.log(0.5 + 40 * np.exp(-((X - a) ** 2 + (Y - b) ** 2) / 450)) for a, b in centres]), xs, xs, np.ones((20, 20), bool))
    r = np.random.default_rng(1)
    path = np.stack([50 + 30 * np.cos(np.arange(300) / 40), 50 + 30 * np.sin(np.arange(300) / 40)], 1)
    counts = r.poisson(np.exp(maps.at(path)[0]) * 0.1)
    frame = spark.createDataFrame([(0, t, c.astype(float).tolist()) for t, c in enumerate(counts)], "series_id long, t int, counts array<double>")
    A, Q = spatial.motion(0.1, 0.0, 200.0)
    out = spatial.decoded(frame, maps, 0.1, A, Q, np.array([80.0, 50, 0, 0]), np.diag([100.0, 100, 50, 50]), penalty=spatial.track_penalty(maps, 5.0), gain=0.1).orderBy("t").collect()
    assert np.median([np.hypot(*(np.array(o["m"][:2]) - path[o["t"]])) for o in out]) < 8


def test_graph_basis(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (3, 4, 2.0)], "src int, dst int, distance double")
    L = spatial.laplacian(edges, 5)
    w, v, label = spatial.graph_basis(L)
    assert np.allclose(v @ np.diag(w) @ v.T, L) and len(set(label[:3])) == 1 and label[3] != label[0]
    with pytest.raises(ValueError):
        spatial.graph_basis(L, rank=1)
    seen = spark.createDataFrame([(0,), (4,), (-1,)], "bin int")
    got = {r["bin"]: r["valid"] for r in spatial.graph_design(seen, v[:, :3]).collect()}
    assert got == {0: True, 4: True, -1: False}


def test_the_joint_path_as_by_enumeration(spark):
    model = two_states()
    rows = simulated.switching(spark, 5, 7, model, seed=4)
    K, n = 2, 7
    first = switching.filtered(rows, model, ["y"], scores=True).orderBy("series_id", "t").collect()
    got = {(r["series_id"], r["t"]): r["state"] for r in switching.path(rows, model, ["y"]).collect()}
    for i in range(5):
        own = [r for r in first if r["series_id"] == i]
        p, pll = np.array(own[0]["p"]), np.array([r["pll"] for r in own])
        value = lambda z: np.log(p[z[0]]) + sum(np.log(model.Z[z[t - 1], z[t]]) + pll[t, z[t - 1], z[t]] for t in range(1, n))
        best = max(itertools.product(range(K), repeat=n), key=value)
        assert tuple(got[i, t] for t in range(n)) == best


def test_the_bound_of_one_state_is_the_evidence(spark):
    two = two_states()
    one = switching.Switching(two.A[:1], two.Q[:1], two.m0[:1], two.P0[:1], np.ones((1, 1)), np.ones(1), switching.gaussian, switching.GaussianObs(two.obs.H[:1], two.obs.R[:1]))
    rows = simulated.switching(spark, 6, 40, two, seed=5)
    got = switching.bound(rows, one)
    assert got["bound"] == pytest.approx(got["log_likelihood"], abs=1e-4)
    assert switching.bound(rows, two)["bound"] < switching.bound(rows, two)["log_likelihood"] + 1.0


def test_warm_starts_and_restarts(spark):
    model = two_states()
    rows = simulated.switching(spark, 4, 200, model, seed=6)
    warm = switching.warm_start(rows, model, window=20)
    assert warm.prior.sum() == pytest.approx(1) and (warm.prior >= 0.05).all() and not np.allclose(warm.P0, model.P0)
    assert np.allclose(warm.m0, model.m0)  # states that see differently keep their means
    assert switching.warm_start(rows.filter("t < 30"), model, window=20) is not None
    assert switching.warm_start(rows.filter("series_id = 0 AND t < 20"), model, window=20) is model
    worse = switching.Switching(model.A, 100 * model.Q, model.m0, model.P0, model.Z, model.prior, model.observe, model.obs)
    run = lambda m: switching.fit(rows, m, ["y"], max_iter=1)
    best = switching.best_of([worse, model], run)
    assert best.log_likelihood == pytest.approx(max(run(worse).log_likelihood, run(model).log_likelihood))
    shown = {r["name"]: r["value"] for r in fitting.summary(spark, best, 9, 800).collect()}
    assert shown["log_likelihood"] == best.log_likelihood and shown["Z[0][1]"] == best.params.Z[0, 1]


def test_checks_find_what_is_broken(spark):
    rows = spark.createDataFrame([(0, 1.0, [0.5, 0.5]), (3, -1.0, [0.5, 0.6]), (None, float("nan"), [1.0, None])], "k int, x double, p array<double>")
    found = checks.violations(rows, option=checks.option_index(F.col("k"), 3), sign=checks.nonnegative(F.col("x")), share=checks.distribution(F.col("p"))).first()
    assert tuple(found) == (2, 2, 2)
    with pytest.raises(ValueError, match="option"):
        checks.require(rows, option=checks.option_index(F.col("k"), 3))
    assert checks.require(rows.limit(1), ok=checks.count(F.col("k"))).count() == 1
    for broken in (np.diag([1.0, -1.0]), np.array([[1.0, 0.5], [0.1, 1.0]]), np.zeros((2, 3)), np.diag([1.0, np.inf])):
        with pytest.raises(ValueError):
            checks.covariance(broken)
    with pytest.raises(ValueError, match="sum to 1"):
        checks.chain([[0.5, 0.4], [0.1, 0.9]])
    with pytest.raises(ValueError):
        checks.scalar(-1.0, "dt", positive=True)
    checks.switching(two_states())
    with pytest.raises(ValueError):
        oscillators.Penalty(edge=-1.0)
    with pytest.raises(ValueError):
        oscillators.Penalty(area=1.0)


def test_choice_weights_and_contingency_covariates_are_recovered(spark):
    r = np.random.default_rng(7)
    z = r.integers(0, 2, 3000)
    logits = np.stack([np.zeros(3000), 0.3 + 1.5 * z, -0.5 * z], 1)
    pick = (logits + r.gumbel(size=logits.shape)).argmax(1)
    trials = spark.createDataFrame([(0, int(t), int(pick[t]), [float(z[t])]) for t in range(3000)], "series_id long, t long, choice int, z array<double>")
    start = choice.Choice(3, 1e-5, 1.0, 1.0, weights=np.zeros((3, 1)))
    got = choice.fit(trials, start, max_iter=6, learn=("weights",), features="z").params.weights[:, 0]
    assert got[1] - got[0] == pytest.approx(1.5, abs=0.3) and got[2] - got[0] == pytest.approx(-0.5, abs=0.3)

    rows = []
    for i in range(40):
        s = 0
        for t in range(60):
            u = float(r.integers(0, 2))
            if t:
                stay = 1 / (1 + np.exp(-(3.0 - 2.5 * u)))
                s = s if r.random() < stay else 1 - s
            k = int(r.random() < (0.9 if s else 0.1))
            rows.append((i, t, k, int(r.random() < 0.9), [u]))
    trials = spark.createDataFrame(rows, "series_id long, t long, choice int, reward int, u array<double>")
    value = np.array([[2.2, 0.0], [0.0, 2.2]])
    start = hidden_markov.Contingency(np.full((2, 2), 0.9), value, np.array([[1.0], [-1.0]]), np.array([0.9, 0.1]), 1.0, np.zeros((1, 2, 1)))
    fit = hidden_markov.fit_contingency(trials, start, max_iter=12, covariates="u")
    assert all(b >= a - 1e-6 for a, b in zip(fit.log_likelihoods, fit.log_likelihoods[1:]))
    assert fit.params.weights[0, 0, 0] < -1.0 and fit.params.weights[0, 1, 0] > 1.0


def test_a_spline_follows_a_cubic(spark):
    r = np.random.default_rng(8)
    curve = lambda t: 2 - t + 0.5 * t**2 - 0.1 * t**3
    times = {k: np.sort(r.uniform(0, 10, n)) for k, n in (("a", 4), ("b", 30), ("c", 3))}
    samples = spark.createDataFrame([(k, float(t), float(curve(t))) for k, ts in times.items() for t in ts], "k string, t double, v double")
    at = spark.createDataFrame([(k, float(t)) for k in times for t in r.uniform(-1, 11, 20)], "k string, t double")
    for bucket in (None, 2.0):
        got = preprocessing.interpolate(samples, at, "k", "t", "v", kind="cubic", bucket=bucket).collect()
        assert len(got) == 60
        for x in got:
            assert x["v"] is None if x["k"] == "c" else x["v"] == pytest.approx(curve(x["t"]), abs=1e-6)
    smooth = spark.createDataFrame([(float(t), float(np.sin(t))) for t in np.linspace(0, 6, 60)], "t double, v double")
    got = preprocessing.interpolate(smooth, spark.createDataFrame([(1.234,), (4.5,)], "t double"), None, "t", "v", kind="cubic").collect()
    assert all(x["v"] == pytest.approx(np.sin(x["t"]), abs=1e-4) for x in got)


def test_blocks_are_the_dense_filter(spark):
    r = np.random.default_rng(9)
    d, units = 5, 4
    A, Q, P0 = 0.9 * np.eye(d), 0.1 * np.eye(d), np.eye(d)
    Q[0, 1] = Q[1, 0] = 0.05
    weights = np.zeros((units, d))
    weights[0, :2], weights[1, 1], weights[2, 2:4], weights[3, 4] = (0.5, -0.3), 0.4, (0.2, 0.6), 0.7
    model = point_process.Counts(A, Q, np.linspace(-0.5, 0.5, d), P0, 1.0)
    counts = r.poisson(1.0, (2, 30, units))
    rows = spark.createDataFrame([(i, t, [int(x) for x in counts[i, t]]) for i in range(2) for t in range(30)], "series_id long, t long, counts array<int>")
    parts = point_process.blocks_of(model, weights)
    assert [o.tolist() for o, _ in parts] == [[0, 1], [2, 3], [4]] and [u.tolist() for _, u in parts] == [[0, 1], [2], [3]]
    got = point_process.filtered_blocks(rows, model, weights).collect()
    assert len(got) == 2 * 30 * 3
    by = {(x["series_id"], x["t"], x["block"]): x for x in got}
    for i in range(2):
        m, P = model.m0[None], P0[None]
        for t in range(30):
            m, P = m @ A.T, A @ P @ A.T + Q
            m, P, ll = point_process.laplace(m, P, counts[i, t][None].astype(float), weights[None], 0.0, point_process.poisson(1.0))
            for k, (own, _) in enumerate(parts):
                assert by[i, t, k]["m"] == pytest.approx(m[0, own]) and np.allclose(by[i, t, k]["V"], P[0][np.ix_(own, own)])
            assert sum(by[i, t, k]["ll"] for k in range(3)) == pytest.approx(ll[0], abs=1e-6)


def test_kernel_maps_have_the_gradient_of_their_rates():
    r = np.random.default_rng(10)
    k = spatial.Kernels(r.uniform(0, 10, (40, 2)), r.poisson(1.0, (40, 3)).astype(float), np.full(40, 0.1), 2.0, np.array([1.0, 2.0, 0.5]), 0.3)
    p = r.uniform(0, 10, (6, 2))
    value, slope = k.at(p)
    assert value == pytest.approx(spatial.kernel_log_rate(p, k.where, k.spikes, k.weights, k.sigma2, k.base, k.tau))
    for c in (0, 1):
        e = 1e-5 * np.eye(2)[c]
        assert slope[..., c] == pytest.approx((k.at(p + e)[0] - k.at(p - e)[0]) / 2e-5, abs=1e-6)
    assert spatial.grid((0, 0), (1, 2), 3).shape == (9, 2) and spatial.knots_for_width(30.0, (0, 100), (0, 100)) == 10


def test_one_hamiltonian_alone_and_twice_the_same(spark):
    h = hamiltonian.made(1, 0.1, 4, 3, 0.01, C=np.eye(2), offset=np.zeros(2), R=0.1 * np.eye(2))
    r = np.random.default_rng(11)
    rows = spark.createDataFrame([(i, t, r.normal(size=2).tolist()) for i in range(3) for t in range(25)], "series_id long, t long, lfp array<double>")
    plain = hamiltonian.smoothed(hamiltonian.filtered(rows, h), 1).orderBy("series_id", "t").collect()
    for models, Z, prior in (([h], np.ones((1, 1)), np.ones(1)), ([h, h], np.array([[0.9, 0.1], [0.3, 0.7]]), np.array([0.2, 0.8]))):
        got = hamiltonian.switching_smoothed(hamiltonian.switching_filtered(rows, models, Z, prior), models, Z).orderBy("series_id", "t").collect()
        for a, b in zip(plain, got):
            for k in range(len(models)):
                assert b["ms"][k] == pytest.approx(a["ms"], abs=1e-7) and np.allclose(b["Vs"][k], a["Vs"], atol=1e-7)
            assert b["ll"] == pytest.approx(a["ll"]) and sum(b["ps"]) == pytest.approx(1)


def test_gradient_fits_rise(spark):
    model = two_states()
    rows = simulated.switching(spark, 3, 60, model, seed=12)
    at, spec, build = switching.matrices(model, ("A", "Q", "Z", "prior", "R"))
    got = switching.fit_gradient(rows, at, spec, build, ["y"], steps=6, rate=2e-2)
    assert got.log_likelihoods[-1] > got.log_likelihoods[0] and got.params["Z"].sum(1) == pytest.approx(1)
    assert np.linalg.eigvalsh(got.params["Q"]).min() > 0
    penalty = oscillators.Penalty(edge=0.5, area=0.1, shared=0.1, areas=(0, 1))
    spec, build, pull = oscillators.gradient_family("directed", 1.0, penalty)
    at = {"strength": np.array([[[0.0, 0.2], [0.1, 0.0]]] * 2), "damping": np.array([0.6, 0.7])}
    assert pull(at) == pytest.approx(0.5 * 0.6 + 0.1 * 2 * (0.2 + 0.1) + 0.1 * (0.08**0.5 + 0.02**0.5), abs=2e-3)
    fixed = {"freqs": [0.1, 0.2], "variance": [0.3, 0.3], "phase": np.zeros((2, 2, 2)), "r": 1.0}
    got = switching.fit_gradient(rows, at, {c: spec[c] for c in at}, build(fixed), ["y"], steps=3, penalty=pull)
    assert got.params["strength"].sum() < at["strength"].sum()
    r = np.random.default_rng(15)
    trials = spark.createDataFrame([(i, t, int(r.integers(0, 3))) for i in range(3) for t in range(40)], "series_id long, t long, choice int")
    spec, build = choice.switching_family(3)
    at = {"noises": np.array([0.01, 0.1]), "temperatures": np.array([1.0, 3.0]), "decays": np.array([0.9, 0.8]), "Z": np.array([[0.9, 0.1], [0.1, 0.9]])}
    got = switching.fit_gradient(trials, at, spec, build({}), ["choice"], steps=5, rate=5e-2)
    assert got.log_likelihoods[-1] > got.log_likelihoods[0]
    fit = choice.fit_switching(trials, build({})(got.params), max_iter=3)
    assert fit.params.Z.sum(1) == pytest.approx(1) and (fit.params.Q[:, 0, 0] > 0).all()
    counts = spark.createDataFrame([(i, t, int(x), [1.0]) for i in range(4) for t, x in enumerate(np.random.default_rng(i).poisson(3.0, 40))], "unit_id long, t long, n int, z array<double>")
    start = point_process.Counts(np.eye(1), 0.05 * np.eye(1), np.zeros(1), np.eye(1), 1.0)
    got = point_process.fit_gradient(counts, start, steps=8, rate=5e-2, learn=("Q", "m0"))
    assert got.log_likelihoods[-1] > got.log_likelihoods[0] and got.params.m0[0] > 0.2


def test_small_helpers(spark):
    assert coupling.scaled(np.array([1.0, -2.0]), 0.5).tolist() == [0.5, -1.0]
    with pytest.raises(ValueError):
        coupling.scaled(np.ones(2), -1.0)
    records = [{"magnitude": 0.2, "estimator": "a", "bias": b, "coverage": 1.0} for b in (0.1, 0.3, float("nan"))]
    one = coupling.averaged(spark, records).first()
    assert (one["n"], one["bias"]) == (3, pytest.approx(0.2))
    with pytest.raises(ValueError):
        coupling.averaged(spark, [])
    values = np.random.default_rng(13).normal(size=500).round(1)
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    at = [0.0, 0.05, 0.5, 0.77, 1.0]
    assert statistics.quantiles(frame, "x", at) == pytest.approx(np.quantile(values, at))
    assert np.isnan(statistics.quantiles(frame.filter("x > 99"), "x", [0.5])[0])
    basis = spatial.Spline(np.array([5.0]), np.array([5.0]), (0.0, 0.0), (10.0, 10.0))
    w = np.random.default_rng(14).normal(size=(2, basis.size + 1))
    maps = spatial.maps_of_fields(w, basis, (0.0, 0.0), (10.0, 10.0), 6)
    p = np.array([[4.0, 8.0]])
    want = np.concatenate([[1.0], basis.evaluate(p[:, 0], p[:, 1])[0]])
    assert maps.at(p)[0][0] == pytest.approx(w @ want)
    with pytest.raises(ValueError):
        spatial.laplacian(spark.createDataFrame([(0, 1, 1.0)], "src int, dst int, distance double"), 10**6)


def test_drifting_maps_in_one_pass(spark):
    """Maps of all units at once, with series in one block, in several and over several batches, as by filter, smoother and map of each."""
    r = np.random.default_rng(3)
    track = spark.createDataFrame(
        [(k, t + 5, int(r.integers(0, 2)), *map(float, r.uniform(0, 1, 2))) for k in (0, 1, 2) for t in range(11 + 19 * k)], "series_id long, t long, unit_id int, x double, y double"
    )
    basis, units = spatial.spline_basis(track, 1), [0, 1]
    d = basis.size + 1
    weights, covs = spatial.stationary_fields(track, basis, units, 1.0)
    turn = 0.95 * np.eye(d) + 0.01 * np.eye(d, k=1)
    places = np.array([[0.2, 0.3], [0.8, 0.6]])
    want, models = {}, {False: {}, True: {}}
    for unit in units:
        rows = spatial.with_design(track.withColumn("n", (F.col("unit_id") == unit).cast("int")).select("series_id", "t", "x", "y", "n"), basis)
        w, cov = spatial.stationary_field(rows, 1.0, d)
        assert np.allclose(weights[unit], w, atol=1e-8) and np.allclose(covs[unit], cov, atol=1e-8)
        for moving in (False, True):
            m = models[moving][unit] = point_process.Counts(turn if moving else np.eye(d), 1e-2 * np.eye(d), w, 0.01 * np.eye(d) + cov, 1.0)
            smooth = point_process.smoothed(point_process.filtered(rows, m, key="series_id"), m, key="series_id", keep=("n", "ll"))
            want |= {(moving, x["series_id"], unit, x["place"]): (x["rate"], x["low"], x["high"]) for x in spatial.rate_map(smooth, basis, places, key="series_id").collect()}
    for room in (1 << 25, 100_000):
        for block in (128, 8):
            for moving in (False, True):
                got = spatial.drifting_maps(track, basis, models[moving], places, block=block, room=room).collect()
                assert len(got) == 12
                for x in got:
                    assert (x["rate"], x["low"], x["high"]) == pytest.approx(want[moving, x["series_id"], x["unit_id"], x["place"]], rel=1e-5)


def test_gains_of_many_cases_at_once():
    r = np.random.default_rng(0)
    root, H, noise = r.normal(size=(5, 2, 2)), r.normal(size=(4, 2)), r.uniform(0.5, 2, (5, 4))
    p = root @ np.swapaxes(root, 1, 2)
    many = kalman.gain_by_inversion_lemma(p, H, noise)
    for k in range(5):
        want = p[k] @ H.T @ np.linalg.inv(H @ p[k] @ H.T + np.diag(noise[k]))
        assert np.allclose(many[k], want) and np.allclose(kalman.gain_by_inversion_lemma(p[k], H, noise[k]), want)


def test_covariances_of_many_cases_to_free_numbers_and_back():
    root = np.random.default_rng(0).normal(size=(5, 3, 3))
    p = root @ np.swapaxes(root, 1, 2)
    free = fitting.PSD_MATRIX.free(p)
    assert free.shape == (5, 6) and np.allclose(free, [fitting.PSD_MATRIX.free(x) for x in p])
    assert np.allclose(fitting.PSD_MATRIX.bound(free, p.shape), p) and np.allclose(fitting.PSD_MATRIX.bound(free[0], (3, 3)), p[0])


def test_cell_kernels_without_slopes_and_in_many_tasks(spark):
    from driftline import queries

    r = np.random.default_rng(0)
    rows = spark.createDataFrame([(*map(float, r.uniform(0, 9, 2)), 0.5, [float(r.integers(0, 3))]) for _ in range(200)], "x double, y double, weight double, spikes array<double>")
    k = spatial.cell_kernels(rows, 4.0, np.array([1.0]), 0.3)
    p = r.uniform(0, 9, (100, 2))
    assert (k.log_rates(p) == k.at(p)[0]).all()
    assert queries.queries()["kernel_cells"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_first_better_works_out_no_chances(spark):
    """Comparisons with the first trial are told by z; chances are those of the normal distribution at z."""
    from statistics import NormalDist

    rows = spark.createDataFrame([(0, t, 0.1 * t * t, 0.5 + 0.1 * t, 0.7) for t in range(8)], "series_id long, t int, m double, v double, g double")
    pairs = statistics.trial_comparisons(rows, reference=0)
    got = pairs.collect()
    assert len(got) == 7 and max(abs(r["p"] - NormalDist().cdf(r["z"])) for r in got) < 1e-12
    first = learning.first_better(pairs, level=0.4)
    assert "aggregate(sequence" not in first._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in first.collect()] == [(0, min(r["j"] for r in got if r["p"] < 0.2))]
