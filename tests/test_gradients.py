"""Gradients by passes back over the filter, against central differences of its evidence."""

from dataclasses import replace

import numpy as np
import pytest

from driftline.operators import hidden_markov, kalman, learning, point_process
from driftline.plans import fitting
from driftline.plans.fold import evidence


def compare(score: dict, value, at: dict, width=1e-5, tolerance=1e-5):
    """score against differences of value(candidates): all of a parameter's numbers, valued in one pass. Symmetric ones move in pairs."""
    tried, want = [], []
    for name, x in at.items():
        x = np.atleast_1d(np.asarray(x, float))
        for i in np.ndindex(x.shape):
            move = np.zeros_like(x)
            move[i] += 0.5
            if name in ("Q", "R", "P0"):
                move[i[::-1]] += 0.5
            else:
                move[i] += 0.5
            tried += [{name: x + s * width * move} for s in (1, -1)]
            want.append((name, i))
    got = value(tried)
    for k, (name, i) in enumerate(want):
        slope = (got[2 * k] - got[2 * k + 1]) / (2 * width)
        assert np.atleast_1d(score[name])[i] == pytest.approx(slope, abs=tolerance * max(1, abs(slope))), (name, i)


def test_linear(spark):
    r = np.random.default_rng(1)
    rows = [(k, t + 5 * k, r.normal(size=2).tolist()) for k in range(6) for t in range(4 + k)]
    df = spark.createDataFrame(rows, "series_id long, t int, y array<double>").coalesce(1).cache()
    wide = lambda d, s: s * (np.eye(d) + 0.2)
    model = kalman.Linear(0.8 * np.linalg.qr(r.normal(size=(3, 3)))[0], wide(3, 0.3), r.normal(size=(2, 3)), wide(2, 0.5), r.normal(size=3), wide(3, 1.5))
    s = kalman.statistics(kalman.path(df, model, block=4), model)

    def value(tried):
        out = []
        parts = {k: np.array([x[1] for x in sorted(rows) if x[0] == k]) for k in range(6)}
        ys = {k: [x[2] for x in sorted(rows) if x[0] == k] for k in parts}
        for p in tried:
            m, total = replace(model, **p), 0.0
            for y in ys.values():
                x, P = m.m0, m.P0
                for one in y:
                    x, P, ll = kalman.measured(m.A @ x, m.A @ P @ m.A.T + m.Q, np.array(one), m.H, m.R)
                    total += float(ll)
            out.append(total)
        return out

    assert float(s["ll"]) == pytest.approx(value([{}])[0], abs=1e-6)
    compare(kalman.score(s, model), value, {c: getattr(model, c) for c in ("A", "Q", "H", "R", "m0", "P0")})
    got = kalman.fit_gradient(df, model, steps=4, rate=0.05)
    assert np.diff(got.log_likelihoods).min() > 0


def test_counts_in_a_hundred_parameters(spark):
    r = np.random.default_rng(2)
    d = 8
    rows = [(u, t + 3, int(r.poisson(1.0)), r.normal(size=d).tolist()) for u in range(4) for t in range(12)]
    df = spark.createDataFrame(rows, "unit_id long, t int, n int, z array<double>").coalesce(1).cache()
    A = 0.8 * np.eye(d) + 0.05 * r.normal(size=(d, d))
    model = point_process.Counts(A, 0.1 * np.eye(d) + 0.01, 0.1 * r.normal(size=d), 0.5 * np.eye(d) + 0.05, 0.5)
    ll, score = point_process.score(df, model)
    value = lambda tried: evidence(df, [point_process.steps_of(replace(model, **p)) for p in tried], ["n", "z"], "unit_id", "t")
    assert ll == pytest.approx(value([{}])[0], abs=1e-6)
    compare(score, value, {"A": A, "m0": model.m0})
    compare(score, value, {"Q": model.Q, "P0": model.P0})


def test_learner(spark):
    r = np.random.default_rng(3)
    rows = [(k, t, int(r.binomial(3, 0.3 + 0.05 * t)), 3) for k in range(5) for t in range(10)]
    df = spark.createDataFrame(rows, "series_id long, t int, n_correct int, n_possible int").coalesce(1).cache()
    for model in (learning.Learner(0.4, 0.25, 0.1), learning.Learner(0.4, 0.5, -0.2, 0.7)):
        ll, score = learning.score(df, model)
        put = lambda p, m=model: replace(m, **{k: float(v[0]) for k, v in p.items()})
        value = lambda tried, put=put: evidence(df, [learning.steps_of(put(p)) for p in tried], ["n_correct", "n_possible"], "series_id", "t")
        assert ll == pytest.approx(value([{}])[0], abs=1e-8)
        compare(score, value, {"sigma": model.sigma, "x0": model.x0})


@pytest.mark.parametrize("each", [False, True])
def test_contingency(spark, each):
    """With covariates of moves and features of choices, whose shifts are those of all states or of each."""
    r = np.random.default_rng(4)
    rows = [(k, t + 9 * k, int(r.integers(3)), int(r.integers(2)), r.normal(size=2).tolist(), r.normal(size=2).tolist()) for k in range(4) for t in range(9)]
    df = spark.createDataFrame(rows, "series_id long, t int, choice int, reward int, u array<double>, z array<double>").coalesce(1).cache()
    shifts = r.normal(size=(2, 3, 2)) if each else r.normal(size=(3, 2))
    c = hidden_markov.Contingency(r.uniform(0.2, 0.8, (2, 3)), r.normal(size=(2, 3)), r.normal(size=(2, 1)), np.array([0.3, 0.7]), 1.3, r.normal(size=(2, 2, 1)), shifts)
    ll, score = hidden_markov.contingency_score(df, c, "u", features="z")
    put = lambda p: replace(c, **{k: float(v[0]) if k == "temperature" else v for k, v in p.items()})
    value = lambda tried: evidence(df, [hidden_markov.contingency_steps(put(p), "u", "z") for p in tried], ["choice", "reward", "u", "z"], "series_id", "t")
    assert ll == pytest.approx(value([{}])[0], abs=1e-8)
    compare(score, value, {k: getattr(c, k) for k in ("reward", "value", "logits", "weights", "shifts", "prior", "temperature")})
    got = hidden_markov.fit_contingency_gradient(df, c, "u", steps=4, rate=0.02, learn=("reward", "logits", "weights", "shifts", "prior", "temperature"), features="z")
    assert np.diff(got.log_likelihoods).min() > 0 and not np.allclose(got.params.shifts, shifts)


def test_slopes_of_transforms():
    r = np.random.default_rng(5)
    root = r.normal(size=(3, 3))
    at = {"P": root @ root.T + np.eye(3), "s": np.array([0.4]), "u": np.array([0.2, 0.7]), "z": np.array([[0.2, 0.8], [0.5, 0.5]])}
    spec = {"P": fitting.PSD_MATRIX, "s": fitting.POSITIVE, "u": fitting.UNIT_INTERVAL, "z": fitting.STOCHASTIC_ROW}
    g = {k: r.normal(size=np.shape(v)) for k, v in at.items()}
    g["P"] = (g["P"] + g["P"].T) / 2
    flat = fitting.to_free(at, spec)
    want = fitting.differences(lambda x: sum(float((np.asarray(v) * g[k]).sum()) for k, v in fitting.from_free(x, at, spec).items()), flat, 1e-5)
    assert fitting.pulled_back(flat, at, spec, g) == pytest.approx(want, abs=1e-7)
