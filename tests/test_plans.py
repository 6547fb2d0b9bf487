import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import hidden_markov, kalman
from driftline.plans import fitting
from driftline.plans.fold import fold, totals


def series(spark, n=6, length=70, seed=0):
    r = np.random.default_rng(seed)
    rows = [(i, t, float(r.normal())) for i in range(n) for t in range(length - i)]
    return spark.createDataFrame(rows, "series_id long, t int, y double"), rows


def plain_filter(ys, k):
    m, v, out = k.m0, k.p0, []
    for y in ys:
        pm, pv = k.a * m, k.a**2 * v + k.q
        s = k.h**2 * pv + k.r
        m, v = pm + pv * k.h / s * (y - k.h * pm), pv * k.r / s
        out.append((m, v))
    return out


@pytest.mark.parametrize("block", [3, 8, 128])
def test_scans_of_any_depth_are_the_plain_recursion(spark, block):
    k = kalman.Scalar(0.9, 0.5, 1.2, 0.7, 0.3, 2.0)
    frame, rows = series(spark)
    got = kalman.scalar_filter(frame, k, 69, block=block)
    smooth = {(r["series_id"], r["t"]): (r["sm"], r["sv"], r["cross"]) for r in kalman.scalar_smoother(got, k, 69, block=block).collect()}
    got = {(r["series_id"], r["t"]): (r["m"], r["v"]) for r in got.collect()}
    assert len(got) == len(rows)
    for i in range(6):
        ys = [y for s, _, y in rows if s == i]
        want = plain_filter(ys, k)
        assert np.allclose([got[i, t] for t in range(len(ys))], want)
        sm, sv = want[-1]
        for t in range(len(ys) - 2, -1, -1):
            m, v = want[t]
            pv = k.a**2 * v + k.q
            j = k.a * v / pv
            cross = j * sv
            sm, sv = m + j * (sm - k.a * m), v + j * j * (sv - pv)
            assert np.allclose(smooth[i, t], (sm, sv, cross))


def test_vector_filter_agrees_with_the_scalar_scan(spark):
    k = kalman.Scalar(0.9, 0.5, 1.2, 0.7, 0.3, 2.0)
    frame, _ = series(spark)
    m = kalman.Linear(*[np.array([[x]]) for x in (k.a, k.q, k.h, k.r)], np.array([k.m0]), np.array([[k.p0]]))
    vectors = kalman.filtered(frame.withColumn("y", F.array("y")), m)
    smooth = kalman.smoothed(vectors, m.A, m.Q)
    want = kalman.scalar_filter(frame, k, 69)
    want = {(r["series_id"], r["t"]): r for r in kalman.scalar_smoother(want, k, 69).collect()}
    for r in smooth.collect():
        w = want[r["series_id"], r["t"]]
        assert np.allclose([r["ms"][0], r["Vs"][0][0], r["cross"][0][0], r["ll"]], [w["sm"], w["sv"], w["cross"], w["ll"]])


def test_em_never_falls_and_repeated_orders_are_taken_in_turn(spark):
    frame, _ = series(spark, 8, 60, 3)
    rows = frame.withColumn("y", F.array(F.col("y"), F.col("y") * 0.5 + F.rand(1)))
    start = kalman.Linear(0.5 * np.eye(2), np.eye(2), np.eye(2), np.eye(2), np.zeros(2), np.eye(2))
    fit = kalman.fit(rows, start, max_iter=4)
    assert len(fit.log_likelihoods) >= 3 and np.all(np.diff(fit.log_likelihoods) > -1e-6)

    twice = spark.createDataFrame([(1, 0, 1.0), (1, 0, 2.0), (1, 1, 4.0), (None, 0, 8.0)], "k long, t int, y double")
    got = fold(twice, "k", "t", lambda n: {"s": np.zeros(n)}, lambda s, x, f: ({"s": s["s"] + x["y"]}, {"sum": s["s"] + x["y"]}), {"sum": 0}, ["y"])
    assert sorted((r["k"] or 0, r["sum"]) for r in got.collect())[0] == (0, 8.0)
    assert max(r["sum"] for r in got.collect() if r["k"]) == 7.0
    assert totals(twice, ["y"], lambda x: {"a": np.array([x["y"].sum(), 1.0 * len(x["y"])])})["a"].tolist() == [15.0, 4.0]
    assert fold(twice.limit(0), "k", "t", lambda n: {"s": np.zeros(n)}, lambda s, x, f: (s, {"sum": s["s"]}), {"sum": 0}, ["y"]).count() == 0


@pytest.mark.parametrize("block", [4, 128])
def test_chains_as_by_enumeration(spark, block):
    import itertools

    r = np.random.default_rng(5)
    stay, prior, n = (0.85, 0.7), (0.3, 0.7), 9
    T = np.array([[stay[0], 1 - stay[0]], [1 - stay[1], stay[1]]])
    lik = r.uniform(0.05, 1, (3, n, 2))
    rows = [(i, t, float(lik[i, t, 0]), float(lik[i, t, 1])) for i in range(3) for t in range(n)]
    frame = spark.createDataFrame(rows, "series_id long, t int, l0 double, l1 double")
    first = hidden_markov.two_state_filter(frame, stay, prior, n - 1, block=block)
    smooth = {(x["series_id"], x["t"]): x["s1"] for x in hidden_markov.two_state_smoother(first, stay, n - 1, block=block).collect()}
    logs = frame.select("series_id", "t", F.array(F.ln("l0"), F.ln("l1")).alias("ll"))
    general = hidden_markov.backward(hidden_markov.forward(logs, T, np.array(prior)), T, 2)
    general = {(x["series_id"], x["t"]): x for x in general.collect()}
    best = {(x["series_id"], x["t"]): x["state"] for x in hidden_markov.viterbi(logs, T, np.array(prior)).collect()}
    evidence = {x["series_id"]: x["ll"] for x in first.groupBy("series_id").agg(F.sum("ll").alias("ll")).collect()}
    for i in range(3):
        paths = list(itertools.product((0, 1), repeat=n))
        w = np.array([prior[z[0]] * np.prod([lik[i, t, z[t]] for t in range(n)]) * np.prod([T[z[t - 1], z[t]] for t in range(1, n)]) for z in paths])
        assert evidence[i] == pytest.approx(np.log(w.sum()))
        z = np.array(paths)
        assert [best[i, t] for t in range(n)] == list(paths[int(w.argmax())])
        for t in range(n):
            want = w[z[:, t] == 1].sum() / w.sum()
            assert smooth[i, t] == pytest.approx(want) and general[i, t]["sp"][1] == pytest.approx(want)
            if t < n - 1:
                joint = w[(z[:, t] == 0) & (z[:, t + 1] == 1)].sum() / w.sum()
                assert general[i, t]["pair"][0][1] == pytest.approx(joint)


def test_transforms_round_trip():
    r = np.random.default_rng(1)
    root = r.normal(size=(3, 3))
    values = {"a": np.array([0.3, 4.0]), "b": root @ root.T + np.eye(3), "c": np.array([[0.2, 0.8], [0.6, 0.4]]), "d": np.array([0.9]), "e": r.normal(size=(2, 2)), "f": np.array([12.0])}
    spec = {"a": fitting.POSITIVE, "b": fitting.PSD_MATRIX, "c": fitting.STOCHASTIC_ROW, "d": fitting.UNIT_INTERVAL, "e": fitting.UNCONSTRAINED, "f": fitting.positive_capped(50)}
    again = fitting.from_free(fitting.to_free(values, spec), values, spec)
    for k in values:
        assert np.allclose(again[k], values[k])
    spec["a"] = fitting.frozen(fitting.POSITIVE)
    assert len(fitting.to_free(values, spec)) == 6 + 2 + 1 + 4 + 1
    with pytest.raises(KeyError):
        fitting.to_free({"a": values["a"]}, spec)


def test_loops_on_small_functions():
    fit = fitting.adam({"x": np.array([3.0])}, {"x": fitting.UNCONSTRAINED}, lambda ps: [float((p["x"][0] - 1) ** 2) for p in ps], 300, 0.1)
    assert fit.params["x"][0] == pytest.approx(1, abs=0.05)
    assert np.allclose(fitting.bfgs(lambda x: (x[0] - 2) ** 2 + 5 * (x[1] + x[0]) ** 2, np.zeros(2)), [2, -2], atol=1e-3)
    assert fitting.best_on_grid(lambda xs: [-((x - 2.3) ** 2) for x in xs], [1.0, 2.0, 3.0, 5.0]) == pytest.approx(2.3, abs=0.05)
    rises = iter([-10.0, -5.0, -6.0])
    fit = fitting.em(0, lambda p: (next(rises), None), lambda p, s: p + 1)
    assert fit.params == 1 and fit.log_likelihoods == [-10.0, -5.0]
    r = np.random.default_rng(2)
    import itertools

    for n in (1, 3, 5):
        gain = r.uniform(size=(n, n))
        best = max(itertools.permutations(range(n)), key=lambda p: sum(gain[i, j] for i, j in enumerate(p)))
        assert tuple(fitting.assignment(gain)) == best


def test_folds_go_on_from_batch_to_batch(spark):
    frame, rows = series(spark, 30, 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        step = lambda s, x, f: ({"s": s["s"] + x["y"], "n": s["n"] + 1}, {"sum": s["s"] + x["y"], "first": f.astype(float)})
        got = fold(frame.filter("t >= series_id"), "series_id", "t", lambda n: {"s": np.zeros(n), "n": np.zeros(n)}, step, {"sum": 0, "first": 0}, ["y"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    total = {}
    for r in sorted(got, key=lambda r: r["t"]):
        i = r["series_id"]
        assert r["first"] == (i not in total)
        total[i] = total.get(i, 0.0) + next(y for s, t, y in rows if s == i and t == r["t"])
        assert r["sum"] == pytest.approx(total[i])
