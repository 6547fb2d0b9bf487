"""Sweeps over blocks against folds and enumeration, and fits by them."""

import itertools

import numpy as np
import pytest

from driftline.operators import choice, hidden_markov, kalman, point_process, switching
from driftline.plans import stretch


def flat(x) -> list[float]:
    return [v for y in x for v in flat(y)] if isinstance(x, (list, tuple, np.ndarray)) else [float(x)]


def by_row(df, *names):
    return {(r["series_id"], r["t"]): np.array(flat([r[n] for n in names])) for r in df.collect()}


def close(got, want, tolerance=1e-7):
    assert got.keys() == want.keys()
    assert max((np.abs(got[k] - want[k]).max() for k in want), default=0) < tolerance


LENGTHS = {0: 50, 1: 7, None: 23, 5: 1}


@pytest.fixture(scope="module")
def vectors(spark):
    """Series that begin at different orders, one with gaps, one without a key, one of a single row."""
    r = np.random.default_rng(0)
    rows = [(k, t * (3 if k == 1 else 1) + 100 * (k or 0) - 20, r.normal(size=2).tolist()) for k, n in LENGTHS.items() for t in range(n)]
    return spark.createDataFrame(rows, "series_id long, t int, y array<double>")


@pytest.fixture(scope="module")
def linear():
    r = np.random.default_rng(1)
    A = 0.95 * np.linalg.qr(r.normal(size=(4, 4)))[0]
    return kalman.Linear(A, 0.1 * np.eye(4) + 0.02, r.normal(size=(2, 4)), 0.3 * np.eye(2), np.ones(4), 2 * np.eye(4))


@pytest.mark.parametrize("block, level", [(128, 256), (4, 256), (2, 3)])
def test_linear_blocks_as_the_fold(monkeypatch, vectors, linear, block, level):
    """One block, several, and several levels of blocks; a state of size 4."""
    monkeypatch.setattr(stretch, "LEVEL", level)
    names = ["ll", "first", "last", "m", "V", "ms", "Vs", "cross"]
    want = kalman.smoothed(kalman.filtered(vectors, linear), linear.A, linear.Q, keep=("y", "ll", "first", "m", "V"))
    close(by_row(kalman.path(vectors, linear, block=block), *names), by_row(want, *names))


def test_a_long_series_is_many_tasks(spark, linear):
    """Rows of one series are dealt out by block, so that no task has them all."""
    rows = spark.range(20_000).selectExpr("1 AS series_id", "CAST(id AS int) AS t", "array(sin(id), cos(id)) AS y")
    packed = stretch.pack(rows, "series_id", "t", ["y"], 128)
    assert packed.span == 157
    dealt = packed.frame.repartition(4, "block").selectExpr("size(items) AS n", "spark_partition_id() AS p").groupBy("p").sum("n").collect()
    assert len(dealt) == 4 and max(r[1] for r in dealt) < 12_000
    got = kalman.path(rows, linear).selectExpr("count(*) AS n", "sum(first) AS first", "sum(last) AS last", "sum(ll) AS ll").first()
    want = kalman.filtered(rows, linear).groupBy().sum("ll").first()[0]
    assert (got["n"], got["first"], got["last"]) == (20_000, 1, 1) and got["ll"] == pytest.approx(want, abs=1e-5)


def test_empty_table(vectors, linear):
    assert kalman.path(vectors.limit(0), linear).count() == 0
    assert hidden_markov.viterbi(vectors.limit(0), np.eye(2), np.ones(2) / 2, "y").count() == 0


@pytest.mark.parametrize("matrix", [None, "M"])
@pytest.mark.parametrize("block", [128, 4])
def test_chains_of_five_states_as_the_fold(spark, matrix, block):
    """Constant moves and moves of each row."""
    r = np.random.default_rng(2)
    T, prior = r.dirichlet(np.ones(5), 5), r.dirichlet(np.ones(5))
    rows = [(k, t + 7, r.normal(size=5).tolist(), r.dirichlet(np.ones(5), 5).tolist()) for k, n in LENGTHS.items() for t in range(n)]
    df = spark.createDataFrame(rows, "series_id long, t int, ll array<double>, M array<array<double>>")
    given = None if matrix else T
    want = hidden_markov.backward(hidden_markov.forward(df, given, prior, matrix=matrix), given, 5, matrix, keep=("p", "pred"))
    names = ["p", "pred", "lz", "sp", "pair", "last"]
    close(by_row(hidden_markov.posterior(df, given, prior, matrix=matrix, block=block), *names), by_row(want, *names), 1e-12)


def test_chains_by_enumeration(spark):
    r = np.random.default_rng(3)
    T, prior, ll = r.dirichlet(np.ones(3), 3), np.array([0.0, 0.4, 0.6]), r.normal(size=(6, 3))
    T[0] = [0.0, 1.0, 0.0]
    df = spark.createDataFrame([(1, 5 + t, ll[t].tolist()) for t in range(6)], "series_id long, t int, ll array<double>")
    paths = list(itertools.product(range(3), repeat=6))
    weight = np.array([prior[z[0]] * np.prod([T[a, b] for a, b in zip(z, z[1:])]) * np.exp(sum(ll[t, k] for t, k in enumerate(z))) for z in paths])
    for block in (1, 2, 4, 128):
        got = {x["t"]: x for x in hidden_markov.posterior(df, T, prior, block=block).collect()}
        assert sum(x["lz"] for x in got.values()) == pytest.approx(np.log(weight.sum()), abs=1e-9)
        for t in range(6):
            for k in range(3):
                share = weight[[z[t] == k for z in paths]].sum() / weight.sum()
                assert got[5 + t]["sp"][k] == pytest.approx(share, abs=1e-9)
        best = [x["state"] for x in hidden_markov.viterbi(df, T, prior, block=block).orderBy("t").collect()]
        assert tuple(best) == paths[int(weight.argmax())]


def short_series(n=40, length=5, shift=lambda k: 0, gap=1):
    r = np.random.default_rng(4)
    rows = []
    for k in range(n):
        x = np.array([3.0, -2.0]) + r.normal(size=2)
        for t in range(length):
            x = np.array([[0.9, 0.2], [-0.2, 0.8]]) @ x + 0.5 * r.normal(size=2)
            rows.append((k, t * gap + shift(k), (x + 0.4 * r.normal(size=2)).tolist()))
    return rows


def test_likelihoods_of_em_never_fall(spark):
    """The raw sequence over 20 steps, on many short series whose first rows stand apart from the others."""
    df = spark.createDataFrame(short_series(), "series_id long, t int, y array<double>").coalesce(1).cache()
    model, seen = kalman.Linear(np.eye(2), np.eye(2), np.eye(2), np.eye(2), np.zeros(2), np.eye(2)), []
    for _ in range(20):
        s = kalman.statistics(kalman.smoothed(kalman.filtered(df, model), model.A, model.Q, keep=("y", "ll", "first")), model)
        seen.append(float(s["ll"]))
        model = kalman.maximised(s)
    assert np.diff(seen).min() > -1e-6 and seen[-1] > seen[0] + 50


def test_fits_do_not_depend_on_where_orders_begin(spark):
    schema = "series_id long, t int, y array<double>"
    start = kalman.Linear(np.eye(2), np.eye(2), np.eye(2), np.eye(2), np.zeros(2), np.eye(2))
    fits = [kalman.fit(spark.createDataFrame(rows, schema), start, max_iter=2).params for rows in (
        short_series(), short_series(shift=lambda k: 100), short_series(shift=lambda k: 100 * (k % 2)), short_series(shift=lambda k: -50, gap=40))]
    for other in fits[1:]:
        for name in ("A", "Q", "H", "R", "m0", "P0"):
            assert getattr(other, name) == pytest.approx(getattr(fits[0], name), abs=1e-7)


def test_count_and_switching_fits_shifted(spark):
    r = np.random.default_rng(6)
    rows = [(u, t, int(r.poisson(np.exp(0.5 + 0.3 * np.sin(t / 3)))), [1.0]) for u in range(6) for t in range(20)]
    model = point_process.Counts(np.eye(1), 0.05 * np.eye(1), np.zeros(1), np.eye(1), 1.0)
    schema = "unit_id long, t int, n int, z array<double>"
    a, b = (point_process.fit(spark.createDataFrame([(u, t + s * (u % 2), *x) for u, t, *x in rows], schema), model, max_iter=3) for s in (0, 30))
    assert a.log_likelihoods == pytest.approx(b.log_likelihoods, abs=1e-8) and np.diff(a.log_likelihoods).min() > -1e-3
    obs = switching.GaussianObs(np.array([np.eye(2)] * 2), np.array([0.5 * np.eye(2), 2 * np.eye(2)]))
    two = switching.Switching(np.array([0.9 * np.eye(2)] * 2), np.array([np.eye(2)] * 2), np.zeros((2, 2)), np.array([np.eye(2)] * 2), np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([0.5, 0.5]), switching.gaussian, obs)
    schema = "series_id long, t int, y array<double>"
    fits = [switching.fit(spark.createDataFrame(short_series(12, shift=lambda k, s=s: s * (k % 2)), schema), two, ["y"], max_iter=1).params for s in (0, 9)]
    for name in ("A", "Q", "Z", "prior", "m0"):
        assert getattr(fits[0], name) == pytest.approx(getattr(fits[1], name), abs=1e-8)


def python_steps(df) -> int:
    """Python processes that a task of the plan hands its rows through."""
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


TRIALS = hidden_markov.Contingency(np.array([[0.8, 0.3], [0.2, 0.6]]), np.array([[0.5, 0.1], [0.2, 0.4]]), np.array([[2.0], [-1.0]]), np.array([0.5, 0.5]), 1.5)


@pytest.fixture(scope="module")
def trials(spark):
    r = np.random.default_rng(7)
    rows = [(k, t + 3, int(r.integers(2)), int(r.integers(2))) for k in range(40) for t in range(5 + k % 17)]
    return spark.createDataFrame(rows, "series_id long, t int, choice int, reward int")


def test_beliefs_take_one_process(trials):
    """Chances, filter, smoother and sums of short series run in one process of a task, on slices of its batch."""
    packed = hidden_markov.contingency_trials(trials)
    assert packed.span == 1
    assert python_steps(hidden_markov.contingency_blocks(packed, TRIALS).frame) == 1
    rows = hidden_markov.contingency_posterior(trials, TRIALS)
    assert rows.columns[:4] == ["series_id", "t", "choice", "reward"]


def test_scores_of_beliefs_over_packed_trials(trials):
    """The evidence's gradient from trials packed once, series of one block and of several."""
    one, several = (hidden_markov.contingency_trials(trials, block=n) for n in (128, 4))
    got = [hidden_markov.contingency_score(x, TRIALS) for x in (one, several)]
    rows = hidden_markov.contingency_posterior(trials, TRIALS)
    assert got[0][0] == pytest.approx(rows.groupBy().sum("lz").first()[0], abs=1e-8)
    assert got[0][0] == pytest.approx(got[1][0], abs=1e-8)
    for k, v in got[0][1].items():
        np.testing.assert_allclose(v, got[1][1][k], atol=1e-8)


def test_slices_of_a_batch():
    """A batch goes through the passes in slices, whose sums are those of the whole."""
    import pyarrow as pa

    items = pa.array([[{"t": t} for t in range(n)] for n in range(100)], pa.list_(pa.struct([("t", pa.int64())])))
    batch = pa.RecordBatch.from_arrays([items], names=["items"])
    parts = list(stretch._chunks(iter([batch]), 8, 8 * 120))
    assert len(parts) > 30 and max(len(stretch._fields(p.column("items"))[1]) for p in parts) <= 120
    assert sum(stretch._fields(p.column("items"))[1].field("t").to_numpy().sum() for p in parts) == sum(n * (n - 1) // 2 for n in range(100))


def test_moments_take_one_process(vectors, linear):
    """Filter, smoother and sums of vectors run in one process of a task, and are those of the rows."""
    rows = vectors.selectExpr("series_id", "t + 20 AS t", "y")
    blocks = kalman.blocks_path(rows, linear, block=1000)
    assert blocks.span == 1 and python_steps(blocks.frame) == 1
    got, want = kalman.statistics(blocks, linear), kalman.statistics(kalman.path(rows, linear, block=4), linear)
    for k, v in want.items():
        np.testing.assert_allclose(got[k], v, atol=1e-7)


def summed_in(monkeypatch, call):
    """Python processes of each job that `call` gathers sums by, and what it gives."""
    from driftline.plans import fold

    steps, gathered = [], fold.gathered
    monkeypatch.setattr(fold, "gathered", lambda df: steps.append(python_steps(df)) or gathered(df))
    return call(), steps


def test_evidence_of_choices_takes_one_process(monkeypatch, trials):
    """Models are valued and their evidence is summed in one process of a task."""
    models = [choice.Choice(2, 0.05, b, 0.9) for b in (0.5, 2.0)]
    got, steps = summed_in(monkeypatch, lambda: choice.log_evidence(trials, models))
    assert steps == [1]
    assert got == pytest.approx([choice.filtered(trials, m).groupBy().sum("ll").first()[0] for m in models], abs=1e-8)


def test_evidence_of_recursions_takes_one_process(monkeypatch, vectors):
    """Evidence of several switching models, summed where the rows are valued."""
    eye = np.array([np.eye(2)] * 2)
    models = [switching.Switching(a * eye, eye, np.zeros((2, 2)), eye, np.full((2, 2), 0.5), np.full(2, 0.5), switching.gaussian, switching.GaussianObs(eye, b * eye)) for a, b in ((0.9, 1.0), (0.5, 2.0))]
    got, steps = summed_in(monkeypatch, lambda: switching.evidences(vectors, models, ["y"]))
    assert steps == [1]
    assert got == pytest.approx([switching.filtered(vectors, m, ["y"]).groupBy().sum("ll").first()[0] for m in models], abs=1e-8)


def test_systems_of_two_unknowns():
    """All at once as by the library, also where rows have to change places; singular ones are an error."""
    from driftline.operators import matrices

    r = np.random.default_rng(3)
    s, b = r.normal(size=(50, 3, 2, 2)), r.normal(size=(50, 1, 2, 4))
    np.testing.assert_allclose(matrices._solved_pairs(s, b), np.linalg.solve(s, b), rtol=1e-7, atol=1e-9)
    with pytest.raises(np.linalg.LinAlgError):
        matrices._solved_pairs(np.zeros((1, 2, 2)), b[0])


def test_field_is_read_once(spark, tmp_path):
    """Field and spikes come from one pass over the events, without a join of it with itself."""
    from driftline import queries

    d = str(tmp_path)
    spark.sql("SELECT id AS event_id, TIMESTAMP_NTZ'2024-01-01 01:00:00' AS ts, id % 3 AS user_id, 'view' AS event_type, id * 9.0D AS value FROM range(12)").write.parquet(f"{d}/events.parquet")
    rows = queries._field(spark, d)
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.columns == ["series_id", "t", "lfp", "spikes"] and rows.count() == 12
