import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from driftline import queries
from driftline.operators import spatial
from driftline.plans.fold import fold
from driftline.sources.tables import series
from driftline.streaming import filters

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(rows):
    shown = lambda v: "~" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(shown, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_as_sql(spark, duck, name):
    got = queries.queries()[name](spark, DATA)
    names = sorted(got.columns)
    want = duck.execute(queries.oracle_sql()[name])
    at = [d[0] for d in want.description]
    assert sorted(at) == names
    assert plain([[r[c] for c in names] for r in got.collect()]) == plain([[r[at.index(c)] for c in names] for r in want.fetchall()])


def test_only_these_queries_have_no_sql():
    assert set(queries.queries()) - set(queries.oracle_sql()) == {"coupling_gibbs", "place_field"}


def test_gibbs_draws_lie_about_the_newton_solution(spark):
    one, two = ({r["neuron"]: r for r in queries.queries()[n](spark, DATA).collect()} for n in ("coupling_gibbs", "coupling_laplace"))
    again = {r["neuron"]: r for r in queries.queries()["coupling_gibbs"](spark, DATA).collect()}
    assert one.keys() == two.keys() == {0, 1}
    for k in one:
        assert one[k]["re"] == pytest.approx(again[k]["re"], abs=1e-9)  # draws belong to rows, not to batches
        for c in ("re", "im"):
            sd = two[k][f"var_{c}"] ** 0.5
            assert abs(one[k][c] - two[k][c]) < 4 * sd and 0.2 * sd < one[k][f"var_{c}"] ** 0.5 < 4 * sd


def test_place_fields_as_by_hand(spark):
    """One user's rates of one unit, by a dense filter and smoother in NumPy."""
    got = queries.queries()["place_field"](spark, DATA).collect()
    users = {r["series_id"] for r in got}
    assert len(got) == 5 * len(users) * 9 and all(r["low"] < r["rate"] for r in got)
    track = queries._track(spark, DATA).cache()
    basis = spatial.spline_basis(track, 1)
    user, unit = min(users), 4
    rows = spatial.with_design(track.withColumn("n", (F.col("unit_id") == unit).cast("int")).select("series_id", "t", "x", "y", "n"), basis)
    model = spatial.place_field_model(rows, 1.0, basis.size + 1, 1e-4)
    own = rows.filter(f"series_id = {user}").orderBy("t").collect()
    ms, Ps, ahead = [], [], []
    m, P = model.m0, model.P0
    for r in own:
        z, pv = np.array(r["z"]), P + model.Q
        mu = np.exp(np.clip(z @ m, -20, 20))
        P = np.linalg.inv(np.linalg.inv(pv) + mu * np.outer(z, z))
        m = m + P @ z * (r["n"] - mu)
        ms.append(m), Ps.append(P), ahead.append(pv)
    sm, sP = ms[-1], Ps[-1]
    grid = queries._PLACES
    Z = np.concatenate([np.ones((len(grid), 1)), basis.evaluate(grid[:, 0], grid[:, 1])], 1)
    total = np.zeros(len(grid))
    for t in range(len(own) - 1, -1, -1):
        if t < len(own) - 1:
            J = Ps[t] @ np.linalg.inv(Ps[t] + model.Q)
            sm, sP = ms[t] + J @ (sm - ms[t]), Ps[t] + J @ (sP - Ps[t] - model.Q) @ J.T
        total += np.exp(Z @ sm + np.einsum("ga,ab,gb->g", Z, sP, Z) / 2)
    want = total / len(own)
    mine = {r["place"]: r["rate"] for r in got if r["series_id"] == user and r["unit_id"] == unit}
    assert [mine[k] for k in range(9)] == pytest.approx(want, rel=1e-4)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_a_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = series(spark, DATA).select("series_id", F.floor(F.col("t") / 2).alias("t"), "y", F.col("t").alias("k"))  # two rows of each order
    parts = [rows.filter("k < 21"), rows.filter("k BETWEEN 21 AND 40"), rows.filter("k > 40")]
    for n, part in enumerate(parts):  # a file after another, by their times
        part.sortWithinPartitions("k").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for f in os.listdir(f"{tmp_path}/in"):
            path = f"{tmp_path}/in/{f}"
            if f.endswith(".parquet") and os.path.getmtime(path) > 1e9:
                os.utime(path, (1000 + n, 1000 + n))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    start, step, into = filters.local_level(queries.LEVEL)
    filters.into_folder(filters.online(stream, "series_id", "t", start, step, into, ["y"]), f"{tmp_path}/out", f"{tmp_path}/ck")
    of = lambda frame: sorted((r["series_id"], r["t"], round(r["m"], 6)) for r in frame.collect())
    want = fold(rows.orderBy("k").coalesce(1), "series_id", "k", start, step, into, ["y"], ["t"])
    got = of(spark.read.parquet(f"{tmp_path}/out"))
    assert len(got) == rows.count() and got == of(want)


def test_idle_state_goes_and_late_rows_are_dropped():
    import pandas as pd

    start, step, into = filters.local_level(queries.LEVEL)
    run = filters.taker("t", start, step, into, ["y"])
    frame = lambda ts: pd.DataFrame({"t": ts, "y": [50.0] * len(ts)})
    made, held = run(frame([0, 1, 1, 2]), None)
    assert made["t"].tolist() == [0, 1, 1, 2]
    made, held = run(frame([1, 2, 3]), held)
    assert made["t"].tolist() == [2, 3] and held[1] == 3  # 1 lies before the last one taken, another 2 does not


def test_windows_and_sessions_of_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    for k, frame in enumerate((filters.windowed_counts(stream, "ts", "1 day", "1 hour", "event_type"), filters.sessions(stream, "ts", "6 hours", "1 hour", "user_id"))):
        frame.writeStream.format("memory").queryName(f"out{k}").outputMode("complete").option("checkpointLocation", f"{tmp_path}/{k}").trigger(availableNow=True).start().awaitTermination()
        assert spark.table(f"out{k}").selectExpr("sum(n)").first()[0] == events.count()
