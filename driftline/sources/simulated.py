"""Seeded series and events, made where they are used: a row's draws depend on the seed and its partition."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def local_level(spark: SparkSession, n_series: int, n_time: int, q: float, r: float, seed: int = 0) -> DataFrame:
    """(series_id, t, x, y): a random walk of step variance q seen with noise variance r."""
    path = Window.partitionBy("series_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    grid = spark.range(n_series * n_time).select(
        (F.col("id") % n_series).alias("series_id"), F.floor(F.col("id") / n_series).cast("int").alias("t")
    )
    drawn = grid.select("*", (F.randn(seed) * math.sqrt(q)).alias("step"), (F.randn(seed + 1) * math.sqrt(r)).alias("noise"))
    return drawn.withColumn("x", F.sum("step").over(path)).select("series_id", "t", "x", (F.col("x") + F.col("noise")).alias("y"))


def poisson_counts(rates: DataFrame, dt: float, seed: int = 0, rate: str = "rate", into: str = "n") -> DataFrame:
    """rates with Poisson counts of mean rate * dt, by inversion; for means up to about 20 a bin."""
    mean = F.col(rate) * dt
    draw = rates.withColumn("__u", F.rand(seed)).withColumn("__m", mean)
    counted = """aggregate(sequence(1, 60), named_struct('n', 0, 'p', exp(-__m), 'c', exp(-__m)),
        (s, k) -> named_struct('n', if(__u > s.c, k, s.n), 'p', s.p * __m / k, 'c', s.c + s.p * __m / k), s -> s.n)"""
    return draw.withColumn(into, F.expr(counted)).drop("__u", "__m")


def place_field_track(spark: SparkSession, n_time: int, dt: float, length: float, centre: float, width: float, peak: float, seed: int = 0) -> DataFrame:
    """(t, position, rate, n): runs to and fro on a track past one place field."""
    sweep = F.pmod(F.col("id") * (dt * 10.0), F.lit(2 * length))
    position = F.when(sweep <= length, sweep).otherwise(2 * length - sweep)
    frame = spark.range(n_time).select(F.col("id").cast("int").alias("t"), position.alias("position"))
    rate = F.exp(-((F.col("position") - centre) ** 2) / (2 * width**2)) * peak
    return poisson_counts(frame.withColumn("rate", rate), dt, seed)


def switching_levels(spark: SparkSession, n_series: int, n_time: int, stay: float, means: tuple[float, float], sd: float, seed: int = 0) -> DataFrame:
    """(series_id, t, state, y): a two-state chain that stays with probability `stay`, seen as a level with noise."""
    path = Window.partitionBy("series_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    grid = spark.range(n_series * n_time).select(
        (F.col("id") % n_series).alias("series_id"), F.floor(F.col("id") / n_series).cast("int").alias("t")
    )
    drawn = grid.select("*", (F.rand(seed) > stay).cast("int").alias("flip"), F.randn(seed + 1).alias("z"))
    state = (F.sum("flip").over(path) % 2).cast("int")
    level = F.when(F.col("state") == 1, means[1]).otherwise(means[0])
    return drawn.withColumn("state", state).select("series_id", "t", "state", (level + sd * F.col("z")).alias("y"))


def bandit(spark: SparkSession, n_series: int, n_time: int, block: int, high: float, low: float, seed: int = 0) -> DataFrame:
    """(series_id, t, choice, reward, true_block): two options, the better one changing every `block` trials, chosen evenly."""
    grid = spark.range(n_series * n_time).select(
        (F.col("id") % n_series).alias("series_id"), F.floor(F.col("id") / n_series).cast("int").alias("t")
    )
    made = grid.select(
        "*",
        (F.rand(seed) < 0.5).cast("int").alias("choice"),
        (F.floor(F.col("t") / block) % 2).cast("int").alias("true_block"),
        F.rand(seed + 1).alias("u"),
    )
    chance = F.when(F.col("choice") == F.col("true_block"), high).otherwise(low)
    return made.withColumn("reward", (F.col("u") < chance).cast("int")).drop("u")


# ---------------------------------------------------------------- models, drawn series by series


def _series(spark: SparkSession, n_series: int, make, schema: str, seed: int) -> DataFrame:
    """Rows of `make(rng, series)`, an iterator of tables, each series from a seed of its own: a lost task draws the same again."""
    import numpy as np

    def run(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                yield from make(np.random.default_rng([seed, i]), i)

    return spark.range(0, n_series, 1, min(n_series, 64)).mapInArrow(run, schema)


CHUNK = 4096


def switching(spark: SparkSession, n_series: int, n_time: int, model, seed: int = 0, kind: str = "gaussian") -> DataFrame:
    """(series_id, t, state, x, y): a latent whose dynamics switch, seen as a Gaussian vector or as counts ("spikes").

    model: operators.switching.Switching whose obs is GaussianObs or SpikeObs.
    """
    import numpy as np
    import pyarrow as pa

    def make(r, i):
        z = int(r.choice(model.k, p=model.prior))
        x = r.multivariate_normal(model.m0[z], model.P0[z])
        for a in range(0, n_time, CHUNK):
            zs, xs, ys = [], [], []
            for t in range(a, min(n_time, a + CHUNK)):
                if t:
                    z = int(r.choice(model.k, p=model.Z[z]))
                    x = model.A[z] @ x + r.multivariate_normal(np.zeros(len(x)), model.Q[z])
                if kind == "gaussian":
                    y = model.obs.H[z] @ x + r.multivariate_normal(np.zeros(len(model.obs.R[z])), model.obs.R[z])
                else:
                    y = r.poisson(np.exp(np.clip(model.obs.baseline[z] + model.obs.weights[z] @ x, -20, 10)) * model.obs.dt).astype(float)
                zs.append(z)
                xs.append(x.tolist())
                ys.append(y.tolist())
            n = len(zs)
            yield pa.RecordBatch.from_arrays([pa.array([i] * n), pa.array(np.arange(a, a + n)), pa.array(zs, pa.int32()), pa.array(xs), pa.array(ys)], names=["series_id", "t", "state", "x", "y"])

    return _series(spark, n_series, make, "series_id long, t long, state int, x array<double>, y array<double>", seed)


def choices(spark: SparkSession, n_series: int, n_time: int, n_options: int, noise: float = 0.05, temperature: float = 2.0, decay: float = 1.0, seed: int = 0) -> DataFrame:
    """(series_id, t, choice, values): softmax choices among options whose values walk at random."""
    import numpy as np
    import pyarrow as pa

    def make(r, i):
        x = np.zeros(n_options - 1)
        for a in range(0, n_time, CHUNK):
            cs, xs = [], []
            for _ in range(min(CHUNK, n_time - a)):
                x = decay * x + r.normal(0, noise**0.5, n_options - 1)
                e = np.exp(temperature * (np.append(0, x) - max(0, x.max())))
                cs.append(int(r.choice(n_options, p=e / e.sum())))
                xs.append(x.tolist())
            n = len(cs)
            yield pa.RecordBatch.from_arrays([pa.array([i] * n), pa.array(np.arange(a, a + n)), pa.array(cs, pa.int32()), pa.array(xs)], names=["series_id", "t", "choice", "values"])

    return _series(spark, n_series, make, "series_id long, t long, choice int, values array<double>", seed)


def learning(spark: SparkSession, n_series: int, n_time: int, first: float = 0.125, last: float = 0.6, rate: float = 0.2, middle: float = 25.0, seed: int = 0) -> DataFrame:
    """(series_id, t, p, n_correct, n_possible): single trials along a sigmoid of success."""
    grid = spark.range(n_series * n_time).select((F.col("id") % n_series).alias("series_id"), F.floor(F.col("id") / n_series).cast("int").alias("t"))
    p = first + (last - first) / (1 + F.exp(-rate * (F.col("t") - middle)))
    return grid.select("*", p.alias("p"), (F.rand(seed) < p).cast("int").alias("n_correct"), F.lit(1).alias("n_possible"))


def coupled_field(spark: SparkSession, n_series: int, n_time: int, params, beta, baseline, seed: int = 0) -> DataFrame:
    """(series_id, t, lfp, spikes): oscillations seen with noise, and 0/1 spikes whose log odds follow them."""
    import numpy as np
    import pyarrow as pa

    lin = params.linear()

    def make(r, i):
        x = r.multivariate_normal(lin.m0, lin.P0)
        for a in range(0, n_time, CHUNK):
            ls, ss = [], []
            for _ in range(min(CHUNK, n_time - a)):
                x = lin.A @ x + r.normal(0, np.sqrt(np.diag(lin.Q)))
                ls.append((x + r.normal(0, params.field_noise**0.5, len(x))).tolist())
                ss.append((r.random(len(baseline)) < 1 / (1 + np.exp(-(baseline + beta @ x)))).astype(float).tolist())
            n = len(ls)
            yield pa.RecordBatch.from_arrays([pa.array([i] * n), pa.array(np.arange(a, a + n)), pa.array(ls), pa.array(ss)], names=["series_id", "t", "lfp", "spikes"])

    return _series(spark, n_series, make, "series_id long, t long, lfp array<double>, spikes array<double>", seed)


def moving_field(spark: SparkSession, n_time: int, dt: float = 0.004, arena: float = 100.0, speed: float = 20.0, peak: float = 30.0, background: float = 1.0, width: float = 12.0, drift: float = 0.02, seed: int = 0) -> DataFrame:
    """(t, x, y, rate, n): lanes to and fro over a square, past a field whose centre moves along the diagonal."""
    lanes, s = 10, F.col("id") * (dt * speed)
    lane = F.floor(s / arena)
    along = F.pmod(s, F.lit(arena))
    x = F.when(lane % 2 == 0, along).otherwise(arena - along)
    y = (F.pmod(lane, F.lit(lanes)) + 0.5) * (arena / lanes)
    c = arena / 3 + F.col("id") * (dt * drift)
    square = (x - c) ** 2 + (y - c) ** 2
    rate = background + peak * F.exp(-square / (2 * width**2))
    return poisson_counts(spark.range(n_time).select(F.col("id").alias("t"), x.alias("x"), y.alias("y"), rate.alias("rate")), dt, seed)
