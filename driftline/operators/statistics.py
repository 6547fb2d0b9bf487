"""Aggregates over states, pairs, labels and couplings."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from driftline.functions.circular import angular_distance
from driftline.plans.fold import to_numpy

TINY = 1e-12


def state_overlap(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n): how often two labellings meet."""
    return pairs.groupBy(a, b).agg(F.count("*").alias("n"))


def transition_counts(series: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """(from_state, to_state, n) over neighbouring rows of each series."""
    own = Window.partitionBy(key).orderBy(order)
    moved = series.select(F.lag(state).over(own).alias("from_state"), F.col(state).alias("to_state"))
    return moved.filter("from_state IS NOT NULL").groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


def transition_matrix(counts: DataFrame, concentration: float = 1.0, stickiness: float = 0.0, n_states: int | None = None) -> DataFrame:
    """(from_state, to_state, p): rows of (n + prior - 1), normalised; prior is concentration, and stickiness beside it on the diagonal.

    Only pairs that occur are rows. n_states is needed where the prior gives mass to pairs that do not.
    """
    more = F.when(F.col("from_state") == F.col("to_state"), concentration + stickiness).otherwise(concentration) - 1.0
    if n_states is not None:
        states = counts.select("from_state").distinct()
        grid = states.withColumn("to_state", F.explode(F.sequence(F.lit(0), F.lit(n_states - 1))))
        counts = grid.join(counts, ["from_state", "to_state"], "left").fillna(0, ["n"])
    weighed = counts.withColumn("__w", F.col("n") + more)
    row = Window.partitionBy("from_state")
    return weighed.select("from_state", "to_state", (F.col("__w") / F.sum("__w").over(row)).alias("p"))


HELD_CELLS = 4_000_000


def outer_sums(vectors: DataFrame, x: str, y: str, by: str | None = None, weight: str | None = None) -> DataFrame:
    """(by, i, j, s): sums of w * x_i * y_j over all rows, for arrays x and y: matrix products by group, added up in tasks, then over them.

    A task holds up to HELD_CELLS numbers of groups before it hands them on.
    """
    names = ([by] if by else []) + ["i", "j", "s"]
    kinds = ([vectors.schema[by]] if by else []) + [T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("s", T.DoubleType())]

    def handed(held: dict) -> Iterator[pa.RecordBatch]:
        for (value, kind), s in held.items():
            i, j = np.divmod(np.arange(s.size), s.shape[1])
            key = [pa.array([value] * s.size, kind)] if by else []
            yield pa.RecordBatch.from_arrays([*key, pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(s.ravel())], names=names)
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v = to_numpy(batch.column(x)), to_numpy(batch.column(y))
            if weight:
                u = u * to_numpy(batch.column(weight))[:, None]
            groups = batch.column(by).dictionary_encode() if by else None
            at = groups.indices.fill_null(len(groups.dictionary)).to_numpy(zero_copy_only=False) if by else np.zeros(len(u), int)
            for k in np.unique(at).tolist():
                own = at == k
                name = (groups.dictionary[k].as_py() if k < len(groups.dictionary) else None, groups.dictionary.type) if by else (None, None)
                made = u[own].T @ v[own]
                held[name] = held[name] + made if name in held else made
                if len(held) * made.size > HELD_CELLS:
                    yield from handed(held)
        yield from handed(held)

    used = list(dict.fromkeys([*([by] if by else []), x, y, *([weight] if weight else [])]))
    return vectors.select(*used).mapInArrow(run, T.StructType(kinds)).groupBy(*names[:-1]).agg(F.sum("s").alias("s"))


def lag_products(series: DataFrame, key: str, order: str, x: str) -> DataFrame:
    """(key, n, s): sum over neighbouring rows of x_t * x_{t+1}."""
    own = Window.partitionBy(key).orderBy(order)
    moved = series.select(key, F.col(x).alias("__x"), F.lead(x).over(own).alias("__next")).filter("__next IS NOT NULL")
    return moved.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col("__x") * F.col("__next")).alias("s"))


def weighted_moments(rows: DataFrame, by: str, x: str, weight: str) -> DataFrame:
    """(by, weight, mean, variance) with a weight for each row."""
    w = F.col(weight)
    sums = rows.groupBy(by).agg(F.sum(w).alias("weight"), F.sum(w * F.col(x)).alias("__s"), F.sum(w * F.col(x) ** 2).alias("__q"))
    mean = F.when(F.col("weight") > 0, F.col("__s") / F.col("weight")).otherwise(0.0)
    second = F.when(F.col("weight") > 0, F.col("__q") / F.col("weight")).otherwise(0.0)
    return sums.select(by, "weight", mean.alias("mean"), (second - mean * mean).alias("variance"))


def mixture_collapse(parts: DataFrame, by: list[str], weight: str, mean: str, variance: str) -> DataFrame:
    """(by, mean, variance) of the Gaussian with the moments of each mixture; weights are taken as they are."""
    w, m = F.col(weight), F.col(mean)
    sums = parts.groupBy(*by).agg(F.sum(w * m).alias("__m"), F.sum(w * F.col(variance)).alias("__v"), F.sum(w * m * m).alias("__q"), F.sum(w).alias("__w"))
    mean_ = F.col("__m")
    return sums.select(*by, mean_.alias("mean"), (F.col("__v") + F.col("__q") - 2 * mean_ * mean_ + F.col("__w") * mean_ * mean_).alias("variance"))


def confusion(rows: DataFrame, predicted: Column, truth: Column, by: str | None = None) -> DataFrame:
    """tp, fp, fn, tn and their ratios, null where a denominator is 0."""
    p, t = predicted, truth
    got = rows.groupBy(*([by] if by else [])).agg(
        F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn")
    )
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double"))
    got = got.withColumns(
        {"sensitivity": ratio("tp", "fn"), "specificity": ratio("tn", "fp"), "precision": ratio("tp", "fp"), "fdr": ratio("fp", "tp")}
    )
    f1 = F.try_divide(2.0 * F.col("tp"), (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double"))
    return got.withColumn("f1", f1)


def _stretches(counts: DataFrame, x: str, rows: DataFrame) -> DataFrame:
    """counts with __part, a stretch of the order of x, by cut points at even ranks of the rows: a function of x alone, whatever the plan."""
    n = max(2, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = [k / n for k in range(1, n)]
    cuts = rows.agg(F.percentile_approx(x, at, max(1000, 10 * n))).first()[0] or []
    points = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    return counts.withColumn("__part", F.size(F.filter(points, lambda c: c < F.col(x))))


def _before(counts: DataFrame, x: str, n: str, into: str, rows: DataFrame) -> DataFrame:
    """counts with the sum of n over all smaller x: within the stretch by a window, over stretches by one row each."""
    parted = _stretches(counts, x, rows)
    sizes = parted.groupBy("__part").agg(F.sum(n).alias("__size"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    begins = sizes.select("__part", F.coalesce(F.sum("__size").over(ahead), F.lit(0)).alias("__begin"))
    own = Window.partitionBy("__part").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    placed = parted.withColumn("__own", F.coalesce(F.sum(n).over(own), F.lit(0))).join(F.broadcast(begins), "__part")
    return placed.withColumn(into, F.col("__begin") + F.col("__own")).drop("__part", "__own", "__begin")


def quantiles(rows: DataFrame, x: str, at: list[float]) -> list[float]:
    """Exact quantiles, taken between the two rows beside each by its share: ranks of counts of distinct values, of which only those at stake come to the driver."""
    rows = rows.filter(F.col(x).isNotNull()).select(F.col(x).cast("double").alias(x))
    counts = rows.groupBy(x).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    if not total:
        return [math.nan] * len(at)
    wanted = sorted({k for q in at for k in (math.floor(q * (total - 1)), math.ceil(q * (total - 1)))})
    placed = _before(counts, x, "__n", "__b", rows)
    here = F.exists(F.array(*[F.lit(k) for k in wanted]), lambda k: (k >= F.col("__b")) & (k < F.col("__b") + F.col("__n")))
    held = placed.filter(here).select(x, "__b", "__n").collect()  # at most two for each quantile
    value = {k: r[0] for r in held for k in wanted if r[1] <= k < r[1] + r[2]}
    out = []
    for q in at:
        low = math.floor(q * (total - 1))
        share = q * (total - 1) - low
        out.append(value[low] + share * (value[math.ceil(q * (total - 1))] - value[low]))
    return out


def ranked(rows: DataFrame, x: str, into: str) -> DataFrame:
    """rows with the mean rank of x: by counts of equal values, so that one task holds distinct values only."""
    counts = rows.groupBy(x).agg(F.count("*").alias("__n"))
    rank = F.col("__b") + (F.col("__n") + 1) / 2.0
    return rows.join(_before(counts, x, "__n", "__b", rows).select(x, rank.alias(into)), x)


def roc_auc(rows: DataFrame, score: str, truth: str) -> DataFrame:
    """One row, auc: chance that a true row scores above a false one, ties half; null for one class.

    Taken from counts of each distinct score; rows are never joined.
    """
    rows = rows.filter(F.col(score).isNotNull())
    counts = rows.groupBy(score).agg(
        F.count_if(F.col(truth) == 1).alias("__p"), F.count_if(F.col(truth) != 1).alias("__q")
    )
    got = _before(counts, score, "__q", "__below", rows).agg(
        F.sum(F.col("__p") * (F.col("__below") + F.col("__q") / 2.0)).alias("wins"), F.sum("__p").cast("double").alias("p"), F.sum("__q").cast("double").alias("q")
    )
    return got.select(F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("wins") / (F.col("p") * F.col("q"))).alias("auc"))


def detection_score(p_value: Column) -> Column:
    return -F.log10(p_value + 1e-300)


def correlations(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: pearson and spearman, null for fewer than three rows or a constant column."""
    both = ranked(ranked(rows.select(x, y).dropna(), x, "__rx"), y, "__ry")
    flat = (F.count("*") < 3) | (F.stddev_pop(x) == 0) | (F.stddev_pop(y) == 0)
    return both.agg(F.when(~flat, F.corr(x, y)).alias("pearson"), F.when(~flat, F.corr("__rx", "__ry")).alias("spearman"))


def wald(re: Column, im: Column, var_re: Column, var_im: Column, cov: Column | None = None) -> tuple[Column, Column]:
    """Statistic m' S^-1 m of a complex coupling and its p-value exp(-W / 2); variances are at least 1e-12."""
    vr, vi = F.greatest(var_re, F.lit(TINY)), F.greatest(var_im, F.lit(TINY))
    c = cov if cov is not None else F.lit(0.0)
    det = F.greatest(vr * vi - c * c, F.lit(TINY * TINY))
    w = (re * re * vi - 2 * re * im * c + im * im * vr) / det
    return w, F.exp(-w / 2)


def coupling_summary(re: Column, im: Column, var_re: Column, var_im: Column, z: float) -> dict[str, Column]:
    """Magnitude, phase, and bounds of both components at z deviations."""
    sr, si = F.sqrt(var_re), F.sqrt(var_im)
    return {
        "magnitude": F.hypot(re, im), "phase": F.atan2(im, re),
        "re_low": re - z * sr, "re_high": re + z * sr, "im_low": im - z * si, "im_high": im + z * si,
    }


def phase_recovery(rows: DataFrame, re: str, im: str, true_re: str, true_im: str, coupled: str) -> DataFrame:
    """One row, mae: mean angular distance over coupled entries, null without any."""
    d = angular_distance(F.atan2(im, re), F.atan2(true_im, true_re))
    return rows.filter(coupled).agg(F.avg(d).alias("mae"))


def smooth_norm(square: Column, eps: float = 1e-8) -> Column:
    return F.sqrt(square + eps) - math.sqrt(eps)


def edge_l1(edges: DataFrame, eps: float = 1e-8, exclude_diagonal: bool = True) -> DataFrame:
    """One row, penalty: sum of the smooth absolute value of c over edges (state, i, j, c)."""
    used = edges.filter("i <> j") if exclude_diagonal else edges
    return used.agg(F.coalesce(F.sum(smooth_norm(F.col("c") ** 2, eps)), F.lit(0.0)).alias("penalty"))


def area_group(edges: DataFrame, areas: DataFrame, eps: float = 1e-8, exclude_diagonal: bool = True, by_state: bool = True) -> DataFrame:
    """One row, penalty: smooth Frobenius norms of area blocks (areas: osc, area), of each state or of all together."""
    used = edges.filter("i <> j") if exclude_diagonal else edges
    a = areas.select(F.col("osc").alias("i"), F.col("area").alias("from_area"))
    b = areas.select(F.col("osc").alias("j"), F.col("area").alias("to_area"))
    blocks = used.join(a, "i").join(b, "j").groupBy(*(["state"] if by_state else []), "from_area", "to_area").agg(F.sum(F.col("c") ** 2).alias("q"))
    return blocks.agg(F.coalesce(F.sum(smooth_norm(F.col("q"), eps)), F.lit(0.0)).alias("penalty"))


def area_summary(edges: DataFrame, areas: DataFrame, exclude_diagonal: bool = True) -> DataFrame:
    """(state, from_area, to_area, norm, within): block norms of the couplings."""
    used = edges.filter("i <> j") if exclude_diagonal else edges
    a = areas.select(F.col("osc").alias("i"), F.col("area").alias("from_area"))
    b = areas.select(F.col("osc").alias("j"), F.col("area").alias("to_area"))
    blocks = used.join(a, "i").join(b, "j").groupBy("state", "from_area", "to_area").agg(F.sqrt(F.sum(F.col("c") ** 2)).alias("norm"))
    return blocks.withColumn("within", F.col("from_area") == F.col("to_area"))


def phase_statistics(phases: DataFrame, by: str, phase: str) -> DataFrame:
    """(by, n, mean, std, r, p): circular mean and deviation, resultant and Rayleigh p of each group."""
    from driftline.functions import circular

    got = phases.groupBy(by).agg(
        F.count(phase).alias("n"), circular.circular_mean(F.col(phase)).alias("mean"), circular.circular_std(F.col(phase)).alias("std"), circular.resultant(F.col(phase)).alias("r")
    )
    return got.withColumn("p", circular.rayleigh_p(F.col("r"), F.col("n")))


def spike_phases(samples: DataFrame, at: DataFrame, key: str | None, time: str, phase: str, mask: str | None = None, bucket: float | None = None, n_bins: int = 36) -> DataFrame:
    """(key, bin, centre, n): histogram of the phase of the sample nearest to each event; events outside the samples, or where the mask is false, do not count."""
    from driftline.functions.circular import phase_bin
    from driftline.operators.preprocessing import beside

    found = beside(samples, at, key, time, [phase, *([mask] if mask else [])], bucket).filter("before IS NOT NULL AND after IS NOT NULL")
    near = F.when(F.col(time) - F.col("before.time") <= F.col("after.time") - F.col(time), F.col("before")).otherwise(F.col("after"))
    found = found.withColumn("__near", near)
    if mask:
        found = found.filter(F.col(f"__near.{mask}"))
    bins = found.select(*([key] if key else []), phase_bin(F.col(f"__near.{phase}"), n_bins).alias("bin")).filter("bin IS NOT NULL")
    centre = -math.pi + (F.col("bin") + 0.5) * (2 * math.pi / n_bins)
    return bins.groupBy(*([key] if key else []), "bin").agg(F.count("*").alias("n")).withColumn("centre", centre)


def recovery(rows: DataFrame, truth: str, found: str, by: str | None = None) -> DataFrame:
    """(by, correlation, rmse, variance_ratio) of estimates against what they estimate; null where the truth does not vary."""
    t, f = F.col(truth), F.col(found)
    got = rows.groupBy(*([by] if by else [])).agg(
        F.when((F.stddev_pop(t) > 0) & (F.stddev_pop(f) > 0), F.corr(t, f)).alias("correlation"), F.sqrt(F.avg((f - t) ** 2)).alias("rmse"),
        F.when(F.var_pop(t) > 0, F.var_pop(f) / F.var_pop(t)).alias("variance_ratio"),
    )
    return got


def circular_correlation(rows: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """(by, r): correlation of two phases about their circular means, 0 where the denominator is below 1e-10."""
    from driftline.functions.circular import circular_mean

    means = rows.groupBy(by).agg(circular_mean(F.col(a)).alias("__a"), circular_mean(F.col(b)).alias("__b"))
    x, y = F.sin(F.col(a) - F.col("__a")), F.sin(F.col(b) - F.col("__b"))
    got = rows.join(means, by).groupBy(by).agg(F.sum(x * y).alias("__n"), F.sqrt(F.sum(x * x) * F.sum(y * y)).alias("__d"))
    return got.select(by, F.when(F.col("__d") < 1e-10, 0.0).otherwise(F.col("__n") / F.col("__d")).alias("r"))


def trial_comparisons(smoothed: DataFrame, key: str = "series_id", reference: int | None = None) -> DataFrame:
    """(key, i, j, z, p): chance that the state of trial i exceeds that of trial j > i, and its place z on the normal scale, from m, v and the smoother's gain g (toward the next trial).

    Cov(x_i, x_j) is the product of the gains from i to j - 1 times v_j, taken as a difference of
    running sums of logs. With a reference only that trial i is compared, a row for each later one. In full
    the result has a row for each pair of trials, so only short series should be.
    """
    own = Window.partitionBy(key).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    upto = smoothed.withColumn("__g", F.coalesce(F.sum(F.ln(F.greatest("g", F.lit(1e-300)))).over(own), F.lit(0.0)))
    a = upto.select(key, F.col("t").alias("i"), F.col("m").alias("mi"), F.col("v").alias("vi"), F.col("__g").alias("gi"))
    b = upto.select(key, F.col("t").alias("j"), F.col("m").alias("mj"), F.col("v").alias("vj"), F.col("__g").alias("gj"))
    from driftline.functions.links import normal_cdf

    cov = F.exp(F.col("gj") - F.col("gi")) * F.col("vj")
    spread = F.sqrt(F.greatest(F.col("vi") + F.col("vj") - 2 * cov, F.lit(TINY)))
    pairs = (a if reference is None else a.filter(F.col("i") == reference)).join(b, key).filter("i < j")
    return pairs.select(key, "i", "j", ((F.col("mi") - F.col("mj")) / spread).alias("z")).withColumn("p", normal_cdf(F.col("z")))
