"""Event and behaviour preparation: bins, rates, runs, labels, interpolation, nearest lookups.

Columns are named by the caller; all rows are taken, nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def uniform_bin(time: Column, start: float, width: float, n_bins: int) -> Column:
    """Bin of a time: left-closed bins, the last one closed on both sides, null outside."""
    at = F.floor((time - start) / width)
    end = start + width * n_bins
    return F.when(time == end, n_bins - 1).when((time >= start) & (time < end), at).cast("int")


def edge_bin(time: Column, edges: Sequence[float]) -> Column:
    """The same for any rising edges, by binary search over their literal array."""
    xs = F.array(*[F.lit(float(e)) for e in edges])
    n = len(edges) - 1
    steps = max(1, n.bit_length())
    # lo: last edge at or below the time, found by halving
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")),
        lambda s, _: F.struct(
            F.when(F.get(xs, F.floor((s["lo"] + s["hi"]) / 2).cast("int")) <= time, F.floor((s["lo"] + s["hi"]) / 2)).otherwise(s["lo"]).cast("int").alias("lo"),
            F.when(F.get(xs, F.floor((s["lo"] + s["hi"]) / 2).cast("int")) <= time, s["hi"]).otherwise(F.floor((s["lo"] + s["hi"]) / 2)).cast("int").alias("hi"),
        ),
        lambda s: s["lo"],
    )
    inside = (time >= float(edges[0])) & (time <= float(edges[-1]))
    return F.when(inside, F.least(found, F.lit(n - 1))).cast("int")


def bin_counts(spikes: DataFrame, start: float, width: float, n_bins: int, key: str = "unit_id", time: str = "spike_time") -> DataFrame:
    """(key, bin, n): spikes of each unit and bin that has any; those outside the bins are dropped."""
    return (
        spikes.select(key, uniform_bin(F.col(time), start, width, n_bins).alias("bin"))
        .filter("bin IS NOT NULL")
        .groupBy(key, "bin")
        .agg(F.count("*").alias("n"))
    )


def dropped(spikes: DataFrame, start: float, end: float, time: str = "spike_time") -> DataFrame:
    """One row: how many spikes lie outside [start, end]."""
    return spikes.agg(F.count_if(~F.col(time).between(start, end)).alias("n_dropped"))


def dense_counts(counts: DataFrame, n_bins: int, key: str = "unit_id") -> DataFrame:
    """counts with a 0 for each bin of a unit without spikes; a row per unit is exploded, nothing is joined crosswise."""
    units = counts.select(key).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    return units.join(counts, [key, "bin"], "left").select(key, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def firing_rates(spikes: DataFrame, start: float | None = None, end: float | None = None, key: str = "unit_id", time: str = "spike_time") -> DataFrame:
    """(key, rate): spikes within [start, end] over its length; by default from the first spike of all to the last.

    A unit without spikes in the window, or a window without length, has rate 0.
    """
    bounds = spikes.agg(
        F.lit(start).cast("double").alias("__a") if start is not None else F.min(time).alias("__a"),
        F.lit(end).cast("double").alias("__b") if end is not None else F.max(time).alias("__b"),
    )
    inside = F.col(time).between(F.col("__a"), F.col("__b"))
    length = F.first("__b") - F.first("__a")
    return (
        spikes.join(F.broadcast(bounds))  # one row
        .groupBy(key)
        .agg(F.when(length > 0, F.count_if(inside) / length).otherwise(F.lit(0.0)).alias("rate"))
    )


def select_units(spikes: DataFrame, least: float = 0.0, most: float = float("inf"), **window) -> DataFrame:
    """The spikes of units whose rate lies in [least, most]."""
    key = window.get("key", "unit_id")
    kept = firing_rates(spikes, **window).filter(F.col("rate").between(least, most)).select(key)
    return spikes.join(kept, key, "left_semi")


def unit_subset(spikes: DataFrame, units: Sequence, key: str = "unit_id") -> DataFrame:
    return spikes.filter(F.col(key).isin(list(units)))


def clip_window(spikes: DataFrame, start: float, end: float, time: str = "spike_time") -> DataFrame:
    """Spikes within [start, end], both ends included."""
    return spikes.filter(F.col(time).between(start, end))


def unbin(counts: DataFrame, start: float, width: float, key: str = "unit_id") -> DataFrame:
    """(key, spike_time): the left edge of each bin, as often as it has spikes."""
    each = F.explode(F.array_repeat(F.lit(start) + F.col("bin") * width, F.col("n").cast("int")))
    return counts.filter("n > 0").select(key, each.alias("spike_time"))


def runs(series: DataFrame, inside: Column, key: str, order: str) -> DataFrame:
    """(key, start, end, length): maximal runs of neighbouring rows where `inside` holds; end exclusive, in the order column."""
    own = Window.partitionBy(key).orderBy(order)
    flagged = series.select(key, F.col(order).alias("__t"), F.coalesce(inside, F.lit(False)).alias("__in"))
    own = Window.partitionBy(key).orderBy("__t")
    edge = F.col("__in") & ~F.coalesce(F.lag("__in").over(own), F.lit(False))
    return (
        flagged.withColumn("__run", F.sum(edge.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
        .filter("__in")
        .groupBy(key, "__run")
        .agg(F.min("__t").alias("start"), (F.max("__t") + 1).alias("end"), F.count("*").alias("length"))
        .drop("__run")
    )


def bouts(series: DataFrame, threshold: float, least: int, above: bool = True, key: str = "series_id", order: str = "t", column: str = "y") -> DataFrame:
    """Runs strictly above (or below) the threshold of at least so many rows."""
    inside = F.col(column) > threshold if above else F.col(column) < threshold
    return runs(series, inside, key, order).filter(F.col("length") >= least)


def behaviour_label(speed: Column, running: float = 5.0, immobility: float = 2.0) -> Column:
    """0 below the one threshold, else 1 above the other, else 2."""
    return F.when(speed < immobility, 0).when(speed > running, 1).otherwise(2)


#: Cells whose ends are looked over together.
CELLS = 1024


def _ends_beside(ends: DataFrame, keys: list[str], cells: int | None = None) -> DataFrame:
    """(keys, __cell, __b, __a): the last sample of the cells before each and the first of those after, from ends (keys, __cell, __top, __low).

    Cells are looked over in groups of CELLS, and groups by the same plan, so that no task has more than so many
    rows of a key, or of all rows without one.
    """
    if cells is None:  # cells are numbered from 0, so that groups of groups become one
        first, last = ends.agg(F.min("__cell"), F.max("__cell")).first()
        first, last = first or 0, last or 0
        return _ends_beside(ends.withColumn("__cell", F.col("__cell") - first), keys, last - first + 1).withColumn("__cell", F.col("__cell") + first)
    rows = ends.withColumn("__up", F.floor(F.col("__cell") / CELLS).cast("long"))
    own = Window.partitionBy(*keys, "__up")
    earlier = own.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    later = own.orderBy(F.desc("__cell")).rowsBetween(Window.unboundedPreceding, -1)
    held = rows.select(*keys, "__cell", "__up", F.last("__top", ignorenulls=True).over(earlier).alias("__b"), F.last("__low", ignorenulls=True).over(later).alias("__a"))
    if cells > CELLS:
        ups = rows.groupBy(*keys, "__up").agg(F.max("__top").alias("__top"), F.min("__low").alias("__low")).withColumnRenamed("__up", "__cell")
        above = _ends_beside(ups, keys, -(-cells // CELLS)).select(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)], F.col("__cell").alias("__of"), F.col("__b").alias("__ub"), F.col("__a").alias("__ua"))
        same = F.col("__up") == F.col("__of")
        for n, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"__k{n}"))
        held = held.join(above, same).withColumns({"__b": F.coalesce("__b", "__ub"), "__a": F.coalesce("__a", "__ua")})
    return held.select(*keys, "__cell", "__b", "__a")


def with_neighbours(samples: DataFrame, key: str | None, time: str, value: str, bucket: float | None) -> DataFrame:
    """samples with __prev and __next, the samples (time, v) before and after each.

    Within a key they are looked for in one window; without one, by stretches of `bucket` time units.
    """
    keys, bucket = [key] if key else [], None if key else bucket
    cell = F.floor(F.col(time) / bucket).cast("long") if bucket else F.lit(0).cast("long")
    rows = samples.withColumn("__cell", cell).withColumn("__own", F.struct(F.col(time).alias("time"), F.col(value).alias("v")))
    own = Window.partitionBy(*keys, "__cell").orderBy(time)
    rows = rows.withColumns({"__prev": F.lag("__own").over(own), "__next": F.lead("__own").over(own)})
    if not bucket:
        return rows.drop("__cell", "__own")
    ends = rows.groupBy(*keys, "__cell").agg(F.max("__own").alias("__top"), F.min("__own").alias("__low"))
    joined = rows.join(_ends_beside(ends, keys), "__cell").withColumns({"__prev": F.coalesce("__prev", "__b"), "__next": F.coalesce("__next", "__a")})
    return joined.select(*samples.columns, "__prev", "__next")


def beside(samples: DataFrame, at: DataFrame, key: str | None, time: str, values: Sequence[str], bucket: float | None = None) -> DataFrame:
    """Rows of `at` with the samples just before (or at) and just after (or at) them.

    Adds structs `before` and `after` (time and values). Both tables are parted by key and by
    stretches of `bucket` time units, and a stretch takes over the last sample of the ones
    before it from a table of one row per stretch, so that a long series is many tasks.
    """
    keys = [key] if key else []
    cell = F.floor(F.col(time) / bucket).cast("long") if bucket else F.lit(0).cast("long")
    held = F.struct(F.col(time).alias("time"), *[F.col(v) for v in values])
    kind = samples.select(*keys, time, *values).schema
    rest = [c for c in at.columns if c != time and c not in keys]
    left = samples.select(*keys, F.col(time).alias("__time"), cell.alias("__cell"), held.alias("__held"), F.lit(None).alias("__row"), F.lit(0).alias("__side"))
    right = at.select(*keys, F.col(time).alias("__time"), cell.alias("__cell"), F.lit(None).alias("__held"), F.struct(time, *rest).alias("__row"), F.lit(1).alias("__side"))
    del kind
    both = left.unionByName(right)
    group = [*keys, "__cell"]
    ahead = Window.partitionBy(*group).orderBy("__time", "__side").rowsBetween(Window.unboundedPreceding, 0)
    # backwards, a sample at the time of a row comes before it as well
    back = Window.partitionBy(*group).orderBy(F.desc("__time"), "__side").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("before", F.last("__held", ignorenulls=True).over(ahead)).withColumn("after", F.last("__held", ignorenulls=True).over(back))
    near = near.filter("__row IS NOT NULL").select(*keys, "__cell", "__row", "before", "after")
    if bucket:
        ends = both.groupBy(*group).agg(F.max("__held").alias("__top"), F.min("__held").alias("__low"))
        near = near.join(_ends_beside(ends, keys), group).withColumn("before", F.coalesce("before", "__b")).withColumn("after", F.coalesce("after", "__a"))
    return near.select(*keys, "__row.*", "before", "after")


def nearest(samples: DataFrame, at: DataFrame, key: str | None, time: str, value: str, bucket: float | None = None) -> DataFrame:
    """Rows of `at` with the value of the sample nearest in time, the earlier one at a tie; rows outside the samples' times are dropped."""
    found = beside(samples, at, key, time, [value], bucket).filter("before IS NOT NULL AND after IS NOT NULL")
    left = F.col(time) - F.col("before.time") <= F.col("after.time") - F.col(time)
    return found.withColumn(value, F.when(left, F.col(f"before.{value}")).otherwise(F.col(f"after.{value}"))).drop("before", "after")


def interpolate(samples: DataFrame, at: DataFrame, key: str | None, time: str, value: str, kind: str = "linear", bucket: float | None = None) -> DataFrame:
    """Rows of `at` with `value` taken between the samples beside them: linear, cubic or nearest; beyond the ends the last piece goes on.

    Samples need distinct times within a key. cubic: a spline without knots at the second and the last but one
    sample of a key; null with fewer than four samples.
    """
    if kind == "cubic":
        return _cubic(samples, at, key, time, value, bucket)
    if kind not in ("linear", "nearest"):
        raise ValueError(f"unknown kind: {kind}")
    # each sample knows its neighbours, so that a row beyond the ends still finds two
    known = with_neighbours(samples, key, time, value, bucket)
    found = beside(known, at, key, time, [value, "__prev", "__next"], bucket)
    t0 = F.coalesce("before.time", "after.time")
    v0 = F.coalesce(F.col(f"before.{value}"), F.col(f"after.{value}"))
    inside = F.col("before").isNotNull() & F.col("after").isNotNull()
    if kind == "nearest":
        left = F.col("after").isNull() | (F.col(time) - F.col("before.time") <= F.col("after.time") - F.col(time))
        return found.withColumn(value, F.when(left, F.coalesce(F.col(f"before.{value}"), v0)).otherwise(F.col(f"after.{value}"))).drop("before", "after")
    t1 = F.when(inside, F.col("after.time")).otherwise(F.coalesce("before.__prev.time", "after.__next.time"))
    v1 = F.when(inside, F.col(f"after.{value}")).otherwise(F.coalesce("before.__prev.v", "after.__next.v"))
    line = F.when(t1 == t0, v0).otherwise(v0 + (v1 - v0) * (F.col(time) - t0) / (t1 - t0))
    return found.withColumn(value, F.coalesce(line, v0)).drop("before", "after")


def second_derivatives(samples: DataFrame, key: str | None, time: str, value: str) -> DataFrame:
    """(key, __n, time, value, __m): samples numbered by time, with the spline's second derivative at each; null with fewer than four.

    The three-term system is eliminated forward and solved backward, a row at a time.
    """
    from driftline.plans.fold import fold

    named = key or "__key"
    rows = samples.select(F.col(key).alias(named) if key else F.lit(0).alias(named), F.col(time).cast("double").alias("__t"), F.col(value).cast("double").alias("__y"))
    own = Window.partitionBy(named).orderBy("__t")
    rows = rows.withColumn("__n", F.row_number().over(own).cast("long"))
    h0, h1 = F.col("__t") - F.lag("__t").over(own), F.lead("__t").over(own) - F.col("__t")
    slope = (F.lead("__y").over(own) - F.col("__y")) / h1 - (F.col("__y") - F.lag("__y").over(own)) / h0
    inner = rows.withColumns({"h0": h0, "h1": h1, "rhs": 6 * slope, "first": F.lag("__t", 2).over(own).isNull(), "final": F.lead("__t", 2).over(own).isNull()})
    inner = inner.filter("h0 IS NOT NULL AND h1 IS NOT NULL")
    both = F.col("h0") + F.col("h1")
    diagonal = 2 * both + F.when(F.col("first"), F.col("h0") * both / F.col("h1")).otherwise(0) + F.when(F.col("final"), F.col("h1") * both / F.col("h0")).otherwise(0)
    lower = F.when(F.col("first"), 0.0).when(F.col("final"), F.col("h0") - F.col("h1") ** 2 / F.col("h0")).otherwise(F.col("h0"))
    upper = F.when(F.col("final"), 0.0).when(F.col("first"), F.col("h1") - F.col("h0") ** 2 / F.col("h1")).otherwise(F.col("h1"))
    system = inner.select(named, "__n", lower.alias("low"), diagonal.alias("mid"), upper.alias("up"), "rhs")

    def start(n):
        return {"c": np.zeros(n), "d": np.zeros(n)}

    def ahead(s, x, fresh):
        under = x["mid"] - x["low"] * s["c"]
        c, d = x["up"] / under, (x["rhs"] - x["low"] * s["d"]) / under
        return {"c": c, "d": d}, {"c": c, "d": d}

    def back(s, x, fresh):
        m = x["d"] - x["c"] * s["m"]
        return {"m": m}, {"m": m}

    swept = fold(system, named, "__n", start, ahead, {"c": 0, "d": 0}, ["low", "mid", "up", "rhs"])
    solved = fold(swept, named, "__n", lambda n: {"m": np.zeros(n)}, back, {"m": 0}, ["c", "d"], backward=True)
    got = rows.join(solved, [named, "__n"], "left")
    own = Window.partitionBy(named).orderBy("__n")
    step = lambda a, b: F.lead("__t", b).over(own) - (F.lead("__t", a).over(own) if a else F.col("__t"))
    first = ((step(0, 1) + step(1, 2)) * F.lead("m").over(own) - step(0, 1) * F.lead("m", 2).over(own)) / step(1, 2)
    down = lambda a, b: (F.lag("__t", a).over(own) if a else F.col("__t")) - F.lag("__t", b).over(own)
    last = ((down(0, 1) + down(1, 2)) * F.lag("m").over(own) - down(0, 1) * F.lag("m", 2).over(own)) / down(1, 2)
    whole = F.count("*").over(Window.partitionBy(named)) >= 4
    made = F.when(F.col("__n") == 1, first).when(F.lead("__t").over(own).isNull(), last).otherwise(F.col("m"))
    return got.select(*([named] if key else []), "__n", F.col("__t").alias(time), F.col("__y").alias(value), F.when(whole, made).alias("__m"))


def _cubic(samples, at, key, time, value, bucket):
    known = second_derivatives(samples, key, time, value)
    own = Window.partitionBy(*([key] if key else [])).orderBy("__n")
    here = F.struct(F.col(time).alias("t0"), F.col(value).alias("y0"), F.col("__m").alias("m0"))
    pair = F.struct(here.alias("a"), F.lead(here).over(own).alias("b"))
    before = F.struct(F.lag(here).over(own).alias("a"), here.alias("b"))
    known = known.withColumn("__piece", F.when(F.lead(time).over(own).isNotNull(), pair).otherwise(before))
    found = beside(known, at, key, time, ["__piece"], bucket).withColumn("__p", F.coalesce("before.__piece", "after.__piece"))
    a, b, t = F.col("__p.a"), F.col("__p.b"), F.col(time)
    h = b["t0"] - a["t0"]
    left, right = b["t0"] - t, t - a["t0"]
    curve = (a["m0"] * left**3 + b["m0"] * right**3) / (6 * h) + (a["y0"] / h - a["m0"] * h / 6) * left + (b["y0"] / h - b["m0"] * h / 6) * right
    return found.withColumn(value, curve).drop("before", "after", "__p")
