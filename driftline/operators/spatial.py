"""Places: occupancy and rate maps, spline fields that drift, position decoders, graph bases."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from driftline.operators.matrices import log_det, mv, psd_solve, symmetric, transposed, vec_solve
from driftline.operators.point_process import Counts, poisson
from driftline.plans.fold import fold, to_numpy, totals

#: Cells of all units' maps, and bins of an environment, that the driver may hold.
MOST_CELLS, MOST_BINS = 20_000_000, 4000

# ---------------------------------------------------------------- maps


def occupancy(track: DataFrame, edges_x: tuple[float, float, int], edges_y: tuple[float, float, int], dt: float, x: str = "x", y: str = "y") -> DataFrame:
    """(ix, iy, occ): seconds in each visited cell of a grid given as (low, high, cells); the last cells are closed."""
    return _gridded(track, edges_x, edges_y, x, y).groupBy("ix", "iy").agg((F.count("*") * dt).alias("occ"))


def spike_map(track: DataFrame, edges_x, edges_y, count: str = "n", by: str = "unit_id", x: str = "x", y: str = "y") -> DataFrame:
    """(by, ix, iy, spikes) of rows with counts."""
    return _gridded(track, edges_x, edges_y, x, y).groupBy(by, "ix", "iy").agg(F.sum(count).alias("spikes"))


def _gridded(track, edges_x, edges_y, x, y):
    from driftline.operators.preprocessing import uniform_bin

    cell = lambda c, e: uniform_bin(F.col(c), e[0], (e[1] - e[0]) / e[2], e[2])
    return track.withColumn("ix", cell(x, edges_x)).withColumn("iy", cell(y, edges_y)).filter("ix IS NOT NULL AND iy IS NOT NULL")


def shrunk_rates(spikes: DataFrame, occ: DataFrame, tau: float, baseline: DataFrame, by: str = "unit_id") -> DataFrame:
    """(by, ix, iy, rate): (spikes + w * base) / (occ + w), w being tau times the median positive occupancy; the base where that is empty."""
    middle = occ.filter("occ > 0").agg((F.coalesce(F.median("occ"), F.lit(0.0)) * tau).alias("__w"))
    grid = baseline.select(by, "base").join(F.broadcast(occ)).join(F.broadcast(middle))  # the grid's cells, and one row
    full = grid.join(spikes, [by, "ix", "iy"], "left").fillna(0, ["spikes"])
    top, under = F.col("spikes") + F.col("__w") * F.col("base"), F.col("occ") + F.col("__w")
    return full.select(by, "ix", "iy", F.when(under > 0, top / under).otherwise(F.col("base")).alias("rate"))


def smoothed_map(cells: DataFrame, value: str, sigma: float, n: tuple[int, int], by: Sequence[str] = (), reach: float = 4.0) -> DataFrame:
    """(by, ix, iy, value): Gaussian kernel of sigma cells, normalised at the borders; each cell is spread to its neighbours within reach."""
    r = max(1, int(reach * sigma + 0.5))
    near = F.explode(F.sequence(F.lit(-r), F.lit(r)))
    spread = cells.withColumn("__dx", near).withColumn("__dy", near)
    weight = lambda d: F.exp(-(F.col(d) ** 2) / (2 * sigma**2))
    moved = spread.select(*by, (F.col("ix") + F.col("__dx")).alias("ix"), (F.col("iy") + F.col("__dy")).alias("iy"), (F.col(value) * weight("__dx") * weight("__dy")).alias("__v"))
    inside = (F.col("ix").between(0, n[0] - 1)) & (F.col("iy").between(0, n[1] - 1))
    total = float(np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma**2)).sum()) ** 2
    return moved.filter(inside).groupBy(*by, "ix", "iy").agg((F.sum("__v") / total).alias(value))


def centroid(rates: DataFrame, by: str = "unit_id", x: str = "x", y: str = "y", rate: str = "rate") -> DataFrame:
    """(by, cx, cy): rate-weighted middle."""
    w = F.sum(rate)
    return rates.groupBy(by).agg((F.sum(F.col(rate) * F.col(x)) / w).alias("cx"), (F.sum(F.col(rate) * F.col(y)) / w).alias("cy"))


def drift(rates: DataFrame, by: str = "unit_id", block: str = "block", x: str = "x", y: str = "y", rate: str = "rate") -> DataFrame:
    """(by, blocks, total, path, peak): distance of the first and last block's middles, length of the way over all, and the largest rate.

    A block whose rates sum to 0 has the plain middle of its places.
    """
    w = F.sum(rate)
    middle = lambda c: F.when(w > 0, F.sum(F.col(rate) * F.col(c)) / w).otherwise(F.avg(c))
    blocks = rates.groupBy(by, block).agg(middle(x).alias("cx"), middle(y).alias("cy"), F.max(rate).alias("peak"))
    own = Window.partitionBy(by).orderBy(block)
    stepped = blocks.withColumn("step", F.hypot(F.col("cx") - F.lag("cx").over(own), F.col("cy") - F.lag("cy").over(own)))
    ends = lambda f, c: f(c, block)
    got = stepped.groupBy(by).agg(
        F.count("*").alias("blocks"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("path"), F.max("peak").alias("peak"),
        *[ends(f, c).alias(n) for n, f, c in (("ax", F.min_by, "cx"), ("ay", F.min_by, "cy"), ("bx", F.max_by, "cx"), ("by_", F.max_by, "cy"))],
    )
    return got.select(by, "blocks", F.hypot(F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay")).alias("total"), "path", "peak")


def grid(low: tuple[float, float], high: tuple[float, float], n: int = 50) -> np.ndarray:
    """(n * n, 2) places at even steps, x running fastest."""
    X, Y = np.meshgrid(np.linspace(low[0], high[0], n), np.linspace(low[1], high[1], n))
    return np.column_stack([X.ravel(), Y.ravel()])


def knots_for_width(width: float, range_x: tuple[float, float], range_y: tuple[float, float]) -> int:
    """Inner knots of each coordinate for fields of that width: three to a field, over the mean extent, three at least."""
    extent = (range_x[1] - range_x[0] + range_y[1] - range_y[0]) / 2
    return max(3, int(np.round(extent / (width / 3))))


def score(rows: DataFrame, model: Counts, key: str = "series_id", order: str = "t") -> DataFrame:
    """One row, ll: log likelihood of held-out rows with their design under a fitted field, without smoothing."""
    from driftline.operators.point_process import filtered

    return filtered(rows, model, key, order).agg(F.sum("ll").alias("ll"))


# ---------------------------------------------------------------- splines


@dataclass(frozen=True)
class Spline:
    """Cubic B-splines over two coordinates, multiplied; positions are held within the knots' ends."""

    knots_x: np.ndarray
    knots_y: np.ndarray
    low: tuple[float, float]
    high: tuple[float, float]

    @property
    def size(self) -> int:
        return (len(self.knots_x) + 3) * (len(self.knots_y) + 3)

    def evaluate(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """(rows, size), without the first function of each coordinate."""
        bx = _cubic(np.clip(x, self.low[0], self.high[0]), self.knots_x, self.low[0], self.high[0])[:, 1:]
        by = _cubic(np.clip(y, self.low[1], self.high[1]), self.knots_y, self.low[1], self.high[1])[:, 1:]
        return (bx[:, :, None] * by[:, None, :]).reshape(len(x), -1)


def _cubic(x: np.ndarray, inner: np.ndarray, low: float, high: float) -> np.ndarray:
    """All cubic B-splines at x by the recursion over degrees."""
    t = np.concatenate([[low] * 4, inner, [high] * 4])
    b = ((x[:, None] >= t[None, :-1]) & (x[:, None] < t[None, 1:])).astype(float)
    last = np.flatnonzero(t[:-1] < t[1:])[-1]
    b[x >= high] = 0
    b[x >= high, last] = 1
    for k in range(1, 4):
        n = len(t) - k - 1
        left = t[k : k + n] - t[:n]
        right = t[k + 1 : k + 1 + n] - t[1 : n + 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            u = np.where(left > 0, (x[:, None] - t[:n]) / left, 0)
            v = np.where(right > 0, (t[k + 1 : k + 1 + n] - x[:, None]) / right, 0)
        b = u * b[:, :n] + v * b[:, 1 : n + 1]
    return b


def spline_basis(track: DataFrame, n_knots: int = 5, x: str = "x", y: str = "y") -> Spline:
    """Inner knots at even quantiles from 5 to 95 per cent of all positions, exact ones."""
    from driftline.operators.statistics import quantiles

    at = np.linspace(0.05, 0.95, n_knots).tolist()
    r = track.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    return Spline(np.unique(quantiles(track, x, at)), np.unique(quantiles(track, y, at)), (r[0], r[1]), (r[2], r[3]))


def with_design(track: DataFrame, basis: Spline, x: str = "x", y: str = "y", into: str = "z") -> DataFrame:
    """Adds the row's spline values, with a 1 in front."""
    rest = [c for c in track.columns if c != into]
    schema = T.StructType([*[track.schema[c] for c in rest], T.StructField(into, T.ArrayType(T.DoubleType()))])

    def run(batches):
        from driftline.plans.fold import to_arrow

        for b in batches:
            z = basis.evaluate(to_numpy(b.column(x)), to_numpy(b.column(y)))
            z = np.concatenate([np.ones((len(z), 1)), z], axis=1)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], to_arrow(z, pa.list_(pa.float64()))], names=schema.names)

    return track.select(*rest).mapInArrow(run, schema)


def stationary_field(rows: DataFrame, dt: float, size: int, ridge: float = 1.0, max_iter: int = 15, y: str = "n", z: str = "z") -> tuple[np.ndarray, np.ndarray]:
    """Weights and covariance of a ridge Poisson regression on the design, one job a Newton step."""
    s0 = totals(rows, [y, z], lambda x: {"zz": x[z].T @ x[z], "z1": x[z].sum(0), "n": np.array([len(x[y]), x[y].sum()], float)})
    eye = ridge * np.eye(size)
    w = np.log((s0["n"][1] + 1) / s0["n"][0] / dt) * np.linalg.solve(s0["zz"] + eye, s0["z1"])
    for _ in range(max_iter):
        def make(x, w=w):
            mu = np.exp(np.clip(x[z] @ w + np.log(dt), -20, 20))
            return {"g": x[z].T @ (x[y] - mu), "h": np.einsum("n,na,nb->ab", mu, x[z], x[z])}

        s = totals(rows, [y, z], make)
        move = np.linalg.solve(s["h"] + eye, s["g"] - ridge * w)
        w = w + move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    return w, np.linalg.inv(s["h"] + eye)


def place_field_model(rows: DataFrame, dt: float, size: int, noise: float = 1e-6, spread: float = 0.01) -> Counts:
    """A drifting field begun at the stationary regression's weights."""
    w, cov = stationary_field(rows, dt, size)
    return Counts(np.eye(size), noise * np.eye(size), w, spread * np.eye(size) + cov, dt)


def rate_map(smoothed_rows: DataFrame, basis: Spline, grid: np.ndarray, key: str = "unit_id", order: str = "t", slices: int = 1, length: int = 1, z: float = 1.96) -> DataFrame:
    """(key, block, place, rate, low, high): time averages of the field's mean and bounds at grid points, by stretches of `length` rows.

    Partial sums of a task have a row for each series, block and grid point.
    """
    Z = np.concatenate([np.ones((len(grid), 1)), basis.evaluate(grid[:, 0], grid[:, 1])], axis=1)
    schema = T.StructType([smoothed_rows.schema[key], *[T.StructField(c, k) for c, k in (("block", T.LongType()), ("place", T.LongType()), ("n", T.LongType()), ("rate", T.DoubleType()), ("low", T.DoubleType()), ("high", T.DoubleType()))]])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            m, P = to_numpy(b.column("ms")), to_numpy(b.column("Vs"))
            eta, v = m @ Z.T, np.einsum("ga,nab,gb->ng", Z, P, Z)
            sd = np.sqrt(np.maximum(v, 0))
            block = np.minimum(b.column(order).to_numpy(zero_copy_only=False) // length, slices - 1)
            groups: dict = {}
            for i, g in enumerate(zip(b.column(key).to_pylist(), block.tolist())):
                groups.setdefault(g, []).append(i)
            for (u, k), at in groups.items():
                n = len(Z)
                values = [np.exp(eta[at] + s).sum(0) for s in (v[at] / 2, -z * sd[at], z * sd[at])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([u] * n, b.column(key).type), pa.array([int(k)] * n), pa.array(np.arange(n)), pa.array([len(at)] * n), *[pa.array(x) for x in values]], names=schema.names
                )

    part = smoothed_rows.select(key, order, "ms", "Vs").mapInArrow(run, schema)
    total = F.sum("n")
    return part.groupBy(key, "block", "place").agg(*[(F.sum(c) / total).alias(c) for c in ("rate", "low", "high")])


def stationary_fields(track: DataFrame, basis: Spline, units: Sequence, dt: float, ridge: float = 1.0, max_iter: int = 15, unit: str = "unit_id", x: str = "x", y: str = "y") -> tuple[np.ndarray, np.ndarray]:
    """Weights (units, size) and covariances of each unit's stationary_field, one job a Newton step for all of them.

    Rows of the track are spikes of the unit that they name; the design is made from the position and never stored.
    """
    size, each = basis.size + 1, np.asarray(units)
    design = lambda v: np.concatenate([np.ones((len(v[x]), 1)), basis.evaluate(v[x], v[y])], axis=1)
    counts = lambda v: (v[unit][:, None] == each).astype(float)

    def begin(v):
        z, n = design(v), counts(v)
        return {"zz": z.T @ z, "z1": z.sum(0), "n": np.array([len(z), *n.sum(0)], float)}

    s0 = totals(track, [unit, x, y], begin)
    eye = ridge * np.eye(size)
    w = np.log((s0["n"][1:, None] + 1) / s0["n"][0] / dt) * np.linalg.solve(s0["zz"] + eye, s0["z1"])
    h, going = np.zeros((len(each), size, size)), np.ones(len(each), bool)
    for _ in range(max_iter):
        own = np.flatnonzero(going)

        def make(v, w=w[own], own=own):
            z, n = design(v), counts(v)[:, own]
            mu = np.exp(np.clip(z @ w.T + np.log(dt), -20, 20))
            return {"g": (n - mu).T @ z, "h": np.stack([(z * m[:, None]).T @ z for m in mu.T])}

        s = totals(track, [unit, x, y], make)
        for k, g, now in zip(own, s["g"], s["h"]):
            h[k] = now
            move = np.linalg.solve(now + eye, g - ridge * w[k])
            w[k] = w[k] + move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-12))
            going[k] = not np.abs(move).max() < 1e-6
        if not going.any():
            break
    return w, np.linalg.inv(h + eye)


def drifting_maps(track: DataFrame, basis: Spline, models: dict[object, Counts], grid: np.ndarray, key: str = "series_id", order: str = "t", unit: str = "unit_id", x: str = "x", y: str = "y", z: float = 1.96, block: int = 128, room: int = 1 << 25) -> DataFrame:
    """(key, unit, place, rate, low, high): what filtered, smoothed and rate_map give for the fields of all units, in one pass.

    Rows are spikes of the unit that they name; orders are whole numbers. The track alone is shuffled, and the moments
    of a row never leave the task: blocks of so many orders are filtered and smoothed at once, a long series passes
    its state from block to block, and the state before a block is all that is stored. Updates of one count and one step
    change a covariance by rank one; smoothed moments come from the slopes of what follows, without another inverse.
    room: bytes of moments that a task holds at once.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    from driftline.plans import stretch
    from driftline.plans.fold import kind_of, to_arrow

    if any(m.steps != 1 for m in models.values()):
        raise ValueError("updates are of one step")
    each = np.array(list(models))
    A, Q, m0, P0 = (np.stack([np.asarray(getattr(m, c), float) for m in models.values()]) for c in ("A", "Q", "m0", "P0"))
    log_dt = np.log([m.dt for m in models.values()])
    still = bool((A == np.eye(A.shape[-1])).all())
    places = np.concatenate([np.ones((len(grid), 1)), basis.evaluate(grid[:, 0], grid[:, 1])], axis=1)
    n_units, d = m0.shape
    width = 8 * n_units * (d * d + 4 * d)

    packed = stretch.pack(track, key, order, [unit, x, y], block)
    many = packed.span > 1
    kind = packed.frame.schema["k"].dataType[key].dataType

    def ahead(m, V, x, n):
        """A row's prediction, and the moments after it."""
        pm, pv = (m, V + Q) if still else (mv(A, m), symmetric(A @ V @ transposed(A) + Q))
        Px = mv(pv, x[:, None])
        mu = np.exp(np.clip((pm * x[:, None]).sum(-1) + log_dt, -20, 20))
        c = 1 / (1 + mu * (Px * x[:, None]).sum(-1))
        off = (n - mu) * c
        return (pm, pv, (mu * c)[..., None] * Px, off, mu * c), pm + off[..., None] * Px, pv - ((mu * c)[..., None] * Px)[..., None] * Px[..., None, :]

    def back(r, N, x, seen):
        """Slope and curvature, in a row's prediction, of that row and all that follow, from those in the next prediction."""
        _, _, K, off, w = seen
        if not still:
            r, N = mv(transposed(A), r), symmetric(transposed(A) @ N @ A)
        x = np.broadcast_to(x[:, None], K.shape)
        NK = mv(N, K)
        r = r + (off - (K * r).sum(-1))[..., None] * x
        both = NK[..., None] * x[..., None, :]
        return r, N + (w + (K * NK).sum(-1))[..., None, None] * (x[..., None] * x[..., None, :]) - both - transposed(both)

    def ordered(batches, held):
        """(batch, places in it of one block of each series, keys, lengths, starts, design, counts), in the order of the pass.

        Rows come series by series, so of what is held only the first series of a batch can go on.
        """
        from driftline.plans.fold import _rounds

        for batch in stretch._chunks(batches, width, room):
            length, flat = stretch._fields(batch.column("items"))
            start = np.cumsum(length) - length
            inside = {c: to_numpy(pa.compute.struct_field(flat, c)) for c in (unit, x, y)}
            Z = np.concatenate([np.ones((len(flat), 1)), basis.evaluate(inside[x], inside[y])], axis=1)
            counts = (inside[unit][:, None] == each).astype(float)
            ids = batch.column("k").field(0).to_pylist()
            slot: dict = {}
            for i in [i for i in held if i != ids[0]]:
                del held[i]
            for own in _rounds(np.array([slot.setdefault(i, len(slot)) for i in ids])):
                yield batch, own, [ids[i] for i in own], length[own], start[own], Z, counts

    def passed(held, ids, begin):
        """State of each series: what its last block left, or `begin`."""
        return [np.stack([held[i][k] if i in held else b for i in ids]) for k, b in enumerate(begin)]

    def run_ahead(batches):
        held: dict = {}
        for batch, own, ids, length, start, Z, counts in ordered(batches, held):
            m, V = passed(held, ids, (m0, P0))
            sent = batch.take(pa.array(own))
            columns = [*sent.columns, *[to_arrow(v, k) for v, k in zip((m, V), moments)]]
            yield pa.RecordBatch.from_arrays(columns, names=[*sent.schema.names, "m", "V"])
            m, V = m.copy(), V.copy()
            for nth in range(int(length.max(initial=0))):
                on = np.flatnonzero(length > nth)
                _, m[on], V[on] = ahead(m[on], V[on], Z[start[on] + nth], counts[start[on] + nth])
            held |= {i: (m[k], V[k]) for k, i in enumerate(ids)}

    moments = [to_arrow_type(kind_of(k)) for k in (2, 3)]
    head = T.StructType([T.StructField(key, kind), T.StructField(unit, track.schema[unit].dataType), T.StructField("place", T.LongType()), T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("rate", "low", "high")]])
    sent = [to_arrow_type(f.dataType) for f in head]
    total = len(each) * len(places)

    def run(batches):
        held: dict = {}
        for batch, own, ids, length, start, Z, counts in ordered(batches, held):
            n, most = len(own), int(length.max(initial=0))
            if many:
                m, V = (to_numpy(batch.column(c).take(pa.array(own))) for c in ("m", "V"))
                m, V = m.copy(), V.copy()
            else:
                m, V = np.repeat(m0[None], n, 0), np.repeat(P0[None], n, 0)
            seen = []
            for nth in range(most):
                on = np.flatnonzero(length > nth)
                row, m[on], V[on] = ahead(m[on], V[on], Z[start[on] + nth], counts[start[on] + nth])
                seen.append(row)
            r, N = passed(held, ids, (np.zeros_like(m0), np.zeros_like(P0)))
            sums = np.zeros((3, n, n_units, len(places)))
            for nth in reversed(range(most)):
                on = np.flatnonzero(length > nth)
                row = seen.pop()
                r[on], N[on] = back(r[on], N[on], Z[start[on] + nth], row)
                B = places @ row[1]
                eta = row[0] @ places.T + mv(B, r[on])
                v = (B * places).sum(-1) - ((B @ N[on]) * B).sum(-1)
                sd = np.sqrt(np.maximum(v, 0))
                for k, off in enumerate((v / 2, -z * sd, z * sd)):
                    sums[k, on] += np.exp(eta + off)
            held |= {i: (r[k], N[k]) for k, i in enumerate(ids)}
            flat = [np.tile(np.repeat(each, len(places)), n), np.tile(np.arange(len(places)), n * n_units), np.repeat(length, total), *[v.ravel() for v in sums]]
            keys = pa.array([i for i in ids for _ in range(total)], sent[0])
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(v, k) for v, k in zip(flat, sent[1:])]], names=head.names)

    frame = packed.frame
    if many:
        more = T.StructType([*frame.schema.fields, T.StructField("m", kind_of(2)), T.StructField("V", kind_of(3))])
        frame = frame.repartition("k").sortWithinPartitions("k", "block").mapInArrow(run_ahead, more)
        frame = frame.repartition("k").sortWithinPartitions("k", F.desc("block"))
    part = frame.mapInArrow(run, head)
    rows = F.sum("n")
    if not many:
        return part.select(key, unit, "place", *[(F.col(c) / F.col("n")).alias(c) for c in ("rate", "low", "high")])
    return part.groupBy(key, unit, "place").agg(*[(F.sum(c) / rows).alias(c) for c in ("rate", "low", "high")])


# ---------------------------------------------------------------- decoding


@dataclass(frozen=True)
class Maps:
    """Log rates (units, nx, ny) on a grid of cell centres, and the visited cells."""

    log_rates: np.ndarray
    x: np.ndarray
    y: np.ndarray
    visited: np.ndarray | None = None

    def at(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log rates (rows, units) and their gradients (rows, units, 2) at positions, by bilinear interpolation, held at the borders."""
        dx, dy = self.x[1] - self.x[0], self.y[1] - self.y[0]
        fx = np.clip((p[:, 0] - self.x[0]) / dx, 0, len(self.x) - 1)
        fy = np.clip((p[:, 1] - self.y[0]) / dy, 0, len(self.y) - 1)
        i, j = np.minimum(fx.astype(int), len(self.x) - 2), np.minimum(fy.astype(int), len(self.y) - 2)
        u, v = (fx - i)[:, None], (fy - j)[:, None]
        c = [[self.log_rates[:, i + a, j + b].T for b in (0, 1)] for a in (0, 1)]
        value = (1 - u) * (1 - v) * c[0][0] + (1 - u) * v * c[0][1] + u * (1 - v) * c[1][0] + u * v * c[1][1]
        gx = ((1 - v) * (c[1][0] - c[0][0]) + v * (c[1][1] - c[0][1])) / dx
        gy = ((1 - u) * (c[0][1] - c[0][0]) + u * (c[1][1] - c[1][0])) / dy
        inside_x = ((p[:, 0] >= self.x[0]) & (p[:, 0] <= self.x[-1]))[:, None]
        inside_y = ((p[:, 1] >= self.y[0]) & (p[:, 1] <= self.y[-1]))[:, None]
        return value, np.stack([gx * inside_x, gy * inside_y], -1)


def maps_from(rates: DataFrame, edges_x, edges_y, units: Sequence, by: str = "unit_id", occ: DataFrame | None = None) -> Maps:
    """Gathers (by, ix, iy, rate): a number for each unit and cell, which is the decoder's own size."""
    n = {u: k for k, u in enumerate(units)}
    shape = (len(units), edges_x[2], edges_y[2])
    if int(np.prod(shape)) > MOST_CELLS:
        raise ValueError(f"maps of {shape} cells are more than a decoder broadcasts ({MOST_CELLS})")
    out = np.full(shape, np.log(1e-10))
    got = rates.filter(F.col(by).isin(list(units))).select(by, "ix", "iy", "rate").toArrow()
    unit = np.array([n[u] for u in got.column(0).to_pylist()], np.int64)
    x, y, rate = (got.column(k).to_numpy() for k in (1, 2, 3))
    out[unit, x, y] = np.log(np.maximum(rate, 1e-10))
    visited = None
    if occ is not None:
        visited = np.zeros(shape[1:], bool)
        seen = occ.filter("occ > 0").select("ix", "iy").toArrow()
        visited[seen.column(0).to_numpy(), seen.column(1).to_numpy()] = True
    centres = lambda e: e[0] + (np.arange(e[2]) + 0.5) * (e[1] - e[0]) / e[2]
    return Maps(out, centres(edges_x), centres(edges_y), visited)


def maps_of_fields(weights: np.ndarray, basis: Spline, low: tuple[float, float], high: tuple[float, float], n: int = 50) -> Maps:
    """Maps of fitted spline fields (units, 1 + size) on a grid, for decoding."""
    places = grid(low, high, n)
    Z = np.concatenate([np.ones((len(places), 1)), basis.evaluate(places[:, 0], places[:, 1])], axis=1)
    logs = (np.asarray(weights, float) @ Z.T).reshape(-1, n, n).swapaxes(1, 2)  # places run along x first
    return Maps(np.maximum(logs, np.log(1e-10)), np.linspace(low[0], high[0], n), np.linspace(low[1], high[1], n))


def motion(dt: float, q_pos: float = 100.0, q_vel: float = 10.0, velocity: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Transition and noise: a random walk of the position, or of a velocity that moves it."""
    if not velocity:
        return np.eye(2), q_pos * dt * np.eye(2)
    A = np.eye(4)
    A[0, 2] = A[1, 3] = dt
    Q = np.zeros((4, 4))
    for k in (0, 1):
        Q[k, k], Q[k, k + 2], Q[k + 2, k], Q[k + 2, k + 2] = q_vel * dt**3 / 3, q_vel * dt**2 / 2, q_vel * dt**2 / 2, q_vel * dt
    return A, Q


def track_penalty(maps: Maps, sigma: float) -> np.ndarray:
    """Half the squared distance to the nearest visited cell, in sigmas; cells times visited cells in slices."""
    X, Y = np.meshgrid(maps.x, maps.y, indexing="ij")
    px, py = X[maps.visited], Y[maps.visited]
    d = np.full(X.shape, np.inf)
    for k in range(0, len(px), 256):
        d = np.minimum(d, ((X[..., None] - px[k : k + 256]) ** 2 + (Y[..., None] - py[k : k + 256]) ** 2).min(-1))
    return 0.5 * d / sigma**2


def decoded(counts: DataFrame, maps: Maps, dt: float, A: np.ndarray, Q: np.ndarray, m0: np.ndarray, P0: np.ndarray, steps: int = 3, penalty: np.ndarray | None = None, gain: float = 0.0, most: float = 3.0, least_information: float = 1e-8, key: str = "series_id", order: str = "t", y: str = "counts") -> DataFrame:
    """(key, order, m, P, ll): position (and velocity) from arrays of counts, by Laplace steps on the maps' log rates.

    gain above 0 widens the prediction where the score is larger than the information allows.
    A penalty pulls toward the track. The first row is updated without a prediction.
    """
    d = len(m0)
    pen = None if penalty is None else Maps(penalty[None], maps.x, maps.y)

    def start(n):
        return {"m": np.repeat(np.asarray(m0, float)[None], n, 0), "V": np.repeat(np.asarray(P0, float)[None], n, 0)}

    def step(s, x, fresh):
        pm = np.where(fresh[:, None], s["m"], mv(A, s["m"]))
        pv = np.where(fresh[:, None, None], s["V"], symmetric(A @ s["V"] @ A.T + Q))
        n = x[y].astype(float)

        def local(at):
            eta, g = maps.at(at[:, :2])
            mu = np.exp(np.clip(eta + np.log(dt), -20, 20))
            J = np.zeros((len(at), g.shape[1], d))
            J[..., :2] = g
            return eta, mu, J

        if gain:
            _, mu, J = local(pm)
            info = transposed(J) @ (mu[..., None] * J)
            score = mv(transposed(J), n - mu)
            trace = np.trace(info, axis1=1, axis2=2)
            quad = (score * vec_solve(info + 1e-6 * np.eye(d), score)).sum(-1) / 2
            pv = pv * np.where(trace > least_information, np.clip(1 + gain * (quad - 1), 1, most), 1)[:, None, None]
        prec = psd_solve(pv, np.broadcast_to(np.eye(d), pv.shape))
        m = pm
        for _ in range(steps):
            _, mu, J = local(m)
            info = prec + transposed(J) @ (mu[..., None] * J)
            m = m + vec_solve(info, mv(transposed(J), n - mu) + mv(prec, pm - m))
        eta, mu, J = local(m)
        P = symmetric(psd_solve(prec + transposed(J) @ (mu[..., None] * J), np.broadcast_to(np.eye(d), pv.shape)))
        off = m - pm
        ll = poisson(dt).loglik(n, eta, mu).sum(-1) - 0.5 * (off * mv(prec, off)).sum(-1) - 0.5 * log_det(pv) + 0.5 * log_det(P)
        if pen is not None:
            v, g = pen.at(m[:, :2])
            v, full = v[:, 0], np.zeros((len(m), d))
            full[:, :2] = g[:, 0]
            Pg = mv(P, full)
            under = 2 * v + (full * Pg).sum(-1) + 1e-12
            m = m - Pg * (2 * v / under)[:, None]
            P = symmetric(P - Pg[:, :, None] * Pg[:, None, :] / under[:, None, None])
        return {"m": m, "V": P}, {"m": m, "V": P, "ll": ll}

    return fold(counts, key, order, start, step, {"m": 1, "V": 2, "ll": 0}, [y], [])


def kernel_log_rate(at: np.ndarray, where: np.ndarray, spikes: np.ndarray, weights: np.ndarray, sigma2: float, base: np.ndarray, tau: float) -> np.ndarray:
    """(rows, units) log rates from positions of an encoding set, shrunk to the base rates; at least 1e-10."""
    k = np.exp(-((at[:, None, :] - where[None]) ** 2).sum(-1) / (2 * sigma2))
    return np.log(np.maximum((k @ spikes + tau * base) / np.maximum(k @ weights[:, None] + tau, 1e-300), 1e-10))


@dataclass(frozen=True)
class Kernels:
    """Log rates from an encoding set as maps that `decoded` takes: positions (n, 2), spikes (n, units) and occupancy weights (n)."""

    where: np.ndarray
    spikes: np.ndarray
    weights: np.ndarray
    sigma2: float
    base: np.ndarray
    tau: float

    def at(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log rates (rows, units) and their gradients (rows, units, 2)."""
        off = p[:, None, :2] - self.where[None]
        k = np.exp(-(off**2).sum(-1) / (2 * self.sigma2))
        dk = -off / self.sigma2 * k[..., None]
        top = k @ self.spikes + self.tau * self.base
        under = np.maximum(k @ self.weights + self.tau, 1e-300)[:, None]
        d_top = np.einsum("rnc,nu->ruc", dk, self.spikes)
        d_under = np.einsum("rnc,n->rc", dk, self.weights)[:, None]
        rate = top / under
        live = (rate > 1e-10)[..., None]
        slope = np.where(live, d_top / np.maximum(top, 1e-300)[..., None] - d_under / under[..., None], 0.0)
        return np.log(np.maximum(rate, 1e-10)), slope


#: Sides of a cell and the kernel's reach, in sigmas.
CELL, REACH = 0.25, 6.0


@dataclass(frozen=True)
class CellKernels:
    """Log rates as of Kernels from any number of encoding positions, gathered in cells: only their moments are kept.

    Around the centroid of a cell's positions the kernel is taken to second order, so a unit of mass errs by at most
    `error`: the third order over half a cell's diagonal, and what lies beyond the reach. centre (cells, 2) and the
    moments are in sigmas; moments are (cells, 1 + units, 6): mass, first and second ones, of the occupancy and each unit.
    """

    codes: np.ndarray
    centre: np.ndarray
    moments: np.ndarray
    sigma2: float
    base: np.ndarray
    tau: float
    rows: np.ndarray
    cell: float = CELL
    reach: float = REACH

    @property
    def error(self) -> float:
        """Per unit of mass: 1.381 bounds the third derivative of exp(-t^2 / 2) along any line."""
        return 1.381 / 6 * (self.cell * 2**0.5) ** 3 + float(np.exp(-0.5 * (self.reach - 2 * self.cell) ** 2))

    def near(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, cell) within reach; rows in order."""
        n = int(np.ceil(self.reach / self.cell)) + 1
        ij = np.floor(z / self.cell).astype(np.int64)
        span = np.arange(-n, n + 1)
        row = np.repeat(np.arange(len(z)), len(span))
        lines = _code(np.repeat(ij[:, 0], len(span)) + np.tile(span, len(z)), 0)
        low = np.searchsorted(self.codes, lines + np.repeat(ij[:, 1] - n, len(span)))
        high = np.searchsorted(self.codes, lines + np.repeat(ij[:, 1] + n, len(span)), side="right")
        number = high - low
        at = np.repeat(low - np.cumsum(number) + number, number) + np.arange(number.sum())
        row = np.repeat(row, number)
        close = ((z[row] - self.centre[at]) ** 2).sum(1) <= self.reach**2
        return row[close], at[close]

    def sums(self, p: np.ndarray, slopes: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Kernel sums (rows, 1 + units) and their gradients (rows, 1 + units, 2; zeros without slopes), without base and tau."""
        sigma = self.sigma2**0.5
        value, slope = np.zeros((len(p), self.moments.shape[1])), np.zeros((len(p), self.moments.shape[1], 2))
        for start in range(0, len(p), 64):
            z = p[start : start + 64, :2] / sigma
            row, at = self.near(z)
            if not len(row):
                continue
            u, m = z[row] - self.centre[at], self.moments[at]
            x, y = u[:, :1], u[:, 1:]
            k = np.exp(-0.5 * (u**2).sum(1))[:, None]
            f = k * (m[:, :, 0] + m[:, :, 1] * x + m[:, :, 2] * y + 0.5 * (m[:, :, 3] * (x * x - 1) + 2 * m[:, :, 4] * x * y + m[:, :, 5] * (y * y - 1)))
            first = np.flatnonzero(np.diff(row, prepend=-1))
            value[start + row[first]] = np.add.reduceat(f, first)
            if not slopes:
                continue
            lean_x, lean_y = m[:, :, 1] + m[:, :, 3] * x + m[:, :, 4] * y, m[:, :, 2] + m[:, :, 4] * x + m[:, :, 5] * y
            slope[start + row[first]] = np.stack([np.add.reduceat(k * lean - c * f, first) for c, lean in ((x, lean_x), (y, lean_y))], -1) / sigma
        return value, slope

    def at(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log rates (rows, units) and their gradients (rows, units, 2)."""
        value, slope = self.sums(p)
        return self._logs(value), self._slopes(value, slope)

    def log_rates(self, p: np.ndarray) -> np.ndarray:
        """Log rates (rows, units) alone."""
        return self._logs(self.sums(p, slopes=False)[0])

    def _logs(self, value: np.ndarray) -> np.ndarray:
        return np.log(np.maximum((np.maximum(value[:, 1:], 0) + self.tau * self.base) / np.maximum(value[:, :1] + self.tau, 1e-300), 1e-10))

    def _slopes(self, value: np.ndarray, slope: np.ndarray) -> np.ndarray:
        top = np.maximum(value[:, 1:], 0) + self.tau * self.base
        under = np.maximum(value[:, :1] + self.tau, 1e-300)
        rate = top / under
        live = (rate > 1e-10)[..., None]
        return np.where(live, slope[:, 1:] / np.maximum(top, 1e-300)[..., None] - slope[:, :1] / under[..., None], 0.0)


def _code(ix: np.ndarray, iy) -> np.ndarray:
    """One number for a cell, in order of ix, then iy."""
    return ix * (1 << 31) + (1 << 30) + iy


def cell_kernels(encoding: DataFrame, sigma2: float, base: np.ndarray, tau: float, x: str = "x", y: str = "y", spikes: str = "spikes", weight: str = "weight", cell: float = CELL, reach: float = REACH) -> CellKernels:
    """Kernels of an encoding table of any size: rows are added up in cells by partial sums, and cells alone are gathered.

    Rows with a null in position, weight or spikes are left out. An error where the places visited fill more cells,
    times units, than a decoder broadcasts.
    """
    sigma = sigma2**0.5
    z = lambda c: F.col(c).cast("double") / sigma
    index = lambda c: F.floor(z(c) / cell).cast("long")
    mass = F.concat(F.array(F.lit(1.0), F.col(weight).cast("double")), F.transform(spikes, lambda s: s.cast("double")))
    rows = encoding.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(weight).isNotNull() & F.forall(spikes, lambda s: s.isNotNull()))
    each = rows.select(index(x).alias("ix"), index(y).alias("iy"), (z(x) - index(x) * cell).alias("dx"), (z(y) - index(y) * cell).alias("dy"), F.posexplode(mass).alias("who", "s")).filter("s != 0")
    powers = {"n": "s", "sx": "s * dx", "sy": "s * dy", "xx": "s * dx * dx", "xy": "s * dx * dy", "yy": "s * dy * dy"}
    got = each.groupBy("ix", "iy", "who").agg(*[F.sum(F.expr(e)).alias(c) for c, e in powers.items()])
    units = len(base)
    if got.select("ix", "iy").distinct().count() * (2 + units) > MOST_CELLS:
        raise ValueError(f"the places visited fill more cells than a decoder broadcasts ({MOST_CELLS})")
    held = got.toArrow()
    ix, iy, who = (held.column(c).to_numpy() for c in ("ix", "iy", "who"))
    codes, at = np.unique(_code(ix, iy), return_inverse=True)
    raw = np.zeros((len(codes), 2 + units, 6))
    raw[at, who] = np.stack([held.column(c).to_numpy() for c in powers], 1)
    corner = np.zeros((len(codes), 2))
    corner[at] = np.stack([ix, iy], 1) * cell
    count = raw[:, 0, 0]
    mid = raw[:, 0, 1:3] / np.maximum(count, 1)[:, None]
    m, (cx, cy) = raw[:, 1:].copy(), (mid[:, None, 0], mid[:, None, 1])
    m[..., 1], m[..., 2] = raw[:, 1:, 1] - cx * raw[:, 1:, 0], raw[:, 1:, 2] - cy * raw[:, 1:, 0]
    m[..., 3] = raw[:, 1:, 3] - 2 * cx * raw[:, 1:, 1] + cx**2 * raw[:, 1:, 0]
    m[..., 4] = raw[:, 1:, 4] - cx * raw[:, 1:, 2] - cy * raw[:, 1:, 1] + cx * cy * raw[:, 1:, 0]
    m[..., 5] = raw[:, 1:, 5] - 2 * cy * raw[:, 1:, 2] + cy**2 * raw[:, 1:, 0]
    return CellKernels(codes, corner + mid, m, sigma2, np.asarray(base, float), tau, count, cell, reach)


# ---------------------------------------------------------------- graphs


def laplacian(edges: DataFrame, n: int) -> np.ndarray:
    """Dense Laplacian with inverse distances of (src, dst, distance); for environments of at most MOST_BINS bins."""
    if n > MOST_BINS:
        raise ValueError(f"an environment of {n} bins is more than a dense basis takes ({MOST_BINS})")
    got = edges.groupBy("src", "dst").agg(F.sum(1.0 / F.col("distance")).alias("w")).toArrow()
    a, b, w = (got.column(k).to_numpy() for k in range(3))
    out = np.zeros((n, n))
    for i, j, x in ((a, b, -w), (b, a, -w), (a, a, w), (b, b, w)):
        np.add.at(out, (i, j), x)
    return out


def components_of(L: np.ndarray) -> np.ndarray:
    label, new = np.full(len(L), -1), 0
    for i in range(len(L)):
        if label[i] < 0:
            todo = [i]
            while todo:
                k = todo.pop()
                if label[k] < 0:
                    label[k] = new
                    todo += np.flatnonzero((L[k] != 0) & (label < 0)).tolist()
            new += 1
    return label


def graph_basis(L: np.ndarray, rank: int | None = None, sigma: float | None = None, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, vectors (bins, rank) and component labels, component by component; every null mode stays."""
    label = components_of(L)
    values, vectors = [], []
    for c in range(label.max() + 1):
        own = np.flatnonzero(label == c)
        w, v = np.linalg.eigh(L[np.ix_(own, own)])
        full = np.zeros((len(L), len(own)))
        full[own] = v
        values.append(np.maximum(w, 0))
        vectors.append(full)
    w, v = np.concatenate(values), np.concatenate(vectors, axis=1)
    order = np.argsort(w, kind="stable")
    w, v = w[order], v[:, order]
    if rank is None:
        rank = len(w) if sigma is None else int((np.exp(-(sigma**2) * w / 2) >= tolerance).sum())
    nulls = label.max() + 1
    if rank < nulls:
        raise ValueError(f"a rank of {rank} drops null modes of {nulls} components")
    return w[:rank], v[:, :rank], label


def spectral_shape(value, kappa2: float, alpha: float = 1.0):
    """(kappa2 + eigenvalue)^-alpha, for columns and arrays alike."""
    return (kappa2 + value) ** (-alpha)


def graph_design(samples: DataFrame, basis: np.ndarray, bin: str = "bin", into: str = "z") -> DataFrame:
    """Adds the basis row of each sample's bin, and valid; out of bounds is invalid with a row of zeros. The basis' size bounds the broadcast."""
    spark = samples.sparkSession
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(basis)], f"{bin} int, {into} array<double>")
    zero = F.array(*[F.lit(0.0)] * basis.shape[1])
    got = samples.join(F.broadcast(rows), bin, "left")
    return got.withColumn("valid", F.col(into).isNotNull()).withColumn(into, F.coalesce(F.col(into), zero))


