"""Ordered folds whose steps do not compose, over all series of a partition at once.

Rows are parted by key and sorted by time before key, and stream through: a task holds the carry
of its series, never their history. Each step of a fold is one NumPy call for the next row of all
series of a batch, whether their times agree or not. A pass backward is the same with the order turned.
Recursions whose steps do compose belong to plans.scan, which also cuts a series into tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Arrays = dict[str, np.ndarray]


def to_numpy(column: pa.Array) -> np.ndarray:
    """Numbers, or regular nested lists of them; a null number is NaN."""
    shape: list[int] = []
    n = len(column)
    while pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        flat = column.flatten()
        if n and len(flat) % max(1, len(column)):
            raise ValueError("arrays of one column differ in length")
        shape.append(len(flat) // max(1, len(column)))
        column = flat
    values = column.to_numpy(zero_copy_only=False)
    return values.reshape(n, *shape) if shape else values


def to_arrow(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, inner = len(values), np.ascontiguousarray(values)
    if not pa.types.is_list(kind):
        return pa.array(inner, kind)
    child = inner.reshape(n * inner.shape[1], *inner.shape[2:])
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * inner.shape[1], pa.int32()), to_arrow(child, kind.value_type))


def kind_of(dims: int, integer: bool = False) -> T.DataType:
    kind: T.DataType = T.LongType() if integer else T.DoubleType()
    for _ in range(dims):
        kind = T.ArrayType(kind)
    return kind


def fold(
    rows: DataFrame,
    key: str,
    order: str,
    start: Callable[[int], Arrays],
    step: Callable[[Arrays, Arrays, np.ndarray], tuple[Arrays, Arrays]],
    into: dict[str, int],
    inputs: Sequence[str],
    keep: Sequence[str] = (),
    backward: bool = False,
) -> DataFrame:
    """(key, order, keep, into): what `step` gives for every row, series by series in order.

    start(n): carries of n new series. step(carry, inputs, fresh): new carries and outputs;
    every array has one entry for each series in front, and fresh marks first rows. into: names
    of outputs and how deep their arrays nest; one named `first` need not be given, it is 1 in the
    first row of each series, wherever its orders begin. Rows of one key and order are taken one after
    another; a null key is a series of its own; null rows of inputs are the step's concern.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    names = list(dict.fromkeys([key, order, *keep]))
    schema = T.StructType([*[rows.schema[c] for c in names], *[T.StructField(c, kind_of(d)) for c, d in into.items()]])
    arrow = [to_arrow_type(schema[c].dataType) for c in into]
    used = list(dict.fromkeys([*names, *inputs]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rounds, _ in _rolled(batches, key, start, step, inputs):
            made: dict[str, np.ndarray] = {}
            for where, out in rounds:
                for k in into:
                    if k not in made:
                        made[k] = np.zeros((batch.num_rows, *out[k].shape[1:]))
                    made[k][where] = out[k]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], *[to_arrow(made[c], kind) for c, kind in zip(into, arrow)]], names=schema.names
            )

    return _dealt(rows.select(*used), key, order, backward).mapInArrow(run, schema)


def _dealt(rows: DataFrame, key: str, order: str, backward: bool) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(F.desc(order) if backward else F.asc(order), key)


def _rolled(batches: Iterator[pa.RecordBatch], key: str, start: Callable, step: Callable, inputs: Sequence[str]) -> Iterator[tuple]:
    """(batch, the rounds' (places, outputs), the carries of all series so far, which the next batch goes on with)."""
    slot: dict = {}
    carry: Arrays = {}
    seen = np.zeros(0, bool)
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(key).to_pylist()
        new = list(dict.fromkeys(i for i in ids if i not in slot))
        if new:
            more = start(len(new))
            carry = {k: np.concatenate([carry[k], v]) if carry else v for k, v in more.items()}
            seen = np.concatenate([seen, np.zeros(len(new), bool)])
            for i in new:
                slot[i] = len(slot)
        at = np.fromiter((slot[i] for i in ids), np.int64, len(ids))
        given = {c: to_numpy(batch.column(c)) for c in inputs}
        rounds = []
        for where in _rounds(at):
            own = at[where]
            now = {k: v[own] for k, v in carry.items()}
            after, out = step(now, {c: v[where] for c, v in given.items()}, ~seen[own])
            rounds.append((where, {"first": (~seen[own]).astype(float), **out}))
            seen[own] = True
            for k, v in after.items():
                carry[k][own] = v
        yield batch, rounds, carry


def fold_sums(rows: DataFrame, key: str, order: str, start: Callable, step: Callable, inputs: Sequence[str], backward: bool = False) -> Arrays:
    """Sums over all rows of what `step` gives, and over all series of their last carries (as `carry NAME`).

    As fold, but outputs are summed up in tasks; what reaches the driver is bounded by the arrays' size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Arrays = {}
        carry: Arrays = {}
        for _, rounds, carry in _rolled(batches, key, start, step, inputs):
            for _, out in rounds:
                for k, v in out.items():
                    held[k] = held[k] + v.sum(0) if k in held else np.asarray(v.sum(0), float)
        yield from sent(held | {f"carry {k}": np.asarray(v.sum(0), float) for k, v in carry.items()})

    return gathered(_dealt(rows.select(*dict.fromkeys([key, order, *inputs])), key, order, backward).mapInArrow(run, SENT))


def together(parts: Sequence[tuple[Callable, Callable]]) -> tuple[Callable, Callable]:
    """start and step of several recursions over the same rows; their outputs `ll` become one array."""

    def start(n):
        return {f"{k} {name}": v for k, (begin, _) in enumerate(parts) for name, v in begin(n).items()}

    def step(s, x, fresh):
        carry, lls = {}, []
        for k, (_, go) in enumerate(parts):
            own, out = go({name.split(" ", 1)[1]: v for name, v in s.items() if name.startswith(f"{k} ")}, x, fresh)
            carry |= {f"{k} {name}": v for name, v in own.items()}
            lls.append(out["ll"])
        return carry, {"ll": np.stack(lls, 1)}

    return start, step


def side_by_side(parts: Sequence[tuple[Callable, Callable]], split: Sequence[str] = ()) -> tuple[Callable, Callable]:
    """start and step of several recursions over the same rows, whose outputs are stacked behind the series' axis.

    Inputs in `split` are stacked so themselves, one slice a recursion. A recursion whose algebra breaks down gives
    NaN from then on and leaves the others alone.
    """

    def start(n):
        return {f"{k} {name}": v for k, (begin, _) in enumerate(parts) for name, v in begin(n).items()}

    def step(s, x, fresh):
        carry, outs = {}, []
        for k, (_, go) in enumerate(parts):
            own = {name.split(" ", 1)[1]: v for name, v in s.items() if name.startswith(f"{k} ")}
            given = {c: v[:, k] if c in split else v for c, v in x.items()}
            try:
                after, out = go(own, given, fresh)
            except np.linalg.LinAlgError:
                after, out = {name: np.full_like(np.asarray(v, float), np.nan) for name, v in own.items()}, None
            carry |= {f"{k} {name}": v for name, v in after.items()}
            outs.append(out)
        alive = next((o for o in outs if o is not None), None)
        if alive is None:
            raise np.linalg.LinAlgError("no recursion is left")
        fill = {name: np.full_like(np.asarray(v, float), np.nan) for name, v in alive.items()}
        return carry, {name: np.stack([(o or fill)[name] for o in outs], 1) for name in alive}

    return start, step


def evidence(rows: DataFrame, parts: Sequence[tuple[Callable, Callable]], inputs: Sequence[str], key: str, order: str) -> list[float]:
    """Sum of `ll` over all rows for each of several recursions, in one pass."""
    return fold_sums(rows, key, order, *together(parts), inputs)["ll"].tolist()


def mapped(rows: DataFrame, inputs: Sequence[str], into: dict[str, int], make: Callable[[Arrays], Arrays], keep: Sequence[str] = ()) -> DataFrame:
    """(keep, into): arrays that `make` gives for a batch of rows, one entry a row in front. into: names and how deep they nest."""
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType([*[rows.schema[c] for c in keep], *[T.StructField(c, kind_of(d)) for c, d in into.items()]])
    arrow = [to_arrow_type(schema[c].dataType) for c in into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = make({c: to_numpy(batch.column(c)) for c in inputs})
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in keep], *[to_arrow(np.asarray(made[c], float), kind) for c, kind in zip(into, arrow)]], names=schema.names
                )

    return rows.select(*dict.fromkeys([*keep, *inputs])).mapInArrow(run, schema)


def _rounds(at: np.ndarray) -> list[np.ndarray]:
    """Places in rounds that hold each series once: the first rows of all series, the second ones, and so on."""
    order = np.argsort(at, kind="stable")
    nth = np.empty(len(at), np.int64)
    nth[order] = np.arange(len(at)) - np.searchsorted(at[order], at[order])
    order = np.argsort(nth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(nth[order])) + 1)


def totals(rows: DataFrame, inputs: Sequence[str], make: Callable[[Arrays], Arrays]) -> Arrays:
    """Sums over all rows of the arrays that `make` gives for a batch (already summed over its rows).

    Each task sends one row for each number; what reaches the driver is bounded by the arrays' size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Arrays = {}
        for batch in batches:
            if batch.num_rows:
                add(held, make({c: to_numpy(batch.column(c)) for c in inputs}))
        yield from sent(held)

    return gathered(rows.select(*inputs).mapInArrow(run, SENT))


SENT = "name string, place long, x double, shape string"


def add(held: Arrays, more: Arrays) -> None:
    for k, v in more.items():
        held[k] = held[k] + v if k in held else np.asarray(v, float)


def sent(held: Arrays) -> Iterator[pa.RecordBatch]:
    """A row for each number."""
    for k, v in held.items():
        flat = v.ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array([k] * len(flat)), pa.array(np.arange(len(flat))), pa.array(flat), pa.array([",".join(map(str, v.shape))] * len(flat))],
            names=["name", "place", "x", "shape"],
        )


def gathered(got: DataFrame) -> Arrays:
    out: Arrays = {}
    for r in got.groupBy("name", "shape", "place").agg(F.sum("x").alias("x")).collect():
        shape = tuple(int(s) for s in r["shape"].split(",") if s)
        if r["name"] not in out:
            out[r["name"]] = np.zeros(shape)
        out[r["name"]].reshape(-1)[r["place"]] = r["x"]
    return out
