"""Recursions that compose, on arrays: a long series is cut into blocks, each a row, and blocks run side by side.

`pack` gathers the rows of a block into one row, by one shuffle; from then on a sweep forward or
backward is narrow but for a join with what the other blocks hand on. A sweep of many blocks
composes the elements of each block (pairwise, in a tree, for all blocks of a batch at once), runs
the same plan over the compositions, by levels of LEVEL blocks, and then runs each block step by
step from the composition of all blocks before it. Series of one block skip all but the last.

Sweeps of series of one block, what is derived from their items and what is summed over them wait as
`passes` and run one after another over a slice of a batch, in one Python process of a task: nothing
but the packed rows goes to Python, and only what is asked for comes back.

No task holds more than some blocks, whatever the length of a series. plans.scan does the same for
scalars within SQL; plans.fold has recursions that do not compose.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.plans import fold
from driftline.plans.fold import Arrays, kind_of, to_arrow, to_numpy
from driftline.plans.lineage import reused

Pass = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Steps of a block, blocks of a level, and bytes of elements that are composed at once.
BLOCK, LEVEL, BYTES = 128, 256, 1 << 25


@dataclass(frozen=True)
class Recursion:
    """A recursion over rows; all arrays have one entry for each series (or row) in front.

    identity(n): elements that change nothing. element(inputs, fresh): the element of each row;
    fresh marks the first row of a series. compose(a, b): a, then b. start(e, none): the state
    before a row from the composition of all rows before it; none marks series without any.
    step(state, inputs, fresh): the new state and the outputs of a row.
    """

    identity: Callable[[int], Arrays]
    element: Callable[[Arrays, np.ndarray], Arrays]
    compose: Callable[[Arrays, Arrays], Arrays]
    start: Callable[[Arrays, np.ndarray], Arrays]
    step: Callable[[Arrays, Arrays, np.ndarray], tuple[Arrays, Arrays]]


@dataclass(frozen=True)
class Blocks:
    """frame: (k, block, items), k a struct of the key, items the rows of a block in order. span: blocks from the first to the last of all.

    It is base, and what the passes still to come make of its items; item is what they are then made of.
    """

    base: DataFrame
    key: str
    order: str
    first: int
    span: int
    item: T.StructType
    passes: tuple[Pass, ...] = ()

    @property
    def frame(self) -> DataFrame:
        if not self.passes:
            return self.base
        schema = T.StructType([self.base.schema["k"], self.base.schema["block"], T.StructField("items", T.ArrayType(self.item))])
        return self.base.mapInArrow(_one_by_one(self.passes), schema)

    def rows(self) -> DataFrame:
        """(key, and the fields of items), a row for each item."""
        return self.frame.select(F.col(f"k.{self.key}").alias(self.key), F.explode("items").alias("x")).select(self.key, "x.*")

    def written(self) -> Blocks:
        """The blocks as a table that several jobs or sweeps read."""
        return replace(self, base=reused(self.frame), passes=())


def _one_by_one(passes: Sequence[Pass]) -> Pass:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in passes:
            batches = one(batches)
        yield from batches

    return run


def pack(rows: DataFrame, key: str, order: str, columns: Sequence[str], block: int = BLOCK) -> Blocks:
    """Rows with whole-number orders in blocks of so many orders; a null key is a series of its own, a null order no row.

    Orders may begin anywhere and have gaps. Rows of one key and order are taken one after another in one block.
    """
    rows = rows.filter(F.col(order).isNotNull())
    place = F.floor(F.col(order) / block).cast("long")
    ends = rows.agg(F.min(place), F.max(place)).first()
    first, last = (0, -1) if ends[0] is None else ends
    fields = F.struct(*dict.fromkeys([order, *columns]))
    frame = rows.select(F.struct(key).alias("k"), place.alias("block"), fields.alias("x")).groupBy("k", "block")
    return _blocks(frame.agg(F.sort_array(F.collect_list("x")).alias("items")), key, order, first, last - first + 1)


def _blocks(packed: DataFrame, key: str, order: str, first: int, span: int) -> Blocks:
    return Blocks(packed, key, order, first, span, packed.schema["items"].dataType.elementType)


def _fields(items: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
    """Length of each list, and all their structs."""
    return items.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), items.flatten()


def _take(x: Arrays, at) -> Arrays:
    return {k: v[at] for k, v in x.items()}


def _chunks(batches: Iterator[pa.RecordBatch], width: int, room: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Batches whose items are about room / width at most (one row at least)."""
    most = max(1, room // max(1, width))
    for batch in batches:
        ends = np.cumsum(batch.column("items").value_lengths().to_numpy(zero_copy_only=False))
        if len(ends) and ends[-1] <= most:
            yield batch
            continue
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _width(kind: T.DataType, cells: int = 4) -> int:
    """Bytes of a value, an array taken for so many entries a level."""
    if isinstance(kind, T.StructType):
        return sum(_width(f.dataType, cells) for f in kind)
    return cells * _width(kind.elementType, cells) if isinstance(kind, T.ArrayType) else 8


def _remade(batch: pa.RecordBatch, length: np.ndarray, fields: Sequence[str], columns: Sequence[pa.Array]) -> pa.RecordBatch:
    """The batch with other items."""
    structs = pa.StructArray.from_arrays(list(columns), names=list(fields))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), structs)
    names = batch.schema.names
    return pa.RecordBatch.from_arrays([lists if c == "items" else batch.column(c) for c in names], names=names)


def derived(blocks: Blocks, inputs: Sequence[str], into: dict[str, int], make: Callable[[Arrays], Arrays]) -> Blocks:
    """The blocks with what `make` gives for a run of items, one entry an item in front. into: names and how deep they nest."""
    from pyspark.sql.pandas.types import to_arrow_type

    item = T.StructType([*blocks.item, *[T.StructField(c, kind_of(d)) for c, d in into.items()]])
    names, arrow, width = blocks.item.names, {c: to_arrow_type(kind_of(d)) for c, d in into.items()}, _width(item)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches, width, BYTES // 4):
            length, flat = _fields(batch.column("items"))
            made = make({c: to_numpy(pa.compute.struct_field(flat, c)) for c in inputs})
            columns = [pa.compute.struct_field(flat, c) for c in names] + [to_arrow(np.asarray(made[c], float), arrow[c]) for c in into]
            yield _remade(batch, length, item.names, columns)

    return replace(blocks, item=item, passes=(*blocks.passes, run))


def totals(rows: Blocks | DataFrame, inputs: Sequence[str], make: Callable[[Arrays], Arrays]) -> Arrays:
    """As fold.totals, over the items of blocks too, in the process that makes them."""
    if not isinstance(rows, Blocks):
        return fold.totals(rows, inputs, make)
    width = _width(rows.item)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Arrays = {}
        for batch in _chunks(batches, width, BYTES // 4):
            _, flat = _fields(batch.column("items"))
            if len(flat):
                fold.add(held, make({c: to_numpy(pa.compute.struct_field(flat, c)) for c in inputs}))
        yield from fold.sent(held)

    return fold.gathered(rows.base.mapInArrow(_one_by_one([*rows.passes, run]), fold.SENT))


def _composed(recursion: Recursion, e: Arrays, length: np.ndarray) -> Arrays:
    """The composition of each list of elements; e has the elements of all lists one after another."""
    n, most = len(length), int(length.max(initial=0))
    if not most:
        return recursion.identity(n)
    at = np.repeat(np.arange(n), length)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
    held = {k: v.reshape(n, most, *v.shape[1:]).copy() for k, v in recursion.identity(n * most).items()}
    for k, v in e.items():
        held[k][at, nth] = v
    while most > 1:
        if most % 2:
            held = {k: np.concatenate([v, recursion.identity(n)[k][:, None]], axis=1) for k, v in held.items()}
        half = (most + 1) // 2
        flat = lambda x: x.reshape(n * half, *x.shape[2:])
        both = recursion.compose({k: flat(v[:, 0::2]) for k, v in held.items()}, {k: flat(v[:, 1::2]) for k, v in held.items()})
        held, most = {k: v.reshape(n, half, *v.shape[1:]) for k, v in both.items()}, half
    return {k: v[:, 0] for k, v in held.items()}


def sweep(blocks: Blocks, recursion: Recursion, inputs: Sequence[str], into: dict[str, int], keep: Sequence[str] = (), backward: bool = False) -> Blocks:
    """The blocks with the order, `keep` and what `step` gives for each item. into: names of outputs and how deep they nest; `first` is as in fold.

    A sweep of several blocks reads its blocks twice: hand it a packed or a written table, or what is derived from one.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if blocks.span > 1 and "none" in blocks.base.columns:  # what a sweep handed on is not for this one
        blocks = replace(blocks, base=blocks.frame, passes=())
    base, old = blocks.base, blocks.item
    names = list(dict.fromkeys([blocks.order, *keep]))
    fields = [*[old[c] for c in names], *[T.StructField(c, kind_of(d)) for c, d in into.items()]]
    head = [base.schema["k"], base.schema["block"]]
    item = T.StructType(fields)
    arrow = {c: to_arrow_type(kind_of(d)) for c, d in into.items()}
    one = recursion.identity(1)
    depth = {c: v.ndim - 1 for c, v in one.items()}
    width = sum(v.nbytes for v in one.values())
    room = _width(old) + _width(item)
    many = blocks.span > 1
    used = list(dict.fromkeys(inputs))

    def given(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.StructArray, Arrays, np.ndarray]:
        """Length and starts of lists, structs and inputs in the order of the sweep, and where each struct was."""
        length, flat = _fields(batch.column("items"))
        begin = np.cumsum(length) - length
        where = np.arange(len(flat))
        if backward:
            where = np.repeat(begin + length - 1, length) - (where - np.repeat(begin, length))
        inside = {c: to_numpy(pa.compute.struct_field(flat, c)) for c in used}
        return length, begin, flat, _take(inside, where), where

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches, 4 * width):
            length, begin, _, x, _ = given(batch)
            first = np.zeros(length.sum(), bool)
            first[begin[length > 0]] = True
            e = recursion.element(x, np.zeros(len(first), bool))
            rest = _composed(recursion, _take(e, ~first), np.maximum(length - 1, 0))
            begun = recursion.element(_take(x, first), np.ones(first.sum(), bool))
            made = {f"e_{k}": v for k, v in recursion.compose(_take(e, first), rest).items()}
            made |= {f"f_{k}": v for k, v in recursion.compose(begun, rest).items()}
            columns = [to_arrow(v, to_arrow_type(kind_of(depth[k[2:]]))) for k, v in made.items()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("block"), *columns], names=["k", "block", *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches, max(width // 2, room), BYTES // 4):
            length, begin, flat, x, where = given(batch)
            n = batch.num_rows
            if many:
                none = batch.column("none").to_numpy() > 0
                e = {k: to_numpy(batch.column(f"e_{k}")) for k in one}
            else:
                none, e = np.ones(n, bool), recursion.identity(n)
            state = {k: np.array(v) for k, v in recursion.start(e, none).items()}
            made: Arrays = {}
            for nth in range(int(length.max(initial=0))):
                own = np.flatnonzero(length > nth)
                at = begin[own] + nth
                fresh = none[own] & (nth == 0)
                after, out = recursion.step(_take(state, own), _take(x, at), fresh)
                out = {"first": fresh.astype(float), **out}
                for k, v in after.items():
                    state[k][own] = v
                for k in into:
                    if k not in made:
                        made[k] = np.zeros((len(flat), *out[k].shape[1:]))
                    made[k][where[at]] = out[k]
            inside = [pa.compute.struct_field(flat, c) for c in names] + [to_arrow(made[c], arrow[c]) for c in into]
            yield _remade(batch.select(["k", "block", "items"]), length, item.names, inside)

    if many:
        found = [T.StructField(f"{v}_{k}", kind_of(depth[k])) for v in "ef" for k in one]
        sums = base.mapInArrow(_one_by_one([*blocks.passes, summed]), T.StructType([*head, *found]))
        base = base.join(_before(sums, blocks, recursion, depth, backward), ["k", "block"])
    return replace(blocks, base=base, item=item, passes=(*blocks.passes, run))


def _before(sums: DataFrame, blocks: Blocks, recursion: Recursion, depth: dict[str, int], backward: bool) -> DataFrame:
    """(k, block, none, e_...): for each block, the composition of all blocks before it in the sweep, by a sweep over blocks."""
    names = list(depth)
    as_is = lambda x, v: {k: x[f"{v}_{k}"] for k in names}

    def pick(fresh: np.ndarray, a: Arrays, b: Arrays) -> Arrays:
        return {k: np.where(fresh.reshape(-1, *[1] * depth[k]), a[k], b[k]) for k in names}

    def step(state: Arrays, x: Arrays, fresh: np.ndarray):
        after = pick(fresh, as_is(x, "f"), recursion.compose(state, as_is(x, "e")))
        return after, {"none": fresh.astype(float), **{f"e_{k}": state[k] for k in names}}

    over = Recursion(recursion.identity, lambda x, fresh: pick(fresh, as_is(x, "f"), as_is(x, "e")), recursion.compose, lambda e, none: {k: v.copy() for k, v in e.items()}, step)
    place = F.floor((F.col("block") - blocks.first) / LEVEL).cast("long")
    inputs = [f"{v}_{k}" for v in "ef" for k in names]
    frame = sums.select("k", place.alias("upper"), F.struct("block", *inputs).alias("x")).groupBy("k", "upper")
    packed = frame.agg(F.sort_array(F.collect_list("x")).alias("items")).withColumnRenamed("upper", "block")
    up = _blocks(packed, blocks.key, "block", 0, -(-blocks.span // LEVEL))
    got = sweep(up, over, inputs, {"none": 0, **{f"e_{k}": d for k, d in depth.items()}}, backward=backward)
    return got.frame.select("k", F.explode("items").alias("x")).select("k", "x.*")
