"""Ordered folds over series of any length as distributed scans.

A recursion over time whose steps compose - a linear-Gaussian filter or smoother, the forward
or backward pass of a chain, its best path, any affine recursion - is run in three passes:
each block of BLOCK steps composes its own steps, the compositions are scanned over the blocks
(by the same plan, if a series has very many), and each block is then run from what its
predecessors hand it. No row ever holds more than one block, so one very long series is as
parallel as many short ones.

Everything is SQL over arrays; steps, compositions and states are structs given as SQL text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 128


@dataclass(frozen=True)
class Scan:
    """SQL of a recursion.

    element: the step of item `x` as a struct. compose: the struct of `a` followed by `b`.
    identity: the element that changes nothing. start: state before the first item, from the
    element `e` that composes all items before it (the identity for the first block).
    step: the state after item `x` from state `s`, of the same fields as start.
    """

    element: str
    compose: str
    identity: str
    start: str
    step: str


def _blocks(items: DataFrame, key: str, order: str, block: int, backward: bool) -> DataFrame:
    at = F.floor(F.col(order) / block).cast("long")
    place = -F.col(order) if backward else F.col(order)
    others = [c for c in items.columns if c != key]
    return (
        items.select(key, (-at if backward else at).alias("block"), F.struct(place.cast("long").alias("place"), *others).alias("x"))
        .groupBy(key, "block")
        .agg(F.sort_array(F.collect_list("x")).alias("items"))
    )


def _put(text: str, **names: str) -> str:
    """SQL with other names in place of one-letter ones where a field of them is taken."""
    return re.sub(r"\b([abs])\.", lambda m: f"{names.get(m[1], m[1])}.", text)


def carried(summaries: DataFrame, key: str, scan: Scan, block: int, depth: int) -> DataFrame:
    """(key, block, e): the composition of all summaries (key, block, e) of earlier blocks."""
    upper = F.floor(F.col("block") / block).cast("long") if depth > 1 else F.lit(0).cast("long")
    grouped = (
        summaries.groupBy(key, upper.alias("upper"))
        .agg(F.sort_array(F.collect_list(F.struct("block", "e"))).alias("held"))
    )
    if depth > 1:
        total = f"aggregate(held, {scan.identity}, (a, h) -> {_put(scan.compose, b='h.e')})"
        above = carried(grouped.select(key, F.col("upper").alias("block"), F.expr(total).alias("e")), key, scan, block, depth - 1)
        grouped = grouped.join(above.select(key, F.col("block").alias("upper"), F.col("e").alias("before")), [key, "upper"])
    else:
        grouped = grouped.withColumn("before", F.expr(scan.identity))
    # entry k of `reached` composes everything before the block k
    spread = f"aggregate(held, array(before), (z, h) -> concat(z, array({_put(scan.compose, a='element_at(z, -1)', b='h.e')})))"
    paired = grouped.select(key, "held", F.expr(spread).alias("reached"))
    return paired.select(key, F.explode(F.arrays_zip("held", F.expr("slice(reached, 1, size(held))").alias("e"))).alias("h")).select(
        key, F.col("h.held.block").alias("block"), F.col("h.e").alias("e")
    )


def bound(items: DataFrame, order: str) -> int:
    """The largest value of the order column, one number from each task."""
    return int(items.agg(F.max(order)).first()[0] or 0)


def run(items: DataFrame, key: str, order: str, scan: Scan, longest: int | None = None, block: int = BLOCK, backward: bool = False) -> DataFrame:
    """The items with the fields of the state after each; `longest` bounds the order column, which counts from 0.

    Without it the bound is taken from the items. Series of at most one block take one shuffle and no composition.
    """
    longest = bound(items, order) if longest is None else longest
    blocks = _blocks(items, key, order, block, backward)
    depth, reach = 0, block
    while reach <= longest:
        depth, reach = depth + 1, reach * block
    if depth:
        total = f"aggregate(transform(items, x -> {scan.element}), {scan.identity}, (a, b) -> {scan.compose})"
        summaries = blocks.select(key, "block", F.expr(total).alias("e"))
        shift = longest // block if backward else 0  # blocks are numbered from below 0 backwards
        held = carried(summaries.withColumn("block", F.col("block") + shift), key, scan, block, depth)
        blocks = blocks.join(held.withColumn("block", F.col("block") - shift), [key, "block"])
    else:
        blocks = blocks.withColumn("e", F.expr(scan.identity))
    path = f"aggregate(items, array({scan.start}), (z, x) -> concat(z, array({_put(scan.step, s='element_at(z, -1)')})))"
    reached = blocks.select(key, "items", F.expr(f"slice({path}, 2, size(items))").alias("s"))
    return reached.select(key, F.explode(F.arrays_zip("items", "s")).alias("z")).select(key, "z.items.*", "z.s.*").drop("place")
