"""Online forms of the folds: keyed state in Structured Streaming, and windowed counts.

A batch fold and its online form share one step. State is a fixed number of doubles for each
key, and may go when a key has been idle. Rows before the last one taken are late and dropped;
rows of the same order are taken one after another, as in a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from driftline.plans.fold import kind_of


def taker(order: str, start: Callable, step: Callable, into: dict[str, int], inputs: Sequence[str]) -> Callable:
    """f(rows of one key, held) -> (outputs, held): rows in order from the last one taken on; held: carry and last order, or None."""
    shapes = {k: v.shape[1:] for k, v in start(1).items()}
    sizes = [int(np.prod(s, dtype=int)) for s in shapes.values()]

    def take(rows: pd.DataFrame, held):
        carry, last = start(1), -np.inf
        if held is not None:
            parts = np.split(np.asarray(held[0], float), np.cumsum(sizes)[:-1])
            carry, last = {k: x.reshape(1, *s) for (k, s), x in zip(shapes.items(), parts)}, held[1]
        rows = rows[rows[order] >= last].sort_values(order, kind="stable")
        given = {c: np.stack([np.asarray(v, float) for v in rows[c]]) if len(rows) else np.zeros((0,)) for c in inputs}
        made: dict[str, list] = {c: [] for c in into}
        for n in range(len(rows)):
            carry, got = step(carry, {c: v[n : n + 1] for c, v in given.items()}, np.array([held is None and n == 0]))
            for c in into:
                made[c].append(got[c][0].tolist() if into[c] else float(got[c][0]))
        if len(rows):
            held = (np.concatenate([np.ravel(carry[k]) for k in shapes]).tolist(), float(rows[order].iloc[-1]))
        return pd.DataFrame({order: rows[order].to_numpy(), **made}), held

    return take


def online(stream: DataFrame, key: str, order: str, start: Callable, step: Callable, into: dict[str, int], inputs: Sequence[str], idle: int | None = None) -> DataFrame:
    """(key, order, into) of a fold over a stream: `start` and `step` as in plans.fold.

    Rows of one micro-batch are taken in order; the carry goes on from batch to batch. idle: milliseconds
    after which a key without rows is forgotten, and begins anew; never, without it.
    """
    out = T.StructType([stream.schema[key], stream.schema[order], *[T.StructField(c, kind_of(d)) for c, d in into.items()]])
    kept = T.StructType([T.StructField("carry", T.ArrayType(T.DoubleType())), T.StructField("last", T.DoubleType())])
    take = taker(order, start, step, into, inputs)

    def run(ids: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        made, held = take(pd.concat(list(frames)), tuple(state.get) if state.exists else None)
        if held is not None:
            state.update(held)
            if idle is not None:
                state.setTimeoutDuration(idle)
        made.insert(0, key, ids[0])
        yield made[out.names]

    used = stream.select(*dict.fromkeys([key, order, *inputs]))
    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return used.groupBy(key).applyInPandasWithState(run, out, kept, "append", timeout)


def local_level(model) -> tuple[Callable, Callable, dict[str, int]]:
    """start, step and outputs of the scalar filter of operators.kalman.Scalar."""

    def start(n):
        return {"m": np.full(n, model.m0), "v": np.full(n, model.p0)}

    def step(s, x, fresh):
        pm, pv = model.a * s["m"], model.a**2 * s["v"] + model.q
        total = model.h**2 * pv + model.r
        off = x["y"] - model.h * pm
        m, v = pm + pv * model.h / total * off, pv * model.r / total
        return {"m": m, "v": v}, {"m": m, "v": v, "ll": -0.5 * (np.log(2 * np.pi * total) + off**2 / total)}

    return start, step, {"m": 0, "v": 0, "ll": 0}


def chain(transition: np.ndarray, prior: np.ndarray, logits: str = "ll") -> tuple[Callable, Callable, dict[str, int]]:
    """start, step and outputs of a chain's filter."""

    def start(n):
        return {"p": np.repeat(np.asarray(prior, float)[None], n, 0)}

    def step(s, x, fresh):
        pred = np.where(fresh[:, None], s["p"], s["p"] @ transition)
        joint = np.log(np.maximum(pred, 1e-30)) + x[logits]
        top = joint.max(1, keepdims=True)
        p = np.exp(joint - top)
        return {"p": p / p.sum(1, keepdims=True)}, {"p": p / p.sum(1, keepdims=True)}

    return start, step, {"p": 1}


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts of tumbling windows; rows later than the watermark are dropped."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, time: str, gap: str, late: str, *keys: str) -> DataFrame:
    """Bouts of events with no gap as long as `gap`."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))


def into_folder(frame: DataFrame, folder: str, checkpoint: str) -> None:
    """Runs a stream over what there is and appends it to Parquet files."""
    frame.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: The state store that timers and lists of state need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_event_time(stream: DataFrame, key: str, time: str, delay: str, start: Callable, step: Callable, into: dict[str, int], inputs: Sequence[str]) -> DataFrame:
    """(key, time, into) of a fold over a stream whose rows come in any order, up to `delay` late: as a batch in order of time.

    Rows wait in a list of state until the watermark has passed them; then a timer takes all that are due, in order of
    time, and the carry goes on. time: a timestamp; delay: as of withWatermark. A key's rows of one time are taken
    one after another, in the order of their inputs. Rows later than the delay are dropped, and rows that the
    watermark has not passed are not given yet. The session needs the state store ROCKSDB; a null key is a series.
    """
    from pyspark.sql.streaming import StatefulProcessor

    shapes = {k: v.shape[1:] for k, v in start(1).items()}
    sizes = [int(np.prod(s, dtype=int)) for s in shapes.values()]
    fields = [stream.schema[c] for c in dict.fromkeys([time, *inputs])]
    out = T.StructType([stream.schema[key], stream.schema[time], *[T.StructField(c, kind_of(d)) for c, d in into.items()]])
    columns = [f.name for f in fields]
    plain = lambda x: x.tolist() if isinstance(x, np.ndarray) else x

    class InOrder(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", T.StructType(fields))
            self.carry = handle.getValueState("carry", T.StructType([T.StructField("carry", T.ArrayType(T.DoubleType()))]))

        def handleInputRows(self, key, rows, timerValues):
            came = pd.concat(list(rows))
            self.waiting.appendList([tuple(plain(v) for v in r) for r in came[columns].itertuples(index=False)])
            due = int(came[time].min().timestamp() * 1000) + 1
            if not any(t <= due for t in self.handle.listTimers()):
                self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            held = pd.DataFrame([tuple(r) for r in self.waiting.get()], columns=columns)
            passed = held[time] <= pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
            rest = held[~passed]
            if len(rest):
                self.waiting.put([tuple(plain(v) for v in r) for r in rest.itertuples(index=False)])
                self.handle.registerTimer(int(rest[time].min().timestamp() * 1000) + 1)
            else:
                self.waiting.clear()
            due = held[passed].sort_values(columns[:1] + [c for c in columns[1:] if not isinstance(held[c].iloc[0], list)], kind="stable")
            if not len(due):
                return iter([])
            carry, fresh = start(1), not self.carry.exists()
            if not fresh:
                parts = np.split(np.asarray(self.carry.get()[0], float), np.cumsum(sizes)[:-1])
                carry = {k: x.reshape(1, *s) for (k, s), x in zip(shapes.items(), parts)}
            made: dict[str, list] = {c: [] for c in into}
            for n in range(len(due)):
                row = {c: np.asarray([due[c].iloc[n]], float) for c in inputs}
                carry, got = step(carry, row, np.array([fresh and n == 0]))
                for c in into:
                    made[c].append(got[c][0].tolist() if into[c] else float(got[c][0]))
            self.carry.update((np.concatenate([np.ravel(carry[k]) for k in shapes]).tolist(),))
            return iter([pd.DataFrame({out.names[0]: [key[0]] * len(due), time: due[time].to_numpy(), **made})])

        def close(self) -> None:
            pass

    used = stream.select(*dict.fromkeys([key, time, *inputs])).withWatermark(time, delay)
    return used.groupBy(key).transformWithStateInPandas(InOrder(), out, "append", "EventTime")
