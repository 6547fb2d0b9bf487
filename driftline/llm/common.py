"""What the corpus operators share: table reading, lineage cuts, Arrow slicing, word hashing."""

from __future__ import annotations

import atexit
import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one numpy pass works on; bounds a Python worker's memory whatever Arrow sends.
SLICE_BYTES = 1 << 20
_tops: set[str] = set()
_libc = ctypes.CDLL(None) if sys.platform == "linux" else None
if not hasattr(_libc, "malloc_trim"):
    _libc = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where a session of one process has none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="driftline-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession) -> str:
    """A path in the application's part of the shared folder, which goes when the driver ends."""
    top = f"{shared_folder(spark)}/driftline/{spark.sparkContext.applicationId}"
    if top not in _tops:
        _tops.add(top)
        atexit.register(_remove, spark, top)
    return f"{top}/{uuid.uuid4().hex}"


def _remove(spark: SparkSession, top: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df as a table written in the shared folder and read again: it survives lost executors and is made once."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drops input columns whose names the operator is about to write (case-insensitively)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with its columns of these names (in any case) under private ones, and what gives a result the columns of df again."""
    taken, old = {n.lower() for n in names}, list(df.columns)
    prefix = "__aside"
    while any(c.lower().startswith(prefix) for c in old):
        prefix += "_"
    private = {c: f"{prefix}{k}" for k, c in enumerate(old) if c.lower() in taken}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return df.withColumnsRenamed(private), lambda out: out.select(*[quoted(private.get(c, c)).alias(c) for c in old])


def give_back() -> None:
    """Hands freed memory back to the system; a worker that is used again would keep the most that it ever held."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that `column` holds at most max_bytes in each piece (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(size, dtype=np.int64), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        give_back()


def append_columns(
    df: DataFrame, column: str, make: Callable[[list], list], fields: list[T.StructField], max_bytes: int = SLICE_BYTES
) -> DataFrame:
    """df with further columns that `make` computes from the values of `column`, slice by slice.

    `make` maps a list of Python values to one list or Arrow array per field. Columns of
    these names in df are replaced.
    """
    kept = without(df, [f.name for f in fields])
    schema = T.StructType([*kept.schema.fields, *fields])
    arrow = [(f.name, _arrow_type(f.dataType)) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, column, max_bytes):
            made = make(piece.column(column).to_pylist())
            new = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, (_, kind) in zip(made, arrow)]
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, *new], names=[*piece.schema.names, *[n for n, _ in arrow]]
            )

    return kept.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


# ---------------------------------------------------------------- words

#: Bytes that part words: ASCII white space only, or everything ASCII that is no letter or digit.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(int(_rng.integers(2**40, 2**62)) * 2 + 1)
_STEPS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of several texts as flat arrays, letters A-Z lowered.

    starts, ends: byte offsets in `data`; hashes: 64 bits of each word; of_text: first word
    of each text, with the number of words at the end; text_at: byte offset of each text.
    """

    def __init__(self, texts: list[str | None], parts: np.ndarray = SPACES, prefixes: tuple[int, ...] = ()):
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        size = np.array([len(r) + 1 for r in raw], dtype=np.int64)
        self.text_at = np.concatenate([[0], np.cumsum(size)])
        self.raw = b"\n".join([*raw, b""])
        self.data = np.frombuffer(self.raw.lower(), dtype=np.uint8)
        gap = parts[self.data]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(gap) and not gap[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.of_text = np.searchsorted(self.starts, self.text_at)
        if not len(self.starts):
            self.hashes = np.zeros(0, np.uint64)
            self.prefix = {n: self.hashes for n in prefixes}
            return
        length = self.ends - self.starts
        place = np.arange(self.starts[0], len(self.data), dtype=np.int64)
        place -= np.repeat(self.starts, np.diff(np.concatenate([self.starts, [len(self.data)]])))
        longest = int(length.max())
        np.minimum(place, longest, out=place)
        powers = np.concatenate([[np.uint64(1)], np.full(longest, _BASE)]).cumprod(dtype=np.uint64)
        values = np.where(gap, np.uint64(0), _BYTE[self.data])[self.starts[0] :] * powers[place]
        first = self.starts - self.starts[0]
        self.hashes = mix(np.add.reduceat(values, first) + length.astype(np.uint64))
        self.prefix = {}
        for n in sorted(prefixes, reverse=True):
            values[place >= n] = 0
            self.prefix[n] = mix(np.add.reduceat(values, first) + np.uint64(1000 + n))

    def counts(self) -> np.ndarray:
        return np.diff(self.of_text)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words within a text (of all its words, if it has fewer), and the text of each."""
        count = self.counts()
        h, total = self.hashes, len(self.hashes)
        rolled = np.zeros(total, np.uint64)
        for k in range(min(n, total)):
            rolled[: total - k] += h[k:] * _STEPS[k]
        text = np.repeat(np.arange(len(count)), count)
        room = self.of_text[1:][text] - np.arange(total)
        inside = room >= n
        made, owner = mix(rolled[inside]), text[inside]
        few = np.flatnonzero((count > 0) & (count < n))
        if len(few):
            first = self.of_text[few]
            short = np.zeros(len(few), np.uint64)
            for k in range(n - 1):
                has = count[few] > k
                short[has] += h[first[has] + k] * _STEPS[k]
            made = np.concatenate([made, mix(short + count[few].astype(np.uint64))])
            owner = np.concatenate([owner, few])
            order = np.argsort(owner, kind="stable")
            made, owner = made[order], owner[order]
        return made, owner
