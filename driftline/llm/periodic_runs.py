"""Periodic runs of words in whole texts, by Lyndon roots.

A run is a stretch of words with smallest period q that no neighbouring word extends. Under one of
the two orders of the alphabet (as it is, and reversed) every Lyndon root of a run is the longest
Lyndon word that starts where the root does. So a stack, scanned from right to left under either
order, gives all candidates: (i, p), the start and length of the longest Lyndon word at i. Two
suffixes are compared, and a candidate is extended both ways, by the longest common extension of
two places: a binary search over rolling hashes, whose outcome is then verified word by word, so
that a collision of hashes changes nothing.

Before that, vectorised over many texts, places are set aside that no wanted run can hold: in a
run of at least four periods and six words, each three words in succession come three times.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import SPACES, mix, slices, without

#: A run has so many words at least, and so many times its period.
LEAST, TIMES = 6, 4
#: Rounds in which places are set aside.
ROUNDS = 4
MODULUS, BASE = (1 << 61) - 1, 0x1D3F9A6C5B27E481 % ((1 << 61) - 1)
_STEPS = np.random.default_rng(12).integers(1, 2**63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Extensions:
    """Longest common extensions of places of one sequence of word numbers, to the right and to the left."""

    def __init__(self, ids: list[int]):
        self.ids, self.array, self.n = ids, np.array(ids, np.int64), len(ids)
        self.hash = list(accumulate(ids, lambda h, w: (h * BASE + w + 1) % MODULUS, initial=0))
        self.power = list(accumulate(repeat(BASE, self.n), lambda a, b: a * b % MODULUS, initial=1))
        #: Of each distance: where words that far apart were last verified to be equal, and up to where.
        self.known: dict[int, tuple[int, int]] = {}

    def _same(self, i: int, j: int, k: int) -> bool:
        """Whether the hashes of the k words from i and from j agree."""
        h = self.hash
        return (h[i + k] - h[j + k] - (h[i] - h[j]) * self.power[k]) % MODULUS == 0

    def _longest(self, most: int, same) -> int:
        """The largest k up to most for which same(k), if it holds for all smaller ones: steps that double, then halves."""
        low, high = 0, 1
        while high <= most and same(high):
            low, high = high, 2 * high
        high = min(high, most + 1)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if same(mid) else (low, mid)
        return low

    def right(self, i: int, j: int) -> int:
        """Words that agree from i and from j > i on."""
        start, stop = self.known.get(j - i, (-1, -1))
        if start <= i <= stop:
            return stop - i
        if 0 < start - i <= 8 and self.ids[i:start] == self.ids[j : j + start - i]:
            self.known[j - i] = (i, stop)
            return stop - i
        k = self._longest(self.n - j, lambda k: self._same(i, j, k))
        upto = start if i < start and stop == i + k else i + k
        differ = np.flatnonzero(self.array[i:upto] != self.array[j : j + upto - i])
        if len(differ):
            k = int(differ[0])
        self.known[j - i] = (i, i + k)
        return k

    def left(self, i: int, j: int) -> int:
        """Words that agree before i and before j > i."""
        k = self._longest(i, lambda k: self._same(i - k, j - k, k))
        differ = np.flatnonzero(self.array[i - k : i] != self.array[j - k : j])
        return k - 1 - int(differ[-1]) if len(differ) else k


def lyndon_runs(ids: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least `least` words and `times` (two or more) periods, by start, then period."""
    n, same = len(ids), Extensions(ids)
    found: set[tuple[int, int, int]] = set()
    for sign in (1, -1):
        stack: list[int] = []
        latest: dict[int, tuple[int, int]] = {}
        for i in range(n - 1, -1, -1):
            own = ids[i]
            while stack:
                top = stack[-1]
                step = ids[top] - own
                if not step:
                    k = same.right(i, top)
                    if top + k == n:
                        break
                    step = ids[top + k] - ids[i + k]
                if step * sign < 0:
                    break
                stack.pop()
            end = stack[-1] if stack else n
            stack.append(i)
            p = end - i
            if end >= n or ids[end] != own or i + times * p > n + p - 1:
                continue
            start, stop = latest.get(p, (n, 0))
            if start <= i and i + 2 * p <= stop:
                continue
            k = same.right(i, end)
            if k <= (times - 2) * p:
                continue
            start, stop = i - same.left(i, end), end + k
            latest[p] = (start, stop)
            if stop - start >= max(least, times * p):
                found.add((start, stop - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _candidates(words: list[bytes], ends: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (from, to) of words, none across the end of a text, outside which no wanted run has a word."""
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    if len(h) < 3:
        return []
    three = h[:-2] * _STEPS[0] + h[1:-1] * _STEPS[1] + h[2:] * _STEPS[2]
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    at = np.flatnonzero(text[:-2] == text[2:])
    stretch, three = text[at].astype(np.uint64), three[at]
    for _ in range(ROUNDS):
        key = mix(three + stretch * _STEPS[3])
        order = np.sort(key)
        often = np.unique(order[2:][order[2:] == order[:-2]]) if len(order) > 2 else order[:0]
        hot = np.isin(key, often)
        if hot.all():
            break
        at, three, text_of = at[hot], three[hot], stretch[hot]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (text_of[1:] != text_of[:-1])
        number = np.cumsum(new) - 1
        long = np.bincount(number, minlength=1)[number] >= LEAST - 2 if len(at) else new
        at, three, stretch = at[long], three[long], number[long].astype(np.uint64)
    edge = np.flatnonzero(np.diff(stretch.astype(np.int64)) | (np.diff(at) > 1)) if len(at) else at
    first, last = np.concatenate([at[:1], at[edge + 1]]), np.concatenate([at[edge], at[-1:]])
    return [(a, b + 3) for a, b in zip(first.tolist(), last.tolist()) if b + 3 - a >= LEAST]


def runs_of(texts: list[str | None]) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Of each text: its words, and its runs as (start, length, period) by start, then period."""
    split = [(t or "").encode("utf-8", "replace").split() for t in texts]
    ends = np.cumsum([len(w) for w in split])
    words = [x for w in split for x in w]
    parts: dict[int, list[tuple[int, int]]] = {}
    for a, b in _candidates(words, ends):
        parts.setdefault(int(np.searchsorted(ends, a, side="right")), []).append((a, b))
    for k, own in enumerate(split):
        runs, first = [], int(ends[k]) - len(own)
        for a, b in parts.get(k, []):
            number: dict[bytes, int] = {}
            ids = [number.setdefault(w, len(number)) for w in words[a:b]]
            runs += [(a - first + s, length, p) for s, length, p in lyndon_runs(ids)]
        yield own, sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(documents: DataFrame) -> DataFrame:
    """documents with runs (array of start, length, period, in words) and collapsed: the words, one space between, without repeats.

    Words are what ASCII white space parts, as they are written. A run has a smallest period q and
    at least max(6, 4q) words; of each run the first q words stay, and a word goes if any run has it
    after those. Null and empty texts have no runs and collapse to the empty text. A row's result
    depends on its own text alone, however long, so repeated rows have equal ones. Columns of these
    two names are replaced, all others stay.
    """
    kept = without(documents, ("runs", "collapsed"))
    run = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    schema = T.StructType([*kept.schema.fields, T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])
    arrow = pa.list_(pa.struct([(n, pa.int64()) for n in run.names]))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            runs, texts = [], []
            for words, own in runs_of(piece.column("text").to_pylist()):
                if own:
                    stay = np.ones(len(words), bool)
                    for start, length, period in own:
                        stay[start + period : start + length] = False
                    words = compress(words, stay)
                runs.append([dict(zip(run.names, r)) for r in own])
                texts.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(runs, arrow), pa.array(texts, pa.string())], names=schema.names)

    return kept.mapInArrow(made, schema)


def planted(documents: DataFrame) -> DataFrame:
    """(doc_id, text): texts whose words repeat from some place on, for a tenth of all doc_ids, by the checksum of the id; the others as they are."""
    space = "".join(f"\\\\x{b:02X}" for b in np.flatnonzero(SPACES))
    return (
        documents.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
        .withColumn("g", F.expr("h DIV 10"))
        .withColumn("words", F.expr(f"CASE WHEN h % 10 = 0 THEN filter(split(text, '[{space}]+'), x -> x != '') END"))
        .withColumn("n", F.size("words"))
        .withColumn("a", F.expr("CASE WHEN n > 0 THEN CAST(g % n AS int) END"))
        .withColumn("p", F.expr("CAST(1 + (n - a) DIV (3 + g % 8) AS int)"))
        .select(
            "doc_id",
            F.expr("CASE WHEN n > 0 THEN array_join(transform(words, (w, i) -> IF(i >= a, words[a + (i - a) % p], w)), ' ') ELSE text END").alias("text"),
        )
    )


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period; nulls without a run), digests of all runs and of the collapsed text.

    Texts come from `planted`; a null doc_id plants nothing. Nulls, empty texts and repeated rows are as in `collapse`.
    """
    best = F.expr("array_min(transform(runs, r -> struct(-r.length AS minus, r.start AS start, r.period AS period)))")
    rows = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return collapse(planted(documents)).withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.minus")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("-1000 * best.minus DIV best.period").alias("exponent_milli"),
        F.sha2(rows, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
