"""Benchmark decontamination: word-pair seeds, then local alignment.

Every pair of neighbouring words of an item is a seed, found in a text side by side or around one
word put in between. Where the seeds lie dense enough, the passage around them is aligned with
the item (Smith-Waterman over words), so that edited and paraphrased copies score by how much of
the item they still follow. From LEAST on, no alignment is missed: see `dense`.

The benchmark is a stated set of queries against all texts, taken in blocks of bounded size;
texts are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import _STEPS, PUNCTUATION, Words, aside, cut, mix, slices, without

#: Words from which an item has seeds.
NGRAM = 3
#: Score of a pair of equal words, of unequal ones, and of a word left out on either side.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of an item's own score from which a text counts as holding it.
LEAST = 0.5
#: Items, and words of items, broadcast at a time.
BLOCK, BLOCK_WORDS = 20_000, 2_000_000
#: Seeds of some texts that are in memory at a time, if no single text has more.
HITS = 500_000


def matches_type(item_id: T.DataType) -> T.ArrayType:
    fields = [("item_id", item_id), ("score", T.DoubleType()), ("start", T.IntegerType()), ("end", T.IntegerType())]
    return T.ArrayType(T.StructType([T.StructField(*f) for f in fields]))


class Items:
    """Words of the items, and their seeds: hash, item, place, in order of hash."""

    def __init__(self, ids: list, texts: list[str | None]):
        w = Words(texts, PUNCTUATION)
        self.ids = ids
        self.words = [w.hashes[a:b] for a, b in zip(w.of_text[:-1], w.of_text[1:])]
        self.size = w.counts()
        self.short: dict[tuple, list[int]] = {}
        for i in np.flatnonzero((self.size > 0) & (self.size < NGRAM)).tolist():
            self.short.setdefault(tuple(self.words[i].tolist()), []).append(i)
        gram, at, item = _pairs(w, 1)
        long = self.size[item] >= NGRAM
        outer, outer_at, outer_item = _pairs(w, 2)  # of three words, the first and last are half of the score
        three = self.size[outer_item] == NGRAM
        gram = np.concatenate([gram[long], outer[three]])
        item = np.concatenate([item[long], outer_item[three]])
        place = np.concatenate([at[long], outer_at[three]]) - w.of_text[item]
        order = np.lexsort((item, gram))
        self.gram, self.item, self.place = gram[order], item[order], place[order]


def _pairs(w: Words, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all pairs of words `step` apart within a text, the number of the first word and the text of each."""
    h, count = w.hashes, w.counts()
    owner = np.repeat(np.arange(len(count)), count)
    at = np.flatnonzero(owner[:-step] == owner[step:])
    return mix(h[at] * _STEPS[0] + h[at + step] * _STEPS[1]), at, owner[at]


def _hits(grams: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places in `grams` of those that are among the sorted `known`."""
    if not len(known) or not len(grams):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    return np.flatnonzero(known[at] == grams)


def slack(size, least: float):
    """Most words that a text may put between those of an item of `size` words and still score `least`."""
    return np.ceil(MATCH * (1 - least) * size).astype(np.int64)


def dense(key: np.ndarray, weight: np.ndarray, reach: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which seeds lie in a stretch of `reach` words whose weights sum to `need`; key is sorted by text, item and place.

    Of m matched words, let s0 follow their predecessor at once in both sequences, s1 at once in
    the item and after one more word in the text, p after further words in the item, and q at once
    in the item and after two or more in the text. Half of the score or more means
    2m - s1 - p - 2q >= size, and m + p <= size, hence 3 s0 + s1 >= size - 3.
    """
    first = np.searchsorted(key, key - reach)
    total = np.concatenate([[0], np.cumsum(weight)])
    ends = np.flatnonzero(total[1:] - total[first] >= need)
    marks = np.bincount(first[ends], minlength=len(key) + 1) - np.bincount(ends + 1, minlength=len(key) + 1)
    return np.cumsum(marks)[:-1] > 0


def seeds(w: Words, items: Items, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, item and begin of the item of all seeds in stretches that hold enough of them, some texts at a time."""
    parts = []
    for step, worth in ((1, 3), (2, 1)):
        gram, at, owner = _pairs(w, step)
        hit = _hits(gram, items.gram)
        low = np.searchsorted(items.gram, gram[hit])
        number = np.searchsorted(items.gram, gram[hit], side="right") - low
        parts.append((owner[hit], at[hit] - w.of_text[owner[hit]], low, number, np.full(len(hit), worth)))
    owner, at, low, number, worth = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(owner, kind="stable")
    owner, at, low, number, worth = owner[order], at[order], low[order], number[order], worth[order]
    upto = np.cumsum(number)
    room = int(w.counts().max(initial=0)) + 3 * int(items.size.max(initial=0)) + 3
    start = 0
    while start < len(owner):  # texts are not parted
        stop = int(np.searchsorted(upto, (upto[start - 1] if start else 0) + HITS, side="right"))
        stop = int(np.searchsorted(owner, owner[max(start, stop - 1)], side="left" if stop > start and owner[stop - 1] > owner[start] and stop < len(owner) else "right"))
        n = number[start:stop]
        one = np.repeat(low[start:stop], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        text, place, weight = (np.repeat(x[start:stop], n) for x in (owner, at, worth))
        item = items.item[one]
        size = items.size[item]
        reach = size + slack(size, least)
        key = (text * len(items.ids) + item) * room + place
        order = np.argsort(key, kind="stable")
        need = np.maximum(1, size - 3 if least >= 0.5 else 1)
        key = key + 3 * int(items.size.max())  # what lies `reach` before stays within the same text and item
        live = order[dense(key[order], weight[order], reach[order], need[order])]
        yield text[live], item[live], place[live] - items.place[one[live]]
        start = stop


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of two word sequences: share of the item's own score, first and last + 1 word of it.

    Row by row; a chain of left-out passage words is a running maximum.
    """
    n = len(passage)
    slope = np.arange(n + 1) * -GAP
    above = np.zeros(n + 1, np.int64)
    begin_above = np.arange(n + 1)
    best, span = 0, (0, 0)
    for word in item:
        step = np.where(passage == word, MATCH, MISMATCH)
        row, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
        diagonal, up = above[:-1] + step, above[1:] + GAP
        row[1:] = np.maximum(np.maximum(diagonal, up), 0)
        begin[1:] = np.where(row[1:] == 0, begin[1:], np.where(diagonal >= up, begin_above[:-1], begin_above[1:]))
        lifted = row + slope
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        across = top - slope
        begin = np.where(across > row, begin[source], begin)
        row = np.maximum(row, across)
        at = int(row.argmax())
        if row[at] > best:
            best, span = int(row[at]), (int(begin[at]), at)
        above, begin_above = row, begin
    return best / (MATCH * max(1, len(item))), *span


def search(texts: list[str | None], items: Items, least: float) -> list[list[dict]]:
    """Items that each text holds, with the best score and its span in code points."""
    w = Words(texts, PUNCTUATION)
    found: list[list[dict]] = [[] for _ in texts]
    near: dict[tuple[int, int], list[int]] = {}
    for text, item, begin in seeds(w, items, least):
        for t, i, p in zip(text.tolist(), item.tolist(), begin.tolist()):
            near.setdefault((t, i), []).append(p)
    count = w.counts()
    for t in np.flatnonzero((count > 0) & (count < NGRAM)).tolist() if items.short else []:
        for i in items.short.get(tuple(w.hashes[w.of_text[t] : w.of_text[t + 1]].tolist()), []):
            near[t, i] = [0]
    for (t, i), begins in near.items():
        item = items.words[i]
        words = w.hashes[w.of_text[t] : w.of_text[t + 1]]
        spare = int(slack(len(item), least)) + 1
        best = (0.0, 0, 0)
        at, stop = None, 0
        for begin in [*sorted(set(begins)), None]:  # touching stretches are aligned as one
            if at is not None and (begin is None or begin - spare > stop):
                score, a, b = align(item, words[at:stop])
                if score > best[0]:
                    best = (score, at + a, at + b)
                at = None
            if begin is not None:
                at = max(0, begin - spare) if at is None else at
                stop = min(len(words), max(stop, begin + len(item) + spare))
        if best[0] >= least:
            first, last = w.of_text[t] + best[1], w.of_text[t] + best[2] - 1
            base = w.text_at[t]
            start = len(w.raw[base : w.starts[first]].decode())
            end = start + len(w.raw[w.starts[first] : w.ends[last]].decode())
            found[t].append({"item_id": items.ids[i], "score": best[0], "start": start, "end": end})
    for one in found:
        one.sort(key=lambda x: x["item_id"])
    return found


def blocks(benchmark: DataFrame, items: int = BLOCK, words: int = BLOCK_WORDS) -> Iterator[tuple[list, list[str]]]:
    """The benchmark in blocks of about so many items and words at most; null ids or texts are no items."""
    rows = cut(benchmark.select("item_id", "text").dropna().distinct())
    n, size = rows.agg(F.count("*"), F.sum(F.size(F.split("text", r"\s+")))).first()
    number = math.ceil(max(n / items, (size or 0) / words))
    for k in range(number):
        block = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == k).orderBy("item_id", "text").collect()
        if block:
            yield [r["item_id"] for r in block], [r["text"] for r in block]


def matched(documents: DataFrame, benchmark: DataFrame, least: float = LEAST, column: str = "text", block: int = BLOCK) -> DataFrame:
    """documents with `matches`, the items held by each text; rows without any have an empty list.

    Null and empty texts hold nothing, and so do all texts if the benchmark is empty. An item
    of fewer than NGRAM words is held by texts of the same few words only. Repeated rows
    are matched alike. A column `matches` is replaced. An item_id may be of any type that sorts.
    """
    kind = matches_type(benchmark.schema["item_id"].dataType)
    out = without(documents, ["matches"]).withColumn("matches", F.array().cast(kind))
    names = [c for c in out.columns if c != "matches"]
    schema = out.schema
    for ids, texts in blocks(benchmark, block):
        items = Items(ids, texts)
        shared = documents.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for piece in slices(batches, column):
                new = search(piece.column(column).to_pylist(), shared.value, least)
                old = piece.column("matches").to_pylist()
                both = [sorted(a + b, key=lambda x: x["item_id"]) for a, b in zip(old, new)]
                made = pa.array(both, piece.schema.field("matches").type)
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(c) for c in names], made], names=[*names, "matches"]
                )

        out = out.select(*names, "matches").mapInArrow(run, schema)
    return out


def leaks(documents: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """One row for each text and item that it holds: doc_id, item_id, score, start, end.

    Null and empty texts hold none; repeated rows have theirs each; other columns are not looked at; an empty table gives no rows.
    """
    found = matched(documents.select("doc_id", "text"), benchmark, least)
    return found.select("doc_id", F.inline("matches"))


def clean(documents: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents that hold no item, with all their columns, one named `matches` too. Nulls, empty tables and repeats are as in `matched`."""
    rows, back = aside(documents, ["matches"])
    return back(matched(rows, benchmark, least).filter(F.size("matches") == 0))
