"""Document fingerprints of statistically improbable byte windows.

Every byte window has an entropy; how rare that entropy is over the whole corpus ranks the
window, rarest first. Within every stretch of windows the best ranked one gets a point, and
windows with enough points are the features. Features go into a chain of Bloom filters, a new
one begun when one is full, and two fingerprints are compared by the bits that their filters
share beyond what chance would give.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import append_columns, mix, shuffle_partitions, slices

#: (bytes of a window, windows in a stretch, points that make a feature).
COARSE = (64, 64, 16)
#: Texts of fewer bytes than SHORT take these smaller windows as well.
FINE, SHORT = (8, 8, 2), 1024
#: Texts of fewer bytes than BRIEF also have every window of SCRAP bytes as a feature.
SCRAP, BRIEF = 3, 64
#: Entropies are told apart in thousandths of the largest; below WEAK a window ranks last.
LEVELS, WEAK = 1000, 100
#: Bits and features of one filter, and bits set for each feature.
BITS, FULL, HASHES = 2048, 160, 5
#: Share of the room above chance that two filters must overlap before they count as alike.
CUTOFF = 0.3
#: Stands for all hashes of a doc_id's texts, below each of them; hashes and ids that quantiles give back exactly.
WHOLE, EXACT = -1, 2**52
_BLOCK = 1 << 19
_LAST = np.int64(LEVELS + 1)
_ODD = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def entropies(data: np.ndarray, window: int) -> np.ndarray:
    """Entropy of each window of `data`, as a whole number of thousandths of the largest.

    Sliding by a byte changes n log n of the two bytes' counts only; the counts in question are
    found by comparing the data with itself at every shift below the window.
    """
    n = len(data) - window + 1
    if n <= 0:
        return np.zeros(0, np.int16)
    ahead, behind = np.ones(len(data), np.uint8), np.ones(len(data), np.uint8)
    for d in range(1, window):
        same = data[d:] == data[:-d]
        ahead[:-d] += same
        behind[d:] += same
    count = np.arange(window + 1, dtype=np.float64)
    weight = np.round(count * np.log2(np.maximum(count, 1)) * (1 << 12)).astype(np.int64)
    step = np.diff(weight, prepend=0)
    enter = np.cumsum(step[behind])
    leave = np.concatenate([[0], np.cumsum(step[ahead[: n - 1]])])
    held = enter[window - 1 :] - leave
    most = np.log2(window)
    return np.clip((most - held / (window * float(1 << 12))) * LEVELS / most, 0, LEVELS).astype(np.int16)


def _inside(at: np.ndarray, total: int, window: int) -> np.ndarray:
    """Which windows of a row of texts, begun at `at`, stay within one text."""
    edge = np.zeros(total + 1, np.int32)
    starts = np.maximum(at[:-1], at[1:] - window + 1)
    np.add.at(edge, starts, 1)
    np.add.at(edge, at[1:], -1)
    return np.cumsum(edge)[:total] == 0


def histogram(texts: list[bytes]) -> np.ndarray:
    """How many windows have each entropy: a row for coarse ones, one for fine ones of short texts."""
    out = np.zeros((2, LEVELS + 1), np.int64)
    for row, (window, _, _) in enumerate((COARSE, FINE)):
        own = [t for t in texts if row == 0 or len(t) < SHORT]
        at = np.concatenate([[0], np.cumsum([len(t) for t in own], dtype=np.int64)])
        data = np.frombuffer(b"".join(own), np.uint8)
        good = _inside(at, len(data), window)
        for s in range(0, len(data), _BLOCK):
            e = entropies(data[s : s + _BLOCK + window - 1], window)[:_BLOCK]
            out[row] += np.bincount(e[good[s : s + len(e)]], minlength=LEVELS + 1)
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy, rarest first; weak ones come after all others."""
    out = np.empty_like(counts)
    for row in range(len(counts)):
        order = np.lexsort((np.arange(LEVELS + 1), counts[row], np.arange(LEVELS + 1) < WEAK))
        out[row, order] = np.arange(LEVELS + 1)
    return out


def fit(documents: DataFrame, column: str = "text") -> np.ndarray:
    """Ranks from all windows of all texts; each task sends the driver's sum at most one histogram a slice."""
    schema = "level int, size int, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, LEVELS + 1), np.int64)
        for piece in slices(batches, column):
            total += histogram([(t or "").encode("utf-8", "replace") for t in piece.column(column).to_pylist()])
        size, level = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(level, pa.int32()), pa.array(size, pa.int32()), pa.array(total[size, level])],
            names=["level", "size", "n"],
        )

    counts = np.zeros((2, LEVELS + 1), np.int64)
    rows = documents.select(column).mapInArrow(run, schema).groupBy("size", "level").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # at most 2 * (LEVELS + 1) rows
        counts[r["size"], r["level"]] = r["n"]
    return ranks(counts)


def _features(texts: list[bytes], shape: tuple[int, int, int], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each chosen window, in order of place."""
    window, stretch, points = shape
    size = np.array([len(t) for t in texts], np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(texts) + bytes(window), np.uint8)
    total = int(at[-1])
    good = _inside(at, total, window)
    point = np.zeros(total + stretch, np.uint8)
    for s in range(0, total, _BLOCK):
        e = entropies(data[s : min(s + _BLOCK + stretch, total) + window - 1], window)
        fits = good[s : s + len(e)]
        key = np.where(fits, rank[e], _LAST) << np.int64(32) | np.arange(len(e))
        reach = 1
        while reach < stretch:  # least key of ever longer stretches
            key = np.minimum(key, np.concatenate([key[reach:], np.full(min(reach, len(key)), 1 << 62)])[: len(key)])
            reach *= 2
        own = min(_BLOCK, len(e), total - s)
        best = (key[:own] & 0xFFFFFFFF)[fits[:own]]
        point[s : s + len(e)] += np.bincount(best, minlength=len(e)).astype(np.uint8)
    spot = np.flatnonzero(point[:total] >= points)
    owner = np.searchsorted(at, spot, side="right") - 1
    bare = np.setdiff1d(np.flatnonzero(size >= window), owner)
    if len(bare):  # a text without a feature yet gives its window of most points
        more = np.array([at[i] + int(point[at[i] : at[i + 1]].argmax()) for i in bare])
        spot, owner = np.concatenate([spot, more]), np.concatenate([owner, bare])
        order = np.argsort(spot)
        spot, owner = spot[order], owner[order]
    views = np.lib.stride_tricks.sliding_window_view(data, window)[spot]
    words = np.ascontiguousarray(views).view(np.uint64)
    h = np.zeros(len(spot), np.uint64)
    for k in range(words.shape[1]):
        h = mix(h * _ODD[k] + words[:, k])
    return owner, h


def fingerprints(texts: list[bytes], rank: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Filters (rows of BITS / 8 bytes) and the number of features of each text.

    An empty text has no filter.
    """
    owner, h = _features(texts, COARSE, rank[0])
    short = [i for i, t in enumerate(texts) if len(t) < SHORT]
    if short:
        own, more = _features([texts[i] for i in short], FINE, rank[1])
        owner = np.concatenate([owner, np.array(short)[own]])
        h = np.concatenate([h, mix(more + np.uint64(1))])
    for i in (i for i, t in enumerate(texts) if 0 < len(t) < BRIEF):
        scraps = [texts[i][k : k + SCRAP].ljust(8, b"\0") for k in range(max(1, len(texts[i]) - SCRAP + 1))]
        owner = np.concatenate([owner, np.full(len(scraps), i)])
        h = np.concatenate([h, mix(np.frombuffer(b"".join(scraps), np.uint64) + np.uint64(2))])
    # a feature counts once in a text, where it comes first
    place = np.arange(len(h))
    order = np.lexsort((place, h, owner))
    first = np.ones(len(h), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    order = np.sort(order[first])
    order = order[np.argsort(owner[order], kind="stable")]
    owner, h = owner[order], h[order]
    n = np.bincount(owner, minlength=len(texts))
    chain = -(-n // FULL)
    begins = np.concatenate([[0], np.cumsum(chain)])
    nth = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    target = begins[owner] + nth // FULL
    bits = np.zeros((int(begins[-1]), BITS), bool)
    for k in range(HASHES):
        bits[target, (h >> np.uint64(11 * k) & np.uint64(BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    return [(packed[begins[i] : begins[i + 1]], int(n[i])) for i in range(len(texts))]


def to_string(print_: tuple[np.ndarray, int]) -> str:
    """Number of features, colon, base 64 of the filters; empty without features."""
    filters, n = print_
    return f"{n}:{base64.b64encode(filters.tobytes()).decode()}" if n else ""


def from_string(text: str) -> tuple[np.ndarray, int]:
    if not text:
        return np.zeros((0, BITS // 8), np.uint8), 0
    n, _, body = text.partition(":")
    return np.frombuffer(base64.b64decode(body), np.uint8).reshape(-1, BITS // 8), int(n)


def likeness(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int]) -> float:
    """0 to 1; 1 for equal fingerprints, 0 where only one is empty.

    Each filter of the shorter chain counts with its best match in the longer one, by its
    number of features.
    """
    if a[1] > b[1]:
        a, b = b, a
    if a[1] == b[1] and np.array_equal(a[0], b[0]):
        return 1.0
    if not a[1]:
        return 0.0
    set_b = np.bitwise_count(b[0]).sum(axis=1, dtype=np.int64)
    total = 0.0
    for k, one in enumerate(a[0]):
        set_a = int(np.bitwise_count(one).sum(dtype=np.int64))
        most = np.minimum(set_a, set_b)
        chance = set_a * set_b / BITS
        least = np.minimum(chance + CUTOFF * (most - chance), most - 1)
        shared = np.bitwise_count(b[0] & one).sum(axis=1, dtype=np.int64)
        score = np.clip((shared - least) / (most - least), 0, 1)
        total += float(score.max()) * min(FULL, a[1] - k * FULL)
    return min(1.0, total / a[1])


def fingerprint(df: DataFrame, rank: np.ndarray, column: str = "text", into: str = "fingerprint") -> DataFrame:
    """Adds `into`, the fingerprint of each whole text; null counts as empty, which has the empty fingerprint."""
    def make(texts: list[str | None]) -> list:
        return [[to_string(p) for p in fingerprints([(t or "").encode("utf-8", "replace") for t in texts], rank)]]

    return append_columns(df, column, make, [T.StructField(into, T.StringType())])


def cut_points(rows: DataFrame, n: int) -> list[tuple[int, int]]:
    """At most about n (key, hash) at even ranks of rows by falling key, then rising hash, each where some row lies.

    A key that holds several ranks is parted by its texts' hashes, from the least on; any other is taken
    whole, with WHOLE for a hash.
    """
    found = rows.agg(
        F.percentile_approx("key", [i / n for i in range(1, n)] or [1.0], max(10_000, 10 * n)).alias("cuts"),
        F.max("key").alias("top"),
    ).first()
    if found["top"] is None:
        return [(0, WHOLE)]
    cuts = found["cuts"] or []
    if max(map(abs, [c for c in cuts if c > -(2**63)] + [found["top"]])) > EXACT:  # quantiles are doubles; take ids that are there
        cuts = list(rows.agg(*[F.max(F.when(F.col("key") <= c, F.col("key"))) for c in cuts]).first())
    cuts = Counter(c for c in cuts if c is not None)
    hot = {k: c for k, c in cuts.items() if c > 1}
    points = {(k, WHOLE) for k in {*cuts, found["top"]} if k not in hot}
    if hot:  # at most half as many keys as ranks
        at = [i / max(hot.values()) for i in range(1, max(hot.values()))]
        parts = rows.filter(F.col("key").isin(*hot)).groupBy("key").agg(F.min("hash").alias("low"), F.percentile_approx("hash", at, 10_000).alias("hashes"))
        for r in parts.collect():
            own = r["hashes"][:: -(-len(r["hashes"]) // hot[r["key"]])]
            points |= {(r["key"], h) for h in (r["low"], *own)}
    return sorted(points, key=lambda p: (-p[0], p[1]))


def with_next(documents: DataFrame) -> DataFrame:
    """Rows in partitions by descending doc_id, each partition closed by the row that comes next.

    A partition begins with the rows at its cut point, which are sent to the one before it as well,
    marked `halo`; the greatest doc_id follows the last. A null doc_id comes last; rows of one
    doc_id are ordered by a hash of their texts, so that many of them are many partitions.
    """
    spark = documents.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), key.alias("key"), F.xxhash64(text).bitwiseAND(F.lit(EXACT - 1)).alias("hash"))
    points = cut_points(rows, shuffle_partitions(spark))
    side = int(len(points) ** 0.5) + 1  # found in two steps: the stretch, then the place in it
    long = lambda x: f"{x}L" if x > -(2**63) else "(-9223372036854775807L - 1L)"
    pairs = lambda ps: f"array({', '.join(f'struct({long(k)} AS k, {long(h)} AS h)' for k, h in ps)})"
    upto = "p -> p.k > key OR (p.k = key AND p.h <= hash)"
    rows = rows.withColumn("stretch", F.expr(f"greatest(size(filter({pairs(points[::side])}, {upto})) - 1, 0)"))
    within = f"size(filter(slice({pairs(points)}, stretch * {side} + 1, {side}), {upto}))"
    rows = rows.withColumn("part", F.expr(f"cast(stretch * {side} + {within} - 1 as int)"))
    own_point = f"element_at({pairs(points)}, part + 1)"  # the last one up to the row, so the only one that it can lie on
    begins = F.expr(f"{own_point}.k = key AND {own_point}.h IN ({long(WHOLE)}, hash)")
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("halo"))
    sent = F.struct(((F.col("part") + (len(points) - 1)) % len(points)).alias("part"), F.lit(True).alias("halo"))
    dealt = rows.withColumn("to", F.explode(F.when(begins, F.array(own, sent)).otherwise(F.array(own))))
    return (
        dealt.select("doc_id", "text", "key", "hash", "to.part", "to.halo")
        .repartitionById(len(points), F.col("part"))
        .sortWithinPartitions("part", "halo", F.desc("key"), "hash", "text")
        .drop("key", "hash")
    )


def edited(text: str, after: str) -> str:
    """The last third of the code points replaced by as many first ones (or all) of the next text."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def compare(documents: DataFrame) -> DataFrame:
    """Per row: fingerprints of its text and of its edited text, and likeness to that and to the next text.

    doc_id is a whole number. The next document is the one of the next smaller doc_id; after the last comes
    the first, and a single document is its own next one. Null texts count as empty, a null doc_id comes
    last; rows of one doc_id follow one another by a hash of their texts, equal rows stay as many. Other columns are not looked at; an empty table gives none.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rank = fit(documents)
    schema = T.StructType(
        [
            T.StructField("doc_id", documents.schema["doc_id"].dataType),
            T.StructField("n_chars", T.LongType()),
            T.StructField("edited_sha256", T.StringType()),
            T.StructField("fingerprint", T.StringType()),
            T.StructField("edited_fingerprint", T.StringType()),
            T.StructField("near_edited", T.DoubleType()),
            T.StructField("near_next", T.DoubleType()),
        ]
    )

    def made(rows: list[tuple], after: str) -> pa.RecordBatch:
        """Rows of one slice that follow one another; after: the text that comes next."""
        texts = [r[1] for r in rows] + [after]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        raw = [t.encode("utf-8", "replace") for t in (*texts, *changed)]
        prints = fingerprints(raw, rank)
        own, other = prints[: len(texts)], prints[len(texts) :]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], id_type),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in raw[len(texts) :]]),
                pa.array([to_string(p) for p in own[:-1]]),
                pa.array([to_string(p) for p in other]),
                pa.array([likeness(a, b) for a, b in zip(own, other)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
            ],
            names=schema.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, size = None, [], 0
        for piece in slices(batches, "text", 1 << 20):
            columns = (piece.column(c).to_pylist() for c in ("doc_id", "text", "part", "halo"))
            for doc_id, text, number, halo in zip(*columns):
                if rows and (halo or size > 1 << 21) and number == part:
                    yield made(rows, text)
                    rows, size = [], 0
                if not halo:
                    part = number
                    rows.append((doc_id, text))
                    size += len(text)
        if rows:
            raise RuntimeError(f"partition {part} of rows lacks the one that comes next")

    id_type = to_arrow_type(documents.schema["doc_id"].dataType)
    return with_next(documents).mapInArrow(run, schema)
