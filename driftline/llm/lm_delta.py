"""Cross-entropy difference of two matched n-gram models over one vocabulary.

The vocabulary is every word of the corpus. The target model learns from the target rows, the
background model from all rows; both have a unigram and a bigram, smoothed by added counts, and a
token's loss is the mean of its two losses. A document's score is its mean loss per token under
the target less that under the background.

Such a difference is a sum of one number for each word and one for each pair of words, found from
the corpus counts of that word or pair. So documents are cut into their n-grams, n-grams are dealt
into buckets by hash, and a bucket counts them, values them and sums up by document. Texts stay
where they are, and nothing of the corpus goes through the driver but totals and the n-grams that
make up SHARE or more of all, which number 1 / SHARE at most: they are counted beforehand and
broadcast, so that no bucket holds a hot one. Pairs are first counted together in CELLS cells by
hash; a pair can be hot only if its cell is, so only pairs of hot cells are counted one by one, in
executors, and only those that prove hot are gathered, however the texts are parted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import _STEPS, PUNCTUATION, Words, cut, mix, slices

#: Added to each count of a word, and of a pair of words.
ADDED, ADDED_PAIR = 1.0, 0.01
#: An n-gram of so large a share of all tokens is hot.
SHARE = 1e-5
#: N-grams of a bucket, on average; tokens that are counted or dealt out together.
BUCKET, CHUNK = 2_000_000, 1_000_000
#: Cells in which pairs are counted together, and the stretches of cells that tasks add up.
CELLS, SEGMENTS = 1 << 20, 256
#: Target ids that may be broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_IDS = 200_000
#: Documents of a chunk at most: their number and the target mark share 16 bits.
DOCS = 1 << 15
#: Stands for the word before a text.
BEGIN = np.uint64(0x9E3779B97F4A7C15)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words: ASCII but letters and digits.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def marked(documents: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, text, target 0/1): target has the doc_ids of the target rows. Texts that had to be shuffled are written, to be so once."""
    ids = target.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    few = ids.count() <= BROADCAST_IDS
    flag = ids.withColumn("target", F.lit(1))
    rows = documents.select("doc_id", "text").join(F.broadcast(flag) if few else flag, "doc_id", "left").select(
        "doc_id", "text", F.coalesce("target", F.lit(0)).alias("target")
    )
    return rows if few else cut(rows)


class Grams:
    """Words and pairs of some texts: key, text and target mark of each token; a pair is a word with the one before."""

    def __init__(self, piece: pa.RecordBatch):
        w = Words(piece.column("text").to_pylist(), PUNCTUATION)
        self.count = w.counts()
        self.ids = piece.column("doc_id")
        self.aimed = piece.column("target").to_numpy(zero_copy_only=False) > 0
        self.text = np.repeat(np.arange(len(self.count)), self.count)
        self.word = w.hashes
        before = np.concatenate([[BEGIN], w.hashes[:-1]]) if len(w.hashes) else w.hashes
        self.last = np.zeros(len(w.hashes), bool)
        filled = self.count > 0
        before[w.of_text[:-1][filled]] = BEGIN
        self.last[w.of_text[1:][filled] - 1] = True
        self.pair = mix(before * _STEPS[0] + w.hashes * _STEPS[1])


def _counted(keys: np.ndarray, aimed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, at = np.unique(keys, return_inverse=True)
    return key, np.bincount(at, minlength=len(key)), np.bincount(at, aimed, minlength=len(key)).astype(np.int64)


def _rows(kind: int, key: np.ndarray, n: np.ndarray, aimed: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(n), pa.array(aimed)],
        names=["kind", "key", "n", "n_target"],
    )


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[list[Grams]]:
    """Slices in lists of at least so many tokens, but the last, and of at most DOCS documents."""
    held, total, texts = [], 0, 0
    for wide in slices(batches, "text"):
        for start in range(0, wide.num_rows, DOCS):
            g = Grams(wide.slice(start, DOCS))
            if held and (total >= size or texts + len(g.count) > DOCS):
                yield held
                held, total, texts = [], 0, 0
            held.append(g)
            total += len(g.word)
            texts += len(g.count)
    if held:
        yield held


def word_counts(rows: DataFrame) -> DataFrame:
    """(kind, key, n, n_target): counts of every word (kind 0), and of texts with words (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in chunks(batches):
            aimed = np.concatenate([g.aimed[g.text] for g in held])
            yield _rows(0, *_counted(np.concatenate([g.word for g in held]), aimed))
            begun = np.concatenate([g.aimed[g.count > 0] for g in held])
            yield _rows(2, np.zeros(1, np.uint64), np.array([len(begun)]), np.array([begun.sum()]))

    found = rows.mapInArrow(run, "kind int, key long, n long, n_target long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


class Hot:
    """Counts of hot n-grams of one kind, by key."""

    def __init__(self, rows: pa.Table):
        key = rows.column("key").to_numpy().view(np.uint64)
        order = np.argsort(key)
        self.key = key[order]
        self.n, self.aimed = (rows.column(c).to_numpy()[order] for c in ("n", "n_target"))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key, and whether it is one of these."""
        if not len(self.key):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return at, self.key[at] == keys

    def counts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which keys are of these, and the counts of those."""
        at, there = self.find(keys)
        if not len(self.key):
            return there, np.zeros(0), np.zeros(0)
        return there, self.n[at[there]], self.aimed[at[there]]


def _cell(pairs: np.ndarray) -> np.ndarray:
    return (pairs >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def hot_cells(rows: DataFrame, least: float) -> np.ndarray:
    """Which of the CELLS cells have `least` pairs or more. A task sends its counts of all cells, in SEGMENTS rows."""
    size = CELLS // SEGMENTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int64)
        for piece in slices(batches, "text"):
            n += np.bincount(_cell(Grams(piece).pair), minlength=CELLS)
        if n.any():
            parts = n.astype(np.uint32 if n.max() < 1 << 32 else np.uint64).reshape(SEGMENTS, size)
            yield pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS), pa.int32()), pa.array([x.tobytes() for x in parts])], names=["segment", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, counts in zip(*[batch.column(c).to_pylist() for c in ("segment", "counts")]):
                own = total.setdefault(segment, np.zeros(size, np.int64))
                own += np.frombuffer(counts, np.uint32 if len(counts) == 4 * size else np.uint64).astype(np.int64)
        hot = [np.packbits(x >= least).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(hot, pa.binary())], names=["segment", "hot"])

    found = rows.mapInArrow(count, "segment int, counts binary").repartition("segment").mapInArrow(add, "segment int, hot binary")
    out = np.zeros((SEGMENTS, size), bool)
    for segment, hot in found.collect():
        out[segment] = np.unpackbits(np.frombuffer(hot, np.uint8))[:size]
    return out.ravel()


def hot_pairs(rows: DataFrame, least: float) -> Hot:
    """Exact counts of the pairs that have `least` or more, found among those of hot cells; the others are never gathered."""
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(hot_cells(rows, least)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.unpackbits(shared.value)[:CELLS] > 0
        for held in chunks(batches):
            aimed = np.concatenate([g.aimed[g.text] for g in held])
            pair = np.concatenate([g.pair for g in held])
            chosen = hot[_cell(pair)]
            yield _rows(1, *_counted(pair[chosen], aimed[chosen]))

    found = rows.mapInArrow(run, "kind int, key long, n long, n_target long").groupBy("key")
    return Hot(found.agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target")).filter(F.col("n") >= least).toArrow())


class Value:
    """What words and pairs add to the difference, in nats, from their counts (all, target)."""

    def __init__(self, tokens: int, aimed: int, words: int, texts: int, aimed_texts: int):
        self.words = words
        self.token = (math.log(aimed + ADDED * words) - math.log(tokens + ADDED * words)) / 2 if words else 0.0
        self.text = self.before(np.array([texts]), np.array([aimed_texts]))[0] if words else 0.0

    def word(self, n: np.ndarray, aimed: np.ndarray) -> np.ndarray:
        return (np.log(n + ADDED) - np.log(aimed + ADDED)) / 2 + self.token

    def pair(self, n: np.ndarray, aimed: np.ndarray) -> np.ndarray:
        return (np.log(n + ADDED_PAIR) - np.log(aimed + ADDED_PAIR)) / 2

    def before(self, n: np.ndarray, aimed: np.ndarray) -> np.ndarray:
        """Of a word with another after it, of its text."""
        return (np.log(aimed + ADDED_PAIR * self.words) - np.log(n + ADDED_PAIR * self.words)) / 2


def compare(documents: DataFrame, target: DataFrame, share: float = SHARE, bucket: int = BUCKET) -> DataFrame:
    """Per row: doc_id, n_tokens, delta (rounded to six places), below 0 where the target model fits better.

    target has the doc_ids of the target rows. Null, empty and wordless texts have no tokens and a difference of 0;
    repeated rows count and are scored as often as they come; a null doc_id is never a target. Other columns are
    not looked at. Words are known by 64 bits of hash, pairs too.
    """
    spark = documents.sparkSession
    rows = marked(documents, target)
    counts = cut(word_counts(rows))
    totals = counts.groupBy("kind").agg(F.sum("n"), F.sum("n_target"), F.count("*")).collect()
    totals = {kind: numbers for kind, *numbers in totals}
    tokens, aimed, words = totals.get(0, (0, 0, 0))
    value = Value(tokens, aimed, words, *totals.get(2, (0, 0))[:2])
    hot_words = Hot(counts.filter((F.col("kind") == 0) & (F.col("n") >= share * tokens)).select("key", "n", "n_target").toArrow())
    shared = spark.sparkContext.broadcast((value, hot_words, hot_pairs(rows, share * tokens)))
    buckets = max(1, math.ceil(2 * tokens / bucket))
    id_type = documents.schema["doc_id"].dataType
    dealt_schema = T.StructType.fromDDL("bucket int, kind int, chunk long, keys binary, texts binary, counts array<long>, sums array<double>")
    dealt_schema = T.StructType([*dealt_schema.fields, T.StructField("ids", T.ArrayType(id_type))])
    valued_schema = T.StructType([f for f in dealt_schema.fields if f.name not in ("bucket", "kind", "keys")])
    result = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_tokens", T.LongType()), T.StructField("total", T.DoubleType())])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each chunk: ids, token counts and sums of hot n-grams in one row, the other n-grams in a row for each bucket.

        Kind 0: words with another after them, 1: last words of a text, 2: pairs, 3: the chunk's texts.
        """
        from pyspark import TaskContext

        value, hot_words, hot_pairs = shared.value
        number = TaskContext.get().partitionId() << 32
        for held in chunks(batches):
            number += 1
            count = np.concatenate([g.count for g in held])
            total = np.where(count > 0, value.text, 0.0)
            text = np.concatenate([g.text + k for g, k in zip(held, np.cumsum([0, *[len(g.count) for g in held]]))])
            mark = (text + DOCS * np.concatenate([g.aimed[g.text] for g in held])).astype(np.uint16)
            word, pair, last = (np.concatenate([getattr(g, x) for g in held]) for x in ("word", "pair", "last"))
            hot, n, a = hot_words.counts(word)
            total += np.bincount(text[hot], value.word(n, a) + np.where(last[hot], 0, value.before(n, a)), minlength=len(total))
            known, n, a = hot_pairs.counts(pair)
            total += np.bincount(text[known], value.pair(n, a), minlength=len(total))
            made: dict[str, list] = {n: [] for n in ("bucket", "kind", "keys", "texts")}
            for kind, chosen, keys in ((0, ~hot & ~last, word), (1, ~hot & last, word), (2, ~known, pair)):
                key, own = keys[chosen], mark[chosen]
                to = (key % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                key, own, to = key[order], own[order], to[order]
                edges = np.concatenate([np.flatnonzero(np.diff(to, prepend=-1)), [len(to)]])
                for p, q in zip(edges[:-1], edges[1:]):
                    for name, x in zip(made, (int(to[p]), kind, key[p:q].tobytes(), own[p:q].tobytes())):
                        made[name].append(x)
            rows_made = len(made["kind"])
            yield _batch(dealt_schema, rows_made, **made, chunk=[number] * rows_made)
            ids = [x for g in held for x in g.ids.to_pylist()]
            yield _batch(dealt_schema, 1, bucket=[number % buckets], kind=[3], chunk=[number], ids=[ids], counts=[count], sums=[total])

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One bucket after another: n-grams become, for each chunk, texts and what these n-grams add to them."""
        held: dict[int, list] = {}
        now = None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            for k in np.flatnonzero(kinds == 3).tolist():
                yield batch.slice(k, 1).select(valued_schema.names)
            for to, kind, chunk, keys, texts in zip(*[batch.column(c).to_pylist() for c in ("bucket", "kind", "chunk", "keys", "texts")]):
                if to != now:
                    yield from _settled(held, shared.value[0], valued_schema)
                    held, now = {0: [], 1: [], 2: []}, to
                if kind < 3:
                    held[kind].append((chunk, np.frombuffer(keys, np.uint64), np.frombuffer(texts, np.uint16)))
        yield from _settled(held, shared.value[0], valued_schema)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One chunk after another: the sums of its texts."""
        now, head, total = None, None, np.zeros(0)
        for batch in batches:
            for k, chunk in enumerate(batch.column("chunk").to_pylist()):
                if chunk != now:
                    if head:
                        yield pa.RecordBatch.from_arrays([*head, pa.array(total[: len(head[0])])], names=result.names)
                    now, head, total = chunk, None, np.zeros(DOCS)
                sums = batch.column("sums")[k].values.to_numpy()
                texts = batch.column("texts")[k].as_py()
                if texts is None:
                    head = [batch.column(c)[k].values for c in ("ids", "counts")]
                    total[: len(sums)] += sums
                else:
                    total[np.frombuffer(texts, np.uint16)] += sums
        if head:
            yield pa.RecordBatch.from_arrays([*head, pa.array(total[: len(head[0])])], names=result.names)

    sums = (
        rows.mapInArrow(dealt, dealt_schema)
        .repartition(buckets, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(valued, valued_schema)
        .repartition("chunk")
        .sortWithinPartitions("chunk")
        .mapInArrow(added, result)
    )
    return sums.select("doc_id", "n_tokens", F.round(F.col("total") / F.greatest("n_tokens", F.lit(1)), 6).alias("delta"))


def _batch(schema: T.StructType, rows: int, **columns) -> pa.RecordBatch:
    """Rows of the schema, null in the columns that are not given."""
    from pyspark.sql.pandas.types import to_arrow_schema

    made = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in to_arrow_schema(schema)]
    return pa.RecordBatch.from_arrays(made, names=schema.names)


def _settled(held: dict[int, list], value: Value, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """The n-grams of one bucket, counted and valued: of each chunk, its texts and their sums."""
    parts: dict[int, list] = {}
    for kinds in ((0, 1), (2,)):
        own = [(k, x) for k in kinds for x in held.get(k, [])]
        if not own:
            continue
        text = np.concatenate([x[2] for _, x in own])
        key, at = np.unique(np.concatenate([x[1] for _, x in own]), return_inverse=True)
        n, a = np.bincount(at, minlength=len(key)), np.bincount(at, text >= DOCS, minlength=len(key))
        if kinds == (2,):
            worth = value.pair(n, a)[at]
        else:
            ends = np.repeat([k == 1 for k, _ in own], [len(x[1]) for _, x in own])
            worth = value.word(n, a)[at] + np.where(ends, 0, value.before(n, a)[at])
        stop = 0
        for _, (chunk, keys, texts) in own:
            start, stop = stop, stop + len(keys)
            parts.setdefault(chunk, []).append((texts % DOCS, worth[start:stop]))
    for chunk, own in parts.items():
        texts = np.concatenate([x[0] for x in own])
        total = np.bincount(texts, np.concatenate([x[1] for x in own]))
        there = np.unique(texts)
        yield _batch(schema, 1, chunk=[chunk], texts=[there.tobytes()], sums=[total[there]])


SQL = f"""
WITH t AS (
  SELECT row_number() OVER () AS r, d.doc_id, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS target,
         list_filter(regexp_split_to_array(translate(coalesce(d.text, ''), '{UPPER}', '{LOWER}'), '{GAP}'), lambda x: x <> '') AS ws
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l USING (doc_id)),
w AS (SELECT r, target, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS k FROM t),
k AS (SELECT *, lag(w) OVER (PARTITION BY r ORDER BY k) AS h FROM w),
u AS (SELECT w, count(*)::DOUBLE AS n, sum(target)::DOUBLE AS a FROM k GROUP BY 1
      UNION ALL SELECT NULL, count(*) FILTER (WHERE h IS NULL), sum(target) FILTER (WHERE h IS NULL) FROM k),
b AS (SELECT h, w, count(*)::DOUBLE AS n, sum(target)::DOUBLE AS a FROM k GROUP BY 1, 2),
z AS (SELECT sum(n) AS n, sum(a) AS a, count(*)::DOUBLE AS v FROM u WHERE w IS NOT NULL),
s AS (SELECT k.r, count(*) AS n_tokens, avg(
        ln((x.n + {ADDED}) / (z.n + {ADDED} * z.v)) - ln((x.a + {ADDED}) / (z.a + {ADDED} * z.v))
        + ln((b.n + {ADDED_PAIR}) / (y.n + {ADDED_PAIR} * z.v)) - ln((b.a + {ADDED_PAIR}) / (y.a + {ADDED_PAIR} * z.v))) / 2 AS delta
      FROM k JOIN u x ON x.w = k.w JOIN u y ON y.w IS NOT DISTINCT FROM k.h JOIN b ON b.w = k.w AND b.h IS NOT DISTINCT FROM k.h CROSS JOIN z
      GROUP BY 1)
SELECT t.doc_id, coalesce(n_tokens, 0)::BIGINT AS n_tokens, round(coalesce(delta, 0), 6) AS delta
FROM t LEFT JOIN s USING (r)
"""
