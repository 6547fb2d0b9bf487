"""Near-duplicate classes by min-max hashing.

Each permutation of a document's shingle set keeps its smallest and its largest value, so a
signature of 2k values costs k hash evaluations. Bands of the signature propose pairs; every
link is confirmed on the full shingle sets. Texts with equal word sequences are one class
from the start, and only their representative is banded.

Candidates come in two rounds, so that a large bucket never pairs all its members. First each
member meets two hubs of its bucket: the member that shares most buckets with others, as the
one in the middle of a group of edited copies does, and the one of the smallest id. Then, once
the links found so far have joined members into components, members that still share a bucket
with another component are compared where they can be linked at all: with shingles in one
order, rare ones first, two linked sets share one of their first few, and stand no further
apart in length and place than the similarity allows. Neither round leaves out a link that a
bucket holds.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from driftline.llm.common import Words, append_columns, aside, cut, mix, slices

#: Signature values in a band, and how often a pair at the threshold may meet in no band.
ROWS, MISS = 5, 1e-6
#: Ids that may be broadcast to pick out their texts (16 bytes each); above it they are joined by shuffle.
BROADCAST_IDS = 250_000
#: Hash bins by whose counts shingles are ordered.
ORDER_BITS = 18

_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(1, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 2**63, 512, dtype=np.uint64)


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands that leave a pair at the threshold unseen with a chance of at most `miss`; an even number."""
    return 2 * math.ceil(math.log(miss) / math.log(1 - threshold**rows) / 2)


def signatures(texts: list[str | None], words: int, bands: int, rows: int = ROWS) -> tuple:
    """Set size, digest of the word sequence (None without words), and band hashes."""
    w = Words(texts)
    shingle, owner = w.shingles(words)
    n = len(texts)
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    shingle, owner = shingle[new], owner[new]
    size = np.bincount(owner, minlength=n)
    filled = np.flatnonzero(size)
    starts = np.searchsorted(owner, filled)
    both = np.zeros((n, bands * rows), np.uint64)
    for k in range(bands * rows // 2):
        x = shingle * _MULTIPLY[k] + _ADD[k]
        x ^= x >> np.uint64(32)
        if len(filled):
            both[filled, 2 * k] = np.minimum.reduceat(x, starts)
            both[filled, 2 * k + 1] = np.maximum.reduceat(x, starts)
    both = mix(both)
    band = np.zeros((n, bands), np.uint64)
    for k in range(rows):
        band = mix(band + both[:, k::rows][:, :bands] + np.uint64(k))
    band += np.arange(bands, dtype=np.uint64) << np.uint64(56)
    band = mix(band).view(np.int64)
    keys = []
    for i in range(n):
        a, b = w.of_text[i], w.of_text[i + 1]
        if a == b:
            keys.append(None)
            continue
        sequence = b" ".join(w.raw[w.text_at[i] : w.text_at[i + 1]].lower().split())
        keys.append(hashlib.blake2b(sequence, digest_size=16).digest())
    return size, keys, band


def described(docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """(doc_id, n_shingles, key, bands) of every row."""
    bands = bands_for(threshold)

    def make(texts: list[str | None]) -> list:
        size, keys, band = signatures(texts, words, bands)
        places = pa.array(np.arange(len(texts) + 1) * bands, pa.int32())
        return [
            pa.array(size, pa.int64()),
            pa.array(keys, pa.binary()),
            pa.ListArray.from_arrays(places, pa.array(band.ravel())),
        ]

    fields = [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
    return append_columns(docs.select("doc_id", "text"), "text", make, fields).drop("text")


@lru_cache(12)
def shingle_set(text: str, words: int) -> frozenset:
    """The text's distinct word shingles; all words as one, if there are fewer."""
    w = text.encode("utf-8", "replace").lower().split()
    return frozenset(zip(*[w[k:] for k in range(words)])) if len(w) >= words else frozenset([tuple(w)])


def linked(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full shingle sets reach the similarity, in hundredths.

    Both joins have an exchange on each side, so that a text with very many partners is
    dealt out again where it is skewed.
    """
    both = (
        pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches):
        for batch in slices(slices(batches, "text_a"), "text_b"):
            keep = []
            for s, t in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                x, y = shingle_set(s, words), shingle_set(t, words)
                met = len(x & y)
                keep.append(100 * met >= percent * (len(x) + len(y) - met))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return both.mapInArrow(run, schema)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the given ids: by broadcast where their counted number is small, else by shuffle."""
    few = ids.count() <= BROADCAST_IDS
    return docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that the edges (a, b) reach, for every node (id).

    Each round takes the smallest label around every node, then the label of that label;
    labels are cut by a checkpoint each round and the count of changes ends the loop.
    """
    ends = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = cut(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = (
            ends.join(labels.select(F.col("id").alias("a"), "component"), "a")
            .select(F.col("b").alias("id"), "component")
            .union(labels)
            .groupBy("id")
            .agg(F.min("component").alias("component"))
        )
        near = cut(near)
        jumped = near.join(
            near.select(F.col("id").alias("component"), F.col("component").alias("further")), "component"
        ).select("id", F.col("further").alias("component"))
        new = cut(jumped)
        changed = new.join(labels.withColumnRenamed("component", "old"), "id").filter("component <> old")
        labels_before, labels = labels, new
        if changed.isEmpty():
            return labels_before


def rarity(texts: DataFrame, words: int) -> np.ndarray:
    """How many texts hold a shingle of each of 2^ORDER_BITS hash bins: rows for the driver are bounded by the bins."""

    def run(batches):
        total = np.zeros(1 << ORDER_BITS, np.int64)
        for piece in slices(batches, "text"):
            shingle, _ = Words(piece.column("text").to_pylist()).shingles(words)
            total += np.bincount(_bin(shingle), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bin", "n"])

    out = np.zeros(1 << ORDER_BITS, np.int64)
    for batch in texts.select("text").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n")).toArrow().to_batches():
        at, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        out[at] = n
    return out


def _bin(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def leading(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, size, place, shingle): of each set, its first shingles that a linked set must share one of.

    Any one order of all shingles serves; rare bins first leaves the least to compare. A linked
    set holds at least `percent` hundredths of this one, so all but that many come first.
    """
    shared = texts.sparkSession.sparkContext.broadcast(rarity(texts, words))

    def run(batches):
        for piece in slices(batches, "text"):
            ids = piece.column("doc_id").to_numpy(zero_copy_only=False)
            shingle, owner = Words(piece.column("text").to_pylist()).shingles(words)
            order = np.lexsort((shingle, shared.value[_bin(shingle)], owner))
            shingle, owner = shingle[order], owner[order]
            new = np.ones(len(shingle), bool)
            new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
            shingle, owner = shingle[new], owner[new]
            size = np.bincount(owner, minlength=len(ids))
            place = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
            first = place <= size[owner] - -(-percent * size[owner] // 100)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (ids[owner[first]], size[owner[first]], place[first], shingle[first].view(np.int64))],
                names=["id", "size", "place", "shingle"],
            )

    return texts.mapInArrow(run, "id long, size long, place long, shingle long")


def classes(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Words are ASCII white space apart, A-Z lowered; a text with fewer words than a shingle
    takes them as one. Links need 100 * intersection >= percent * union. Null, empty and
    wordless texts have no shingles and are linked with nothing. component_id is the smallest
    doc_id reachable; kept where it is the row's own. Rows that share a doc_id are told apart by
    their words; a null doc_id is linked with nothing and kept is then false. Other columns are not looked at.
    """
    threshold = percent / 100
    every = cut(described(docs, words, threshold))
    worded = every.filter(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    reps = cut(
        worded.groupBy("key")
        .agg(F.min(F.struct("doc_id", "bands")).alias("first"))
        .select("key", F.col("first.doc_id").alias("id"), "first.bands")
    )
    member = reps.select("id", F.explode("bands").alias("bucket")).distinct()
    sizes = cut(member.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"))
    met = cut(member.join(sizes, "bucket"))
    central = cut(met.groupBy("id").agg(F.sum("size").alias("central")))
    hubs = cut(
        met.join(central, "id")
        .groupBy("bucket")
        .agg(F.max(F.struct("central", F.col("id").alias("hub"))).alias("most"), F.min("id").alias("low"))
        .select("bucket", F.array_distinct(F.array("most.hub", "low")).alias("hubs"))
    )
    pairs = (
        met.join(hubs, "bucket")
        .select("id", F.explode("hubs").alias("hub"))
        .filter("id <> hub")
        .select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
        .distinct()
    )
    links = confirm(docs, cut(pairs), words, percent)
    found = components(reps.select("id").distinct(), links)

    # what the first round left apart
    placed = met.select("bucket", "id").join(found, "id")
    mixed = cut(
        placed.groupBy("bucket")
        .agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
        .filter("c0 < c1")
        .select("bucket")
    )
    apart = cut(met.select("bucket", "id").join(mixed, "bucket").select(F.col("id").alias("doc_id")).distinct())
    texts = cut(texts_of(docs, apart))
    heads = cut(leading(texts, words, percent).join(found, "id"))
    one, two = (heads.select("shingle", *[F.col(c).alias(f"{c}_{k}") for c in ("id", "component", "size", "place")]) for k in "ab")
    # the sets must share so many: ceil(percent * (size_a + size_b) / (100 + percent))
    must = F.ceil(percent * (F.col("size_a") + F.col("size_b")) / (100 + percent) - 1e-9)
    able = (
        (F.col("component_a") < F.col("component_b"))
        & (100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))
        & (F.col("size_a") - F.col("place_a") >= must)
        & (F.col("size_b") - F.col("place_b") >= must)
    )
    rest = one.join(two, (one["shingle"] == two["shingle"]) & able)
    rest = cut(rest.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct())
    more = cut(linked(rest, texts, words, percent))
    if not more.isEmpty():
        of = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}"))
        joined = more.join(of("a"), "a").join(of("b"), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
        over = components(found.select(F.col("component").alias("id")).distinct(), joined)
        found = cut(
            found.join(over.select(F.col("id").alias("component"), F.col("component").alias("top")), "component").select(
                "id", F.col("top").alias("component")
            )
        )
    of_key = cut(reps.select("key", "id").join(found, "id").select("key", "component"))
    worded_rows = worded.select("doc_id", "n_shingles", "key").join(of_key, "key")
    bare = every.filter(F.col("key").isNull() | F.col("doc_id").isNull())
    rows = worded_rows.select("doc_id", "n_shingles", F.col("component").alias("component_id")).union(
        bare.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    )
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def confirm(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that are links."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    return cut(linked(pairs, cut(texts_of(docs, ids)), words, percent))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each class, the one of the smallest doc_id.

    Rows repeated with doc_id and text stay once; rows without a doc_id all stay. All columns stay as they are.
    """
    old, (docs, back) = docs, aside(docs, ["__text", "__nth"])
    kept = cut(classes(old, words, percent).filter("kept").select("doc_id").distinct())
    own = Window.partitionBy("doc_id", "__text").orderBy(F.lit(1))
    once = (
        docs.join(kept, "doc_id", "left_semi")
        .withColumn("__text", F.sha2("text", 256))
        .withColumn("__nth", F.row_number().over(own))
        .filter("__nth = 1")
    )
    return back(once.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL")))


def sql(words: int, percent: int) -> str:
    """classes() in DuckDB, by comparing all pairs of texts that share a shingle: for small tables."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    joined = " || ' ' || ".join(f"ws[i + {k}]" for k in range(words))
    return f"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'),
        lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < {words} THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - {words} + 2), lambda i: {joined})) END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= {percent} * (x.n + y.n - m)),
d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT d.b, r.c FROM r JOIN d ON d.a = r.doc_id),
c AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""
