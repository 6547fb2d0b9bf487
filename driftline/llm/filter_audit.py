"""Audit of how corpus filters interact, from Walsh-Hadamard sums.

Each document fails some of the filters, which is a mask of one bit a filter. Per part and label
class, one pass adds up a signed parity sum for every set of filters: +1 where a document fails an
even number of them, -1 where it fails an odd number. The sums turn back into the exact number of
documents of every mask, since the transform is its own inverse but for a factor. All orders of
the filters, what each step removes, and each filter's Shapley share follow from those cells alone,
however many documents there are: over all n! orders a document that fails k filters is removed
n! / k times by each of them.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import cut

#: What parts words: ASCII white space.
GAP = r"[\x20\x09-\x0D]+"
#: The five filters of the registered query; a document fails them under these conditions.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 3, "[#$%&*|]"
LETTERS = "ABCDE"


def failures(documents: DataFrame, part: str) -> DataFrame:
    """(doc_id, part, mask, digest) of every row: its part (null as the empty text), what it fails of A to D, its text.

    A: fewer than 200 words. B: distinct words under 50 % of all. C: letters A-Z over 3 % of all
    code points. D: any of #$%&*|. A null text counts as an empty one, which fails A alone.
    """
    words = F.filter(F.split("text", GAP), lambda w: w != "")
    read = documents.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    counted = read.withColumn("words", words).select(
        "doc_id",
        "part",
        F.size("words").alias("n_words"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.length("text").alias("n_chars"),
        (F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_capitals"),
        F.col("text").rlike(MARKS).alias("marked"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    fails = [
        F.col("n_words") < LEAST_WORDS,
        100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"),
        100 * F.col("n_capitals").cast("long") > MOST_CAPITALS * F.col("n_chars").cast("long"),
        F.col("marked"),
    ]
    return counted.select("doc_id", "part", sum(F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)).alias("mask"), "digest")


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """rows with `bit` in the mask where a smaller doc_id, anywhere, has an equal text. Without a doc_id none is smaller.

    Only texts of several rows are looked up, by digest; both sides of that join are dealt out
    by it, so that Spark splits a digest of very many rows.
    """
    first = cut(rows.groupBy("digest").agg(F.min("doc_id").alias("__first"), F.count("*").alias("__n")).filter("__n > 1").drop("__n"))
    copy = F.coalesce(F.col("doc_id") > F.col("__first"), F.lit(False))
    return rows.join(first, "digest", "left").withColumn("mask", F.col("mask") + F.when(copy, bit).otherwise(0)).drop("__first")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good (a label of quality 1) and toxic (a label of toxic 1); of several labels of a doc_id one is enough."""
    found = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marks = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    kept = [c for c in rows.columns if c not in ("good", "toxic")]
    return rows.select(*kept).join(cut(found), "doc_id", "left").select(*kept, *marks)


def _sign(a: Column, b) -> Column:
    """+1 or -1 by the parity of the bits that both have."""
    return 1 - 2 * (F.bit_count(a.bitwiseAND(b)) % 2)


def parity_sums(rows: DataFrame, filters: int) -> DataFrame:
    """(part, good, toxic, sums): for each set of filters, the sum of signs over all documents of that part and labels."""
    return rows.groupBy("part", "good", "toxic").agg(F.array(*[F.sum(_sign(F.col("mask"), F.lit(k)).cast("long")) for k in range(1 << filters)]).alias("sums"))


def cells(sums: DataFrame, filters: int) -> DataFrame:
    """(part, n, n_good, n_toxic): documents of every mask, of every mask with quality 1 and with toxic 1."""
    size = 1 << filters
    one = f"CAST(1 - 2 * (bit_count(m & k) % 2) AS long)"
    inverse = F.expr(f"transform(sequence(0, {size - 1}), m -> aggregate(sequence(0, {size - 1}), 0L, (a, k) -> a + {one} * sums[k]) DIV {size})")
    back = sums.select("part", "good", "toxic", inverse.alias("cell"))
    total = lambda keep: F.array(*[F.coalesce(F.sum(F.when(keep, F.col("cell")[m])), F.lit(0).cast("long")) for m in range(size)])
    return back.groupBy("part").agg(total(F.lit(True)).alias("n"), total(F.col("good")).alias("n_good"), total(F.col("toxic")).alias("n_toxic"))


def orders(counted: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order of the filters and step; see `audit`."""
    size, all_orders = 1 << len(letters), math.factorial(len(letters))
    names = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = F.sequence(F.lit(1), F.lit(len(letters)))
    bit = lambda k: f"shiftleft(1, instr('{letters}', substring(filter_order, {k}, 1)) - 1)"
    placed = (
        counted.withColumn("filter_order", F.explode(names))
        .withColumn("step", F.explode(steps))
        .withColumn("bit", F.expr(bit("step")))
        .withColumn("before", F.expr(f"aggregate(filter(sequence(1, {len(letters)}), k -> k < step), 0, (a, k) -> a | {bit('k')})"))
    )
    over = lambda what, cell: F.expr(f"aggregate(sequence(0, {size - 1}), 0L, (a, m) -> a + IF({what}, {cell}, 0L))")
    here = "(m & before) = 0 AND (m & bit) != 0"
    return placed.select(
        "part",
        "filter_order",
        "step",
        over("(m & (before | bit)) = 0", "n[m]").alias("kept"),
        over(here, "n[m]").alias("removed"),
        over("(m & before) != 0 AND (m & bit) != 0", "n[m]").alias("redundant"),
        over("m = bit", "n[m]").alias("unique_fails"),
        over(here, "n_good[m]").alias("good_lost"),
        over(here, "n_toxic[m]").alias("toxic_lost"),
        over("(m & bit) != 0", f"n[m] * ({all_orders} DIV bit_count(m))").alias("shapley"),
    )


def audit(rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for each part, order of the filters (a permutation of `letters`) and step from 1, zeros included.

    rows has part, mask (bit k: fails letter k), good and toxic, neither null. Document counts:
    kept after the step, removed by it, redundant (fail its filter, but went before), unique_fails
    (fail no other), good_lost and toxic_lost (removed here), shapley (removed by its filter at any
    step, summed over all orders). A part comes from rows, so an empty table has none.
    """
    return orders(cells(parity_sums(rows, len(letters)), len(letters)), letters)


def report(documents: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The audit of the five filters A to E, by the values of the column `part`.

    E: a text equal to that of any smaller doc_id in the whole table; the other conditions are
    those of `failures`. Null texts are empty ones, a null part is the empty text; repeated rows
    count as often as they come, and are no copies of each other under one doc_id; without a
    doc_id a row is no copy and has no label. Other columns are not looked at.
    """
    rows = cut(failures(documents, part))
    return audit(with_labels(with_copies(rows, 1 << (len(LETTERS) - 1)), labels))


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{GAP}'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(words) < {LEAST_WORDS} THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(text, '{MARKS}') THEN 'D' ELSE '' END
        || CASE WHEN coalesce(w.doc_id > first, false) THEN 'E' ELSE '' END AS fails
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic FROM f GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before
      FROM o, (SELECT unnest(range(1, 6)) AS step)),
m AS (SELECT part, filter_order, step, c.*, contains(fails, own) AS fails_own,
        len(list_filter(string_split(before, ''), lambda y: y <> '' AND contains(fails, y))) > 0 AS gone FROM c, s)
SELECT part, filter_order, step::INT AS step,
  coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails_own), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (WHERE NOT gone AND fails_own), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE gone AND fails_own), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE fails_own AND length(fails) = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(n_good) FILTER (WHERE NOT gone AND fails_own), 0)::BIGINT AS good_lost,
  coalesce(sum(n_toxic) FILTER (WHERE NOT gone AND fails_own), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(length(fails), 1))) FILTER (WHERE fails_own), 0)::BIGINT AS shapley
FROM m GROUP BY 1, 2, 3
"""
