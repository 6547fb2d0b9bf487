"""Sharding through fixed virtual slots, with DataFrame functions only.

Records hash into a fixed number of slots. A versioned map, stored with a folder a version, gives
every slot a shard, whether it holds records or not. Version 1 deals the slots round; rebalancing
sums bytes per slot and edits the map: each shard keeps its largest slots up to an equal share,
and what is over goes, largest first, to the shard with the fewest bytes. Growing moves slots into
the new shard alone. Only the map, of one row a slot, is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.llm.common import cut, new_path

SLOTS = 4096
#: Equal rows are slotted in blocks of so many, so that no slot holds a large group of them whole.
COPIES = 1024


def virtual_slot(*keys, slots: int = SLOTS):
    """0 to slots - 1, from the first 32 bits of the MD5 of the keys; null counts as the empty text."""
    joined = F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return (F.conv(F.substring(F.md5(joined.cast("binary")), 1, 8), 16, 10).cast("long") % slots).cast("int")


def sized(documents: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes and one more), text_crc32, block, copies, vslot: a row for each block of equal rows.

    A null text has no bytes. Rows of one doc_id, null too, part by their texts, equal rows by blocks.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    last = F.floor((F.col("n") - 1) / COPIES)
    return (
        rows.groupBy("doc_id", "size", "text_crc32")
        .agg(F.count("*").alias("n"))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .withColumn("copies", F.least(F.lit(COPIES), F.col("n") - F.col("block") * COPIES))
        .drop("n")
        .withColumn("vslot", virtual_slot(F.col("doc_id"), F.col("text_crc32"), F.col("block"), slots=slots))
    )


def slot_sizes(blocks: DataFrame) -> DataFrame:
    """Bytes and rows of each slot that holds any; partial sums leave at most one row a slot and task to shuffle."""
    size = F.col("size") * F.col("copies")
    return blocks.groupBy("vslot").agg(F.sum(size).alias("bytes"), F.sum("copies").alias("n_rows"))


def first_map(spark, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: (version, vslot, shard, bytes) of all slots, dealt round before any record is known."""
    slot = F.col("id").cast("int")
    return spark.range(slots).select(
        F.lit(1).alias("version"), slot.alias("vslot"), (slot % shards).alias("shard"), F.lit(0).cast("long").alias("bytes")
    )


def rebalanced_map(current: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version, edited by the bytes of each slot; slots without records have none and stay.

    A shard keeps its slots, largest first, while they hold at most an equal share of all bytes. The
    others go, largest first, to the shard with the fewest bytes; ties to the lower slot and shard.
    """
    sized_map = current.drop("bytes").join(F.broadcast(sizes.select("vslot", "bytes")), "vslot", "left").fillna(0, "bytes")
    order = [F.desc("bytes"), F.asc("vslot")]
    upto = F.sum("bytes").over(Window.partitionBy("shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    every = sized_map.agg(F.sum("bytes").alias("total"))
    marked = sized_map.withColumn("upto", upto).join(F.broadcast(every)).withColumn("stays", F.col("upto") * shards <= F.col("total"))
    over = F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("minus"), "vslot"))
    loads = [F.coalesce(F.sum(F.when(F.col("stays") & (F.col("shard") == k), F.col("bytes"))), F.lit(0).cast("long")) for k in range(shards)]
    held = marked.agg(F.array(*loads).alias("loads"), F.sort_array(F.collect_list(over)).alias("over"))
    dealt = """aggregate(over,
        named_struct('loads', loads, 'to', cast(array() AS array<int>)),
        (s, x) -> named_struct(
            'loads', transform(s.loads, (l, i) ->
                if(i + 1 = array_position(s.loads, array_min(s.loads)), l - x.minus, l)),
            'to', concat(s.to, array(cast(array_position(s.loads, array_min(s.loads)) - 1 AS int)))),
        s -> s.to)"""
    moved = held.select("over", F.expr(dealt).alias("to")).select(F.explode(F.arrays_zip("over", "to")).alias("x"))
    moved = moved.select(F.col("x.over.vslot").alias("vslot"), F.col("x.to").alias("to"))
    return marked.join(F.broadcast(moved), "vslot", "left").select(
        (F.col("version") + 1).alias("version"), "vslot", F.coalesce("to", "shard").alias("shard"), "bytes"
    )


def grown_map(current: DataFrame, shards: int) -> DataFrame:
    """The next version, edited for one more shard: of `shards` old ones, each gives slots in slot
    order while they hold at most 1 / (shards + 1) of its bytes; no slot moves between old shards."""
    own = Window.partitionBy("shard")
    upto = F.sum("bytes").over(own.orderBy("vslot").rowsBetween(Window.unboundedPreceding, 0))
    return current.select(
        (F.col("version") + 1).alias("version"),
        "vslot",
        F.when(upto * (shards + 1) <= F.sum("bytes").over(own), F.lit(shards)).otherwise(F.col("shard")).alias("shard"),
        "bytes",
    )


def save_map(slot_map: DataFrame, path: str) -> None:
    """Adds the map's one version to the store at `path`, a folder per version; a version that is there is refused."""
    versions = [r["version"] for r in slot_map.select("version").distinct().collect()]
    if len(versions) != 1:
        raise ValueError(f"a map has one version, not {versions}")
    slot_map.drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={versions[0]}")


def load_map(spark, path: str, version: int | None = None) -> DataFrame:
    """The given version of the stored map, the latest without one."""
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == version).select("version", "vslot", "shard", "bytes")


def assign(blocks: DataFrame, slot_map: DataFrame) -> DataFrame:
    """One row a record: doc_id, size, text_crc32, vslot, shard, map_version, and slot, its place in its shard, gapless from 0.

    Places count these records, not those that the map was made from. They are given within each virtual slot, and
    a slot begins where the shard's slots before it end, so no task sees more than one slot's rows. A slot that the
    map lacks is an error. The map has a row a slot, which bounds the broadcasts. Equal rows get places of their own.
    """
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    counts = slot_sizes(blocks).select("vslot", "n_rows")
    begins = (
        slot_map.select("vslot", "shard", F.col("version").alias("map_version"))
        .join(F.broadcast(counts), "vslot", "left")
        .withColumn("begin", F.coalesce(F.sum("n_rows").over(before("shard").orderBy("vslot")), F.lit(0)))
        .drop("n_rows")
    )
    within = before("vslot").orderBy("doc_id", "text_crc32", "size", "block")
    missing = F.raise_error(F.concat(F.lit("the map has no slot "), F.col("vslot").cast("string"))).cast("int")
    return (
        blocks.withColumn("place", F.coalesce(F.sum("copies").over(within), F.lit(0)))
        .join(F.broadcast(begins), "vslot", "left")
        .withColumn("shard", F.when(F.col("shard").isNull(), missing).otherwise(F.col("shard")))
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .select("doc_id", "size", "text_crc32", "vslot", "shard", "map_version", (F.col("begin") + F.col("place") + F.col("copy")).alias("slot"))
    )


def sharded(documents: DataFrame, shards: int = 8, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """The law `bytes`: the whole table over `shards` shards of near equal size, one row for each of its rows.

    The map is stored at `path`, in the shared folder without one: version 1, then 2, rebalanced for these
    rows; records are placed by what is read back. Rows are doc_id (null too), size, crc, shard and place; a null
    text has size 1, equal rows stay as many. Columns of documents other than doc_id and text are not looked at.
    An empty table gives no rows.
    """
    spark = documents.sparkSession
    path = path or new_path(spark)
    blocks = cut(sized(documents, slots))
    save_map(first_map(spark, shards, slots), path)
    save_map(rebalanced_map(load_map(spark, path), slot_sizes(blocks), shards), path)
    return assign(blocks, load_map(spark, path)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
        "map_version",
    )


def sql(shards: int = 8, slots: int = SLOTS) -> str:
    """The same in DuckDB, which has no CRC-32 of its own: it is folded over the bytes with a table made by rule."""
    loads = ", ".join(f"coalesce(sum(bytes) FILTER (WHERE stays AND first = {k}), 0)::BIGINT" for k in range(shards))
    return f"""
WITH RECURSIVE
tab AS (SELECT list(list_reduce(list_concat([i::BIGINT], range(8)),
          lambda a, b: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS tab FROM range(256) x(i)),
hexed AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS pairs FROM documents),
e AS (SELECT doc_id, octet_length(encode(text))::BIGINT + 1 AS size,
        xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(pairs, lambda p: ('0x' || p)::BIGINT)),
            lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1])), 4294967295)::BIGINT AS text_crc32
      FROM hexed, tab),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1 AS copy FROM e),
r AS (SELECT *, (('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), text_crc32, copy // {COPIES})), 1, 8))::BIGINT % {slots})::INT AS vslot FROM n),
s AS (SELECT i::INT AS vslot, (i % {shards})::INT AS first, coalesce(sum(size), 0)::BIGINT AS bytes FROM range({slots}) x(i) LEFT JOIN r ON r.vslot = i GROUP BY ALL),
m AS (SELECT *, sum(bytes) OVER (PARTITION BY first ORDER BY bytes DESC, vslot ROWS UNBOUNDED PRECEDING) * {shards} <= (SELECT sum(bytes) FROM s) AS stays FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, vslot) AS k FROM m WHERE NOT stays),
f(k, vslot, loads, shard) AS (
  SELECT 0::BIGINT, -1, [{loads}], -1 FROM m
  UNION ALL
  SELECT o.k, o.vslot,
    list_transform(f.loads, lambda l, i: CASE WHEN i = list_position(f.loads, list_min(f.loads)) THEN l + o.bytes ELSE l END),
    (list_position(f.loads, list_min(f.loads)) - 1)::INT
  FROM f JOIN o ON o.k = f.k + 1),
g AS (SELECT m.vslot, coalesce(f.shard, m.first) AS shard FROM m LEFT JOIN f ON f.vslot = m.vslot)
SELECT r.doc_id, r.size, r.text_crc32, 'bytes' AS law, g.shard,
  row_number() OVER (PARTITION BY g.shard ORDER BY r.vslot, r.doc_id NULLS FIRST, r.text_crc32, r.size, r.copy) - 1 AS slot,
  NULL::INT AS grown_shard, r.vslot, 2 AS map_version
FROM r JOIN g ON r.vslot = g.vslot
"""
