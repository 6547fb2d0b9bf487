"""Multi-party perspective rotation of conversations.

For every participant the dialogue is rendered with that speaker as the assistant and all others
as named users; the mask covers what the assistant says. A rendering is one row, or, where a
dialogue has more than PART turns, as many rows as hold PART each, so that no task gathers a
conversation of any length whole. Turns are counted through range partitions: each counts its
own, and what lies before is added where a conversation goes on from one partition to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from driftline.llm.common import cut

#: Most turns of one row.
PART = 1024
ASSISTANT, USER, END = "<|assistant|>\n", "<|user name=%s|>\n", "<|end|>\n"
#: What would read as a marker in a text or a name, and what stands there instead.
ESCAPED = (("<|", "< |"), ("|>", "| >"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with `place`, the number of each within its conversation in that order.

    Equal rows are dealt out at random, so no partition needs to hold many of them.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("partition", T.IntegerType()), T.StructField("own", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition, last, count = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = np.array([last, *batch.column("conv_id").to_pylist()], object)
            new = np.flatnonzero(conv[1:] != conv[:-1])
            at = np.arange(batch.num_rows)
            begin = np.full(batch.num_rows, -count)
            begin[new] = new
            own = at - np.maximum.accumulate(begin)
            last, count = conv[-1], int(own[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(own), partition, np.int32)), pa.array(own)], names=[*batch.schema.names, "partition", "own"]
            )

    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.withColumn("salt", F.rand(11)).repartitionByRange(*order, "salt").sortWithinPartitions(*order).drop("salt")
    counted = cut(dealt.mapInArrow(run, schema))
    pieces = counted.groupBy("conv_id", "partition").agg(F.count("*").alias("n"))
    conversation = Window.partitionBy("conv_id")
    offsets = (
        pieces.withColumn("before", F.sum("n").over(conversation.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)))
        .filter("before > 0")  # a conversation that goes on: at most one a partition
        .select(F.col("conv_id").alias("c"), F.col("partition").alias("p"), "before")
    )
    return (
        counted.join(F.broadcast(offsets), (F.col("partition") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")), "left")
        .withColumn("place", F.col("own") + F.coalesce("before", F.lit(0)))
        .select(*rows.columns, "place")
    )


def rotated(conversations: DataFrame, part: int | None = PART) -> DataFrame:
    """(conv_id, speaker, part, n_turns, text, mask): the rendering of each participant, in one row up to `part` turns.

    Without `part` a rendering is one row, however long; a task then holds the whole of a conversation.

    mask is start:end of each trained span of the row's text, comma-joined, code points, end exclusive: the
    speaker's text with its end mark. Turns are ordered by number, then role, then text, so
    repeated rows stay and ties have one order. A null role is the participant `unknown`, a
    null text is empty, a null turn is number 0, and null conv_ids are one conversation. Marker signs
    within texts and names are parted by a space. Other columns are not looked at; no rows give none.
    """
    rows = conversations.select(
        "conv_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    speakers = rows.select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct()
    parts = (
        numbered(rows)
        .groupBy("conv_id", (F.floor(F.col("place") / part) if part else F.lit(0)).cast("long").alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    )
    each = parts.join(speakers, F.expr("conv_id <=> c")).withColumn("turns", F.expr(f"transform(turns, x -> struct(x.role AS role, {_safe('x.role')} AS name, {_safe('x.text')} AS text))"))
    return each.select("conv_id", "speaker", "part", F.size("turns").cast("long").alias("n_turns"), *_rendered())


def _safe(value: str) -> str:
    for found, put in ESCAPED:
        value = f"replace({value}, '{found}', '{put}')"
    return value


def _rendered() -> list:
    """text and mask from turns and speaker."""
    head = f"if(x.role = speaker, '{ASSISTANT}', replace('{USER}', '%s', x.name))".replace("\n", "\\n")
    end = END.replace("\n", "\\n")
    text = f"array_join(transform(turns, x -> concat({head}, x.text, '\\n{end}')), '')"
    size = f"char_length({head}) + char_length(x.text) + {len(END) + 1}"
    mask = f"""aggregate(turns,
        named_struct('at', 0, 'spans', cast(array() AS array<string>)),
        (s, x) -> named_struct(
            'at', cast(s.at + {size} AS int),
            'spans', if(x.role = speaker,
                concat(s.spans, array(concat(s.at + char_length({head}), ':', s.at + {size}))), s.spans)),
        s -> array_join(s.spans, ','))"""
    return [F.expr(text).alias("text"), F.expr(mask).alias("mask")]


SQL = f"""
WITH n AS (SELECT conv_id, coalesce(turn, 0) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
           FROM conversations),
r AS (SELECT conv_id, role, {_safe('role')} AS name, {_safe('text')} AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place FROM n),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM r),
s AS (SELECT r.conv_id, p.speaker, (r.place // {PART})::BIGINT AS part, r.place, r.role, r.text,
        CASE WHEN r.role = p.speaker THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || r.name || '|>' || chr(10) END AS head
      FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, head || text || chr(10) || '<|end|>' || chr(10) AS piece FROM s),
c AS (SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, speaker, part ORDER BY place) AS upto FROM o)
SELECT conv_id, speaker, part, count(*) AS n_turns, string_agg(piece, '' ORDER BY place) AS text,
  coalesce(string_agg((upto - length(piece) + length(head))::BIGINT || ':' || upto::BIGINT, ',' ORDER BY place)
    FILTER (WHERE role = speaker), '') AS mask
FROM c GROUP BY 1, 2, 3
"""
