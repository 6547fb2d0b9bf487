"""Tables of the driver, and the roles that they play as series, spikes, choices and truths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ORIGIN = "2024-01-01 00:00:00"
CODES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts="ts"):
    """Seconds since the origin of a time stamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{ORIGIN}', {ts}) / 1e6")


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit_id, spike_time) of every event."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("unit_id"), seconds().alias("spike_time"))


def series(spark: SparkSession, sf_dir: str, *columns) -> DataFrame:
    """(series_id, t, s, y, ...): each user's events numbered from 0 by time, then event_id."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("series_id"),
        (F.row_number().over(order) - 1).alias("t"),
        seconds().alias("s"),
        F.col("value").alias("y"),
        *columns,
    )


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, t, choice, reward): the event type's place in the alphabet, and whether the value exceeds 50."""
    code = F.array_position(F.array(*[F.lit(c) for c in CODES]), F.col("event_type")) - 1
    return series(
        spark, sf_dir, code.cast("int").alias("choice"), (F.col("value") > 50).cast("int").alias("reward")
    ).drop("s", "y")


#: The same views for DuckDB.
SQL = f"""
SPIKES AS (SELECT user_id AS unit_id, (epoch_us(ts) - epoch_us(TIMESTAMP '{ORIGIN}')) / 1e6 AS spike_time FROM events),
SERIES AS (SELECT user_id AS series_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS t,
    (epoch_us(ts) - epoch_us(TIMESTAMP '{ORIGIN}')) / 1e6 AS s, value AS y,
    (list_position([{", ".join(f"'{c}'" for c in CODES)}], event_type) - 1)::INT AS choice, (value > 50)::INT AS reward FROM events)"""
