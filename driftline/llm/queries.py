"""Registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import (
    decontaminate,
    filter_audit,
    license_scan,
    lm_delta,
    minmax_dedup,
    periodic_runs,
    perspectives,
    piece_codec,
    rarity_digest,
    secret_scan,
    slot_shards,
    topk_products,
    toxic_crf,
)
from driftline.llm.common import table


def piece_model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(table(spark, sf_dir, "documents"), piece_model_file())


def op2_rarity_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rarity_digest.compare(table(spark, sf_dir, "documents"))


def op3_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.classes(table(spark, sf_dir, "documents"), words=3, percent=85)


def op4_lm_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return lm_delta.compare(table(spark, sf_dir, "documents"), labels.filter("quality = 1"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op6_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotated(table(spark, sf_dir, "conversations"))


def op7_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_crf.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slot_shards.sharded(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(table(spark, sf_dir, "documents"))


def op13_topk_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_products.report(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pieces": op1_pieces,
        "op2_rarity_digest": op2_rarity_digest,
        "op3_minmax": op3_minmax,
        "op4_lm_delta": op4_lm_delta,
        "op5_secrets": op5_secrets,
        "op6_perspectives": op6_perspectives,
        "op7_toxic_crf": op7_toxic_crf,
        "op8_decontaminate": op8_decontaminate,
        "op9_slots": op9_slots,
        "op10_licenses": op10_licenses,
        "op11_filter_audit": op11_filter_audit,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_topk_products": op13_topk_products,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_minmax": minmax_dedup.sql(words=3, percent=85),
        "op4_lm_delta": lm_delta.SQL,
        "op6_perspectives": perspectives.SQL,
        "op9_slots": slot_shards.sql(),
        "op10_licenses": license_scan.sql(),
        "op11_filter_audit": filter_audit.SQL,
        "op13_topk_products": topk_products.SQL,
    }
