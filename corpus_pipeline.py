"""A corpus pipeline: each stage takes the documents that the one before kept.

Toxic documents go, one document of each near-duplicate class stays, documents that hold a
benchmark item go, secrets are masked, and what is left becomes piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import decontaminate, minmax_dedup, piece_codec, secret_scan, toxic_crf
from driftline.llm.common import cut, table
from driftline.llm.queries import piece_model_file


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain model scores below one half.

    Null and empty texts are scored as texts without toxic tokens; repeated rows go or stay alike, a null doc_id
    teaches nothing. Without labels, or with one kind of them, all scores are the prior. All columns stay.
    """
    return toxic_crf.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that of the smallest doc_id: five words, similarity of 0.8 or more.

    Null, empty and wordless texts are linked with nothing and stay; so do rows without a doc_id. Rows repeated with
    doc_id and text stay once. All columns stay.
    """
    return minmax_dedup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none, nor does any text if the benchmark is empty; repeated rows go or stay alike.
    All columns stay.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars, where there is one, counts the masked text.

    Null texts stay null, with the n_chars that they had. All columns and rows stay.
    """
    made = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return made
    counted = F.length("text").cast(docs.schema["n_chars"].dataType)
    return made.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(counted))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source where there is one, n_tokens, ids and the digests of ids and of the text decoded from them.

    A null text is coded as an empty one; every row gives one. Other columns go.
    """
    return piece_codec.digests(docs, piece_model_file(), keep=tuple(c for c in ("source", "ids") if c == "ids" or c in docs.columns))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("pieces", pieces),
]

#: The chain model, the alignment and the merges have no SQL form; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
