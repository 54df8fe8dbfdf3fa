"""From documents to packed training sequences, in stages that are each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplicate.llm.common import shared_dir, table
from triplicate.llm.packing import pack
from triplicate.llm.pii import redact_pii
from triplicate.llm.simhash import drop_near_duplicates
from triplicate.llm.substrings import remove_duplicates
from triplicate.llm.toxicity import drop_toxic, train


def _counted(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after`` with n_chars, where ``before`` has one, as long as the text now is."""
    if "n_chars" in before.columns:
        kind = before.schema["n_chars"].dataType
        after = after.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return after


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a model of the labelled ones takes for toxic.

    A null text counts as empty and stays null; repeated rows are judged alike; an empty table gives no rows; columns may
    have any names.
    """
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: similarity of five-word shingles of 0.8 or more.

    Null, empty and blank texts are one group; rows that repeat the doc_id that stays, stay with it; an empty table gives
    no rows; columns may have any names.
    """
    return drop_near_duplicates(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages out of documents that an earlier document holds.

    All rows stay; a null text stays null, an empty one empty; rows that share a doc_id take nothing from one another; a
    null doc_id comes after all; an empty table gives no rows; columns may have any names.
    """
    return _counted(docs, remove_duplicates(docs))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by their kinds.

    All rows stay; a null text stays null; repeated rows are treated alike; an empty table gives no rows; columns may
    have any names.
    """
    return _counted(docs, redact_pii(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences.

    A null or empty text is one token, its end; repeated rows are packed each for itself; an empty table gives no rows;
    columns besides doc_id and text are not read.
    """
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("substrings", substrings), ("pii", pii), ("packing", packing)]

#: SQL can't express a learned classifier, fingerprints or a tokenizer; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each one's rows written to the shared folder and read again; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
