"""The corpus pipeline: five operators in a row, each over what its predecessor kept.

Every stage is a function of (spark, docs, sf_dir) and returns the columns of `documents`,
except the last, which returns the pieces of the documents with their place in a training
sequence. Stages that change a text set `n_chars` to its new length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm.common import table
from vulnlake.llm.packing import pack
from vulnlake.llm.personal import redact
from vulnlake.llm.simhash import simhash_dedup
from vulnlake.llm.suffix import dedup_texts
from vulnlake.llm.toxicity import drop_toxic
from vulnlake.session import write_out


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely toxic than not go; clean ones stay as they are."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash_dedup(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start more than once are removed; all documents stay."""
    return _measured(dedup_texts(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; all documents stay."""
    return _measured(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and their offset in it."""
    return pack(docs).withColumnRenamed("id", "doc_id")


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("toxicity", toxicity),
    ("simhash_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("personal_data", personal_data),
    ("best_fit_packing", packing),
]

#: The stages cannot be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written before the next reads them."""
    rows = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if k + 1 < len(STAGES):
            rows = write_out(rows, name)
    return rows
