"""Corpus pipeline: from raw documents to packed sequences. Each stage reads what the one before has written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import near_duplicates, packing, quality_model, quality_rules, surrogates
from tidemark.llm.common import importable, shared_folder
from tidemark.llm.queries import SURROGATE_KEY, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, those with a null or empty text among them; failing lines of the others go. Rows that repeat and null ids stay or go by their texts."""
    importable(spark)
    return quality_rules.clean(docs.filter("text IS NOT NULL"))


def model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rule ensemble is fitted on the labelled documents of the table and judges what the rules have kept, equal texts alike; without labels the score is one for all."""
    importable(spark)
    fitted = quality_model.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_model.accepted(docs, fitted)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words, similarity 0.8; the least id of a group stays, with all its rows. Null ids and texts without words stay."""
    importable(spark)
    return near_duplicates.deduplicated(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay, with surrogates for personal data in their texts."""
    return surrogates.replace_personal_data(docs, SURROGATE_KEY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a document; every row of docs is packed for itself, whatever its id."""
    importable(spark)
    return packing.pack_documents(docs)


STAGES = [("quality rules", rules), ("quality model", model), ("near duplicates", dedup), ("personal data", private), ("packing", pack)]

#: The classifier and the tokenizer are beyond SQL; tests hold run() against slow versions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, an empty table included; each result is written under the checkpoint folder, which all executors share, and read again.

    Once a stage is written, what it has read is deleted. The last table stays for the reader of the result, and so do the
    tables that the operators' own results read; who owns the checkpoint folder deletes them.
    """
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{k - 1}")
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return docs
