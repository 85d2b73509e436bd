"""A training corpus from documents: quality rules, near duplicates, decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next one's docs.  All but the last return the columns of documents.

Every stage takes an empty table to an empty one, treats repeated rows alike, and passes other columns on as they are,
whatever their names; what a stage does with null keys and with null, empty and very long texts stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.compression_bands import within_bands
from quern.llm.ngram_join import near_duplicate_classes
from quern.llm.pattern_packing import pack
from quern.llm.pii_crf import redact
from quern.llm.shared import materialize, table, without_ids
from quern.llm.template_decontamination import contaminated


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the compression bands for their length; null and empty texts go, null keys don't matter."""
    return within_bands(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each class that the n-gram join connects.

    Classes are of chains: a document may go whose own similarity with the one that stays is below the threshold, if
    others lie between.  Null keys and texts without words stay; rows that repeat a doc_id stay or go together.
    """
    return without_ids(docs, near_duplicate_classes(docs).where("doc_id != class_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, word for word or re-parameterised; null keys and null or empty texts stay."""
    return without_ids(docs, contaminated(docs, table(spark, sf_dir, "benchmark")))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and secrets replaced by the names of their kinds; null texts stay null."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and slot of every piece of every document, in tokens; texts without any have null bins and slots."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("private_data", private_data), ("packing", packing)]

#: No stage but the first filters can be told in SQL (zstandard ratios, a trained field, fitted patterns).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
