"""The corpus pipeline: five stages from raw documents to packed training windows.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes it as Parquet under the shared
folder and rereads it as the next stage's documents, so a lost executor never costs more than a stage.
All but the last return the columns of documents. A NULL or empty text passes the first, second and
fourth stage; empty texts are one group of copies in the third; the fifth lists it without a bin. Empty
tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.llm.common import table
from attesta.llm.decontaminate import drop_contaminated
from attesta.llm.line_dedup import drop_repeated_lines
from attesta.llm.packing import pack_documents
from attesta.llm.simhash import keep_one
from attesta.llm.toxicity import drop_toxic
from attesta.sources.tables import materialise

CATEGORIES = ("low_quality", "toxic")


def label_columns(labels: DataFrame) -> DataFrame:
    """The label table with one column per category of the chain."""
    return labels.selectExpr("doc_id", "1 - quality AS low_quality", "toxic")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    return drop_toxic(docs, label_columns(table(spark, sf_dir, "labels")), CATEGORIES)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without chunks of lines that an earlier place holds."""
    return drop_repeated_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training windows."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Fitted models, hashed chunks and greedy packing are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
