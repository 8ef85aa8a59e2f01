"""From raw documents to packed batches, in five stages.

Each stage is a function of (spark, docs, sf_dir) whose result is written as Parquet and
read again as the next one's ``docs``. All stages but the last return the columns of
``documents``.

Edge cases, the same in all stages: null and empty texts are documents like others; ids may
be null or repeat, as rows are told apart by their places in files; of repeated rows one
stays where copies go; columns beside ``doc_id`` and ``text`` are carried along, whatever
their names; a stage over no rows returns none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.storage import folders
from tessera.llm._common import documents, stored
from tessera.llm.chosen_path import one_of_each
from tessera.llm.exact_dedup import dedup
from tessera.llm.packing import pack_documents
from tessera.llm.secret_scan import redact
from tessera.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, rejects go. Null texts
    get the score of empty ones; without labels nothing goes."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest stays; null is empty."""
    return dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that of the least id, null ids last.
    Blank and null texts are copies of each other."""
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the name of their kind; every document stays, null texts as
    they are."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document in length buckets and token-budget batches; null texts
    have length 0."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the automaton nor the optimal buckets.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. What a stage wrote for itself, and its
    input, go when its result is written; the last result stays."""
    with folders(spark) as all_stages:
        docs = documents(spark, sf_dir)
        for name, stage in STAGES:
            with folders(spark) as own:
                done = own.keep(stored(stage(spark, docs, sf_dir), f"pipeline-{name}"))
            all_stages.release(docs)
            docs = done
        return all_stages.keep(docs)
