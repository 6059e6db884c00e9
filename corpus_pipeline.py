"""Corpus pipeline: quality, line dedup, near duplicates, decontamination, packing."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontamination, jaccard_join, line_dedup, packing, quality
from lodestone.llm.shared import Store, table

#: Rows of a batch between a task and its Python worker.
BATCH = 1000


def _in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """stage in a session whose Arrow batches hold BATCH rows at most: rows are whole texts, of which a task and its worker hold several batches each.

    The session keeps the setting, since what a stage returns runs later.
    """

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        if not 0 < rows <= BATCH:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality classifier", _in_small_batches(quality.stage)),
    ("line dedup", _in_small_batches(line_dedup.stage)),
    ("n-gram Jaccard join", _in_small_batches(jaccard_join.stage)),
    ("benchmark decontamination", _in_small_batches(decontamination.stage)),
    ("packing", _in_small_batches(packing.stage)),
]

#: SQL can express neither the classifier nor the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over `documents`, each written as Parquet and read again.

    Nulls, ties, repeated rows, empty tables and further columns: as each stage's function says; none of them fails.
    """
    store, docs = Store(spark, "corpus_pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = store.write(stage(spark, docs, sf_dir), f"stage_{k}")
    return docs
