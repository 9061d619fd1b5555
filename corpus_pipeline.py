"""Corpus pipeline: toxicity, language identification, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before kept and returns a DataFrame,
which is written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codefacts.llm import jaccard, langid, packing, repeats, toxicity
from codefacts.llm.common import durable, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Rows of an Arrow batch while the pipeline runs: some documents are very long.
BATCH_ROWS = "1024"


def _short_batches(stage: Stage) -> Stage:
    """The stage with short batches, also while its caller writes what it returns; run() sets the session's own value again."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _short_batches(toxicity.stage)),
    ("language_id", _short_batches(langid.stage)),
    ("jaccard_join", _short_batches(jaccard.stage)),
    ("suffix_dedup", _short_batches(repeats.stage)),
    ("packing", _short_batches(packing.stage)),
]

#: Trained classifiers decide in the first two stages, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: the pieces of the documents that all stages kept, packed into sequences."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for n, (name, stage) in enumerate(STAGES[:-1]):
            kept = durable(stage(spark, docs, sf_dir), name)
            if n:
                release(docs)
            docs = kept
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        spark.conf.set(key, before)
