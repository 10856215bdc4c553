"""A training corpus from raw documents, stage by stage.

Every stage takes what the one before kept, whole; all but the last return the
columns of documents.  run() writes each stage to the shared folder and reads
it back, so a lost executor costs no more than the stage at hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnlake.llm.common import fresh_path, remove_path, scratch
from tarnlake.llm.exact_dedup import dedup_stage
from tarnlake.llm.jaccard_join import near_duplicate_stage
from tarnlake.llm.mixing import mix_stage
from tarnlake.llm.packing import pack_stage
from tarnlake.llm.toxicity import toxicity_stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", dedup_stage),
    ("jaccard_join", near_duplicate_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]

#: The classifier, the mix and the packing are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage made on its way goes once its result is written, and that
    result once the next stage's is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark, path):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_path(spark, before)
        before = path
    return docs
