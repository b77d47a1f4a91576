"""From raw documents to packed training sequences, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import dart_minhash, importance, packing, phrase_index, substring_dedup
from tessera.llm.common import staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", importance.stage),
    ("near_duplicates", dart_minhash.stage),
    ("repeated_spans", substring_dedup.stage),
    ("decontamination", phrase_index.stage),
    ("packing", packing.stage),
]

#: Learned weights, sketches and token ids have no SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
