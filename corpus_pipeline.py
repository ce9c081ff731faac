"""The training-data pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import stages
from tessera.llm.common import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: (name, function of the session, the documents so far and the table folder). All but the last return the columns of documents.
STAGES: list[tuple[str, Stage]] = [
    ("quality rules", stages.quality),
    ("line dedup", stages.lines),
    ("n-gram jaccard join", stages.near_copies),
    ("benchmark decontamination", stages.leaks),
    ("best-fit packing", stages.packed),
]

#: SQL cannot learn the decision list of the first stage nor encode tokens; tests/llm/test_stages.py computes every stage anew in plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what each returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{i}")
    return docs
