"""The stages of the pipeline: each applies one operator and carries out its decisions.

A stage gets all that the one before it kept and returns the columns of ``documents``, but for the last. For all of them: further columns
of the input, whatever their names, are handed on as they are (the last stage returns columns of its own); an empty table gives an empty
one; a row is judged by its own id and text, so that rows alike in both share their fate except where a stage's text says otherwise. What
becomes of null ids, null and empty texts is said with each stage. Long texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, line_dedup, packing
from . import quality as rules
from .common import free_prefix


def _other(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned rules reject go, null and empty texts among them; a null id does not matter."""
    own = free_prefix(docs.columns)
    return rules.only_kept(rules.judge(docs, _other(spark, sf_dir, "labels"), prefix=own), docs.columns, own)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go from the texts, and so do the documents of which no word is left by that.

    ``n_chars`` follows the text where there is such a column. Rows without an id or a text stay as they are. The first copy of a run stays
    in the document of the smallest id.
    """
    own = free_prefix(docs.columns)
    left = line_dedup.dedup_lines(docs, prefix=own)
    untouched = F.col(f"{own}n_removed") == 0
    left = left.where(untouched | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(untouched, F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return left.select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links stays, that of the smallest id, with all rows of that id. Rows without an id or a word stay."""
    return jaccard_join.keep_representatives(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Rows without an id or a text stay."""
    return decontaminate.decontaminate(docs, _other(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, each with its sequence and its place in it; a null text is packed as an empty one."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
