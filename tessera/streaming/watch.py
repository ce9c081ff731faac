"""Watched folders as streams: new files once, by suffix, with failures set aside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.files import route


def watch(spark: SparkSession, folder: str, include: tuple[str, ...], exclude: tuple[str, ...] = (), per_trigger: int = 1000) -> DataFrame:
    """A stream ``path, content`` of the files that appear in a folder.

    The checkpoint of the query remembers what has been seen. Files must be moved into the folder whole.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").load(folder)
    return files.where(route(F.col("path"), include, exclude)).select("path", "content")


def run_stage(
    stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, failed: str, checkpoint: str, transient: tuple[type[Exception], ...] = (OSError,)
) -> StreamingQuery:
    """Runs each micro-batch through ``work`` into ``out``, once over what is there.

    A batch whose work fails for good goes to ``failed`` with the error; a transient error stops the query, and
    the batch is tried again when it starts anew. A batch's files are named by its number, so a repeat
    replaces them instead of adding to them.
    """

    def batch(df: DataFrame, number: int) -> None:
        try:
            work(df).write.mode("overwrite").parquet(f"{out}/batch={number}")
        except transient:
            raise
        except Exception as e:  # noqa: BLE001 - the error is kept with the rows that caused it
            reason = f"{type(e).__name__}: {e}"[:500]
            df.withColumn("error", F.lit(reason)).write.mode("overwrite").parquet(f"{failed}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
