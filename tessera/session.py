"""Session defaults shared by the benchmark, the tests and the driver entry points."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "tessera", cpus: int = 8, **extra: str) -> SparkSession:
    """A local session with the settings that the queries are written for (UTC, AQE on)."""
    conf = {
        "spark.master": f"local[{cpus}]",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | extra
    spark = SparkSession.builder.appName(name).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame with its rows written to the shared folder ``spark.checkpoint.dir`` and its lineage cut.

    Steps that are read several times, or must give the same rows each time, are stored so; a lost executor costs a re-read. Only a
    local session may leave the folder unset; it gets one of its own, which goes when the process ends.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark so that any store Spark can open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
