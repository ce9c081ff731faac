"""Streams in which only time passes, restarts from a checkpoint, and calls that are tried again."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tessera.streaming import timers as T

ORDERS = "array<struct<side:string,price:double>>"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def start(stream, folder, **trigger):
    """Runs a stream into ``folder/out`` with its checkpoint beside it."""
    q = stream.writeStream.format("parquet").outputMode("append").trigger(**(trigger or {"availableNow": True}))
    return q.option("checkpointLocation", f"{folder}/checkpoint").start(f"{folder}/out")


def until(stream, folder, n, seconds=90):
    """Runs a stream in processing time until it has written ``n`` rows in all, and returns them."""
    spark, query = stream.sparkSession, start(stream, folder, processingTime="1 second")
    end = time.time() + seconds
    found = []
    while len(found) < n and time.time() < end and query.isActive:
        time.sleep(0.5)
        if (folder / "out" / "_spark_metadata").exists():
            found = spark.read.schema(stream.schema).parquet(f"{folder}/out").collect()
    query.stop()
    return found


def test_only_time_passes_and_the_round_changes(spark, tmp_path):
    soon = time.time() + 12
    offers = [("btc", "old", soon - 500), ("btc", "first", soon), ("btc", "second", soon + 600), ("eth", "only", soon)]
    df = spark.createDataFrame(offers, "series string, round_id string, end double").select("series", "round_id", F.col("end").cast("timestamp").alias("end_ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = T.rounds(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    got = until(stream, tmp_path, 4)
    assert {tuple(r)[:3] for r in got} == {("btc", "first", None), ("btc", "second", "first"), ("eth", "only", None), ("eth", None, "only")}


def test_ticks_are_counted_across_restarts(spark, tmp_path):
    pair = [("BUY", 59500.0), ("SELL", 60500.0)]
    schema = f"account string, seq long, mid double, orders {ORDERS}"

    def tick(part, data, before):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in" / part))
        stream = T.refreshes(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), 100.0, every=4)
        got = until(stream, tmp_path, before + len(data))
        return sorted((tuple(r) for r in got), key=lambda r: r[:2])

    first = [("x", 1, 0, "due"), ("x", 2, 1, None), ("x", 3, 2, "no price")]
    assert tick("a", [("x", 1, 60000.0, pair), ("x", 2, 60000.0, pair), ("x", 3, None, pair)], 0) == first
    after = tick("b", [("x", 4, 60450.0, pair), ("x", 5, 60000.0, pair), ("x", 6, 60000.0, pair), ("y", 1, 1.0, [])], 3)
    assert after == [*first, ("x", 4, 3, "near"), ("x", 5, 4, "due"), ("x", 6, 5, None), ("y", 1, 0, "due")]


def test_growing_files_are_held_back(spark, tmp_path):
    folder, seen = tmp_path / "in", str(tmp_path / "seen")
    folder.mkdir()
    schema = "path string, length long, seen_at timestamp"

    def look():
        T.sight(spark, str(folder), seen, "*.txt")
        stream = T.settled(spark.readStream.schema(schema).parquet(seen), 0.2)
        start(stream, tmp_path).awaitTermination(120)
        return sorted((r["path"].rsplit("/", 1)[1], r["length"]) for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect())

    (folder / "done.txt").write_text("all")
    (folder / "part.txt").write_text("1")
    (folder / "other.bin").write_text("1")
    assert look() == []
    (folder / "part.txt").write_text("12")
    assert look() == [("done.txt", 3)]
    assert look() == look() == [("done.txt", 3), ("part.txt", 2)]


def test_calls_come_back_when_due(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def call(payload):
        import os
        import uuid

        made = [f for f in os.listdir(log) if f.startswith(payload)]
        (log / f"{payload}-{uuid.uuid4().hex}").write_text(str(time.time()))
        if payload == "bad":
            return 400, "no"
        return (200, "ok") if payload == "fine" or (payload == "twice" and len(made) == 2) else (503, "busy")

    tasks = [("a", "fine"), ("b", "twice"), ("c", "never"), ("d", "bad")]
    df = spark.createDataFrame(tasks, "task_id string, payload string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = T.retried(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), call, retries=2, delay=1.0, growth=2.0)
    got = until(stream, tmp_path, 8)
    said = sorted(tuple(r)[:4] for r in got)
    assert said == [
        ("a", 0, 200, "done"), ("b", 0, 503, "retry"), ("b", 1, 503, "retry"), ("b", 2, 200, "done"),
        ("c", 0, 503, "retry"), ("c", 1, 503, "retry"), ("c", 2, 503, "failed"), ("d", 0, 400, "failed"),
    ]
    at = sorted(float(f.read_text()) for f in log.iterdir() if f.name.startswith("never"))
    assert at[1] - at[0] >= 1.0 and at[2] - at[1] >= 2.0
