"""Streams of progress events: idempotent rows, windows over late data, circuits and timeouts by origin."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.sources.sinks import checkpoint_json

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, name: str = "events*.parquet", files: int = 1) -> DataFrame:
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", name).option("maxFilesPerTrigger", files).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by type and window; late rows within the watermark count."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def circuits(events: DataFrame, limit: int = 3) -> DataFrame:
    """By user, after each batch: events run, events suppressed, and whether the circuit is open; state is two numbers and a flag."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, is_open, done, dropped = state.get if state.exists else (0, False, 0, 0)
        for frame in frames:
            for kind in frame.sort_values(["ts", "event_id"])["event_type"]:
                if is_open:
                    dropped += 1
                    continue
                done += 1
                run = run + 1 if kind == "error" else 0
                is_open = run >= limit
        state.update((run, is_open, done, dropped))
        yield pd.DataFrame({"user_id": [key[0]], "done": [done], "dropped": [dropped], "open": [is_open]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, done long, dropped long, open boolean", "run long, open boolean, done long, dropped long", "update", GroupStateTimeout.NoTimeout)


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Runs over what is there and stops; the checkpoint makes a rerun go on where it was."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_partial(events: DataFrame, folder: str, checkpoint: str):
    """Starts a stream whose rows are kept after each batch, with a summary beside them; a batch that runs again writes over its own rows alone."""

    def put(batch: DataFrame, n: int) -> None:
        spark, own = batch.sparkSession, Observation()
        batch.observe(own, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/partial.json")
        there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        last = json.loads(spark.read.text(f"{folder}/partial.json", wholetext=True).first()[0]) if there else {"batches": 0, "rows": 0, "before": 0}
        # of a batch that runs again, what was there before it counts
        before = last["rows"] if last["batches"] == n else last["before"]
        checkpoint_json(spark, f"{folder}/partial.json", {"batches": n + 1, "rows": before + own.get["n"], "before": before})

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
