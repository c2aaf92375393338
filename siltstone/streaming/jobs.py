"""Jobs by origin: budget, circuit and wall timeout in one keyed state with timers, and the same over a finished table.

Of each origin, events in order of time: the first starts a job. Events are done until `limit` failures in a row open the
circuit or `budget` are done; later ones are suppressed. A job ends by an event that ends it, or, `timeout` after its start,
cancelled. What comes after its end is late. Rows that are done stay whatever becomes of the job.

Rows (origin, event_id, status, reason): done, suppressed (origin_circuit_open, budget_exhausted) and late ones of events;
with a null event_id how the job ended: completed, or cancelled (origin_job_timeout). A job that runs has no such row.

Streams need spark.sql.streaming.stateStore.providerClass to be the RocksDB store, and an origin's events in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS = "origin long, event_id long, status string, reason string"
LIMIT, BUDGET, DAYS = 3, 40, 20


class Jobs(StatefulProcessor):
    """State of an origin: deadline and failures in a row, done, whether the circuit is open, whether the job has ended."""

    def __init__(self, limit: int, budget: int, timeout_ms: int):
        self.limit, self.budget, self.timeout_ms = limit, budget, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "deadline long, run int, done int, open boolean, ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        at = events["ts"].astype("datetime64[us]").astype("int64") // 1000
        if self.job.exists():
            deadline, run, done, is_open, ended = self.job.get()
        else:
            deadline, run, done, is_open, ended = int(at.iloc[0]) + self.timeout_ms, 0, 0, False, False
            self.handle.registerTimer(deadline)
        out = []
        for event, ms, failed, ends in zip(events["event_id"], at, events["failed"], events["ends"]):
            if not ended and ms >= deadline:
                ended = True
                out.append((None, "cancelled", "origin_job_timeout"))
            if ended:
                out.append((event, "late", None))
            elif is_open:
                out.append((event, "suppressed", "origin_circuit_open"))
            elif done >= self.budget:
                out.append((event, "suppressed", "budget_exhausted"))
            else:
                done, run = done + 1, run + 1 if failed else 0
                is_open = run >= self.limit
                out.append((event, "done", None))
                if ends:
                    ended = True
                    out.append((None, "completed", None))
        self.job.update((deadline, run, done, is_open, ended))
        yield self.rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        deadline, run, done, is_open, ended = self.job.get()
        self.job.update((deadline, run, done, is_open, True))
        yield self.rows(key, [] if ended else [(None, "cancelled", "origin_job_timeout")])

    @staticmethod
    def rows(key, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["event_id", "status", "reason"])
        return pd.DataFrame({"origin": key[0], "event_id": frame["event_id"].astype("Int64"), "status": frame["status"].astype(object), "reason": frame["reason"].astype(object)})

    def close(self) -> None:
        pass


def stream(events: DataFrame, failed: Column, ends: Column, late: str = "1 hour", limit: int = LIMIT, budget: int = BUDGET, days: float = DAYS) -> DataFrame:
    """events: origin, event_id, ts. Timers run by event time, `late` behind the newest event."""
    spark = events.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    rows = events.select("origin", "event_id", "ts", F.coalesce(failed, F.lit(False)).alias("failed"), F.coalesce(ends, F.lit(False)).alias("ends"))
    return rows.withWatermark("ts", late).groupBy("origin").transformWithStateInPandas(Jobs(limit, budget, int(days * 86_400_000)), ROWS, "Append", "EventTime")


def batch(events: DataFrame, failed: Column, ends: Column, upto: Column, limit: int = LIMIT, budget: int = BUDGET, days: float = DAYS) -> DataFrame:
    """The same rows of a finished table, with timers up to a time. An origin's first `budget` events decide; all others are compared with what they say, so none is sorted whole."""
    rows = events.select("origin", "event_id", "ts", F.coalesce(failed, F.lit(False)).alias("failed"), F.coalesce(ends, F.lit(False)).alias("ends"))
    span = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days * 86_400.0))
    jobs = rows.groupBy("origin").agg((F.min("ts") + span).alias("deadline"))
    order = Window.partitionBy("origin").orderBy("ts", "event_id")
    # kept by part first: no task has more than `budget` of an origin from each part
    first = rows.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= budget).join(jobs, "origin").filter("ts < deadline")
    place = F.struct("ts", "event_id")
    opens = F.sum(F.col("failed").cast("int")).over(order.rowsBetween(1 - limit, 0)) == limit
    cut = first.withColumn("opens", opens).groupBy("origin").agg(F.min(F.when(F.col("opens"), place)).alias("open"), F.min(F.when(F.col("ends"), place)).alias("end"), F.max(F.when(F.col("i") == budget, place)).alias("spent"))
    cut = jobs.join(cut, "origin", "left").withColumn("end", F.when(F.col("open").isNull() | (F.col("end") <= F.col("open")), F.col("end")))
    met = rows.join(cut, "origin")
    after = lambda c: F.coalesce(place > F.col(c), F.lit(False))
    late = (F.col("ts") >= F.col("deadline")) | after("end")
    status = F.when(late, "late").when(after("open") | after("spent"), "suppressed").otherwise("done")
    reason = F.when(late, None).when(after("open"), "origin_circuit_open").when(after("spent"), "budget_exhausted")
    own = met.select("origin", "event_id", status.alias("status"), reason.alias("reason"))
    ended = cut.filter(F.col("end").isNotNull() | (F.col("deadline") <= upto))
    done = F.col("end").isNotNull()
    return own.unionByName(ended.select("origin", F.lit(None).cast("long").alias("event_id"), F.when(done, "completed").otherwise("cancelled").alias("status"), F.when(~done, "origin_job_timeout").alias("reason")))
