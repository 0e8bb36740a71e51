"""Live windows as streams: ingest, enrichment, confirmation, counters, monitors, persistence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from echotable.functions.config import THRESHOLDS
from echotable.operators.scan import Streaks
from echotable.sources.commits import TableLog
from echotable.streaming.sessions import run_available


def read(spark: SparkSession, path: str, like: DataFrame, per_batch: int | None = None) -> DataFrame:
    """A Parquet folder or glob as a stream, in the schema of ``like``."""
    reader = spark.readStream.schema(like.schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(path)


def ingest(windows: DataFrame, keys: list[str], at: str, late: str = "10 minutes") -> DataFrame:
    """Windows once per key; a repeat within the watermark is refused, rows later than it are dropped."""
    return windows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def enrich(windows: DataFrame, rules: DataFrame, class_col: str) -> DataFrame:
    """Windows with the rule of their class: stream with a small static table."""
    return windows.join(F.broadcast(rules), F.col(class_col) == F.col("rule_class"), "left")


def confirm(windows: DataFrame, session: str, at: str, class_col: str, qualifies: str, key: str, needed: int | None = None, window_seconds: float | None = None, idle_minutes: int = 1440) -> DataFrame:
    """Repeat confirmation per session, its state a class, a count, a time and a flag.

    Rows of a batch are folded in event-time order; a batch's rows are taken as later than those of the
    batches before it, as arrival order is. A session's state is dropped after ``idle_minutes`` without a window by
    the clock, which is over a streak's gap, so it only ends a streak that just fired.
    """
    limits = THRESHOLDS["repeat_detection"]
    needed = needed or limits["required_consecutive_detections"]
    how = Streaks(needed, window_seconds if window_seconds is not None else limits["window_seconds"])

    def step(group, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(pdfs)).sort_values([at, key], kind="stable")
        open_, *kept = state.get if state.exists else (False, None, 0, 0.0, False)
        out, (name, n, last, fired) = how.run(tuple(kept) if open_ else how.start, np.zeros(len(rows)), rows["_at"].to_numpy(), rows[class_col].to_numpy(), rows[qualifies].to_numpy())
        state.update((name is not False, None if name is False else name, n, last, fired))
        state.setTimeoutDuration(60_000 * idle_minutes)
        yield pd.DataFrame({"session_id": group[0], "key": rows[key], **out})

    kinds = {f.name: f.dataType.simpleString() for f in windows.schema}
    out = f"session_id {kinds[session]}, key {kinds[key]}, consecutive long, confirmed boolean, newly_confirmed boolean"
    time = F.col(at).cast("timestamp")
    cols = windows.select(session, key, class_col, F.coalesce(F.col(qualifies), F.lit(False)).alias(qualifies), time.alias(at), time.cast("double").alias("_at"))
    return cols.groupBy(session).applyInPandasWithState(step, out, "open boolean, class string, n long, last double, fired boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def session_counters(windows: DataFrame, session: str, at: str, idle: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Windows and alerts per session, which ends after an idle time."""
    w = windows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    g = w.groupBy(session, F.session_window(at, idle).alias("w"))
    return g.agg(F.count("*").alias("windows"), F.count_if("is_alert").alias("alerts")).select(session, F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "windows", "alerts")


def monitor(events: DataFrame, at: str, length: str = "60 minutes", every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events, errors and reviews in a sliding window."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    g = e.groupBy(F.window(at, length, every).alias("w"))
    return g.agg(F.count("*").alias("n"), F.count_if("is_error").alias("errors")).select(F.col("w.start").alias("started_at"), "n", "errors")


def timeline(events: DataFrame, at: str, bucket: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per tumbling bucket."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return e.groupBy(F.window(at, bucket).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), "n")


def store_batches(log: TableLog, table: str, name: str):
    """A ``foreachBatch`` sink: each batch of the stream ``name`` is committed once, however often it is replayed."""

    def write(batch: DataFrame, number: int) -> None:
        log.commit(f"{name}-{number:09d}", {table: batch})

    return write


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, and read its result back: all batches, or in 'complete' mode the last."""
    log = TableLog(stream.sparkSession, f"{path}/out")
    run_available(stream, f"{path}/state", store_batches(log, "rows", "batch"), mode, empty_batches=False)
    folders = log.folders("rows")
    if not folders:
        return stream.sparkSession.createDataFrame([], stream.schema)
    return stream.sparkSession.read.schema(stream.schema).parquet(*(folders[-1:] if mode == "complete" else folders))
