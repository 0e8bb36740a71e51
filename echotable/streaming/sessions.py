"""Live sessions as a stateful processor: counters, expiry by event-time timers, and late windows as a side output."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_EMPTY = "spark.sql.streaming.noDataMicroBatches.enabled"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTERS = ("windows", "detections", "alerts")


#: Groups of keys that are handled together: a call for each key would cost far more than its few rows.
GROUPS = 128


class LiveSessions(StatefulProcessor):
    """Open sessions of a group of keys: (key, first, last time in ms, counters) each; those whose idle time the watermark has passed are handed out."""

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "rows binary")

    def _out(self, kind: str, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(kind=kind)[["session", "kind", "first", "last", *COUNTERS]]

    def _known(self) -> pd.DataFrame:
        held = self.open.get()
        return pa.ipc.open_stream(held[0]).read_pandas() if held else pd.DataFrame({c: [] for c in ("session", "first", "last", *COUNTERS)})

    def _keep(self, rows: pd.DataFrame) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if len(rows):
            batch, held = pa.RecordBatch.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
            with pa.ipc.new_stream(held, batch.schema) as out:
                out.write_batch(batch)
            self.open.update((held.getvalue().to_pybytes(),))
            self.handle.registerTimer(int(rows["last"].min()) + self.idle)  # the next to end
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues):
        mark = timerValues.getCurrentWatermarkInMs()
        pdf = pd.concat(list(rows))
        new = pd.DataFrame({"session": pdf["session"], "first": pdf["ms"], "last": pdf["ms"], "windows": 1, "detections": pdf["detected"], "alerts": pdf["alerted"]})
        late = new["first"] < mark
        if late.any():
            behind = new[late].groupby("session", sort=False, dropna=False)
            yield self._out("late", behind.agg({"first": "min", "last": "max", **dict.fromkeys(COUNTERS, "sum")}).reset_index())
        new = new[~late]
        if not len(new):
            return
        # open sessions and single windows are spans; those of a key less than the idle time apart are one
        known = self._known()
        spans = pd.concat([known, new]) if len(known) else new
        code, _ = pd.factorize(spans["session"], use_na_sentinel=False)
        times = spans[["first", "last", *COUNTERS]].to_numpy(np.int64)
        order = np.lexsort((times[:, 1], times[:, 0], code))
        code, times = code[order], times[order]
        head = np.append(True, code[1:] != code[:-1])
        reach = pd.Series(times[:, 1]).groupby(code).cummax().to_numpy()
        first = np.flatnonzero(head | np.append(True, times[1:, 0] - reach[:-1] >= self.idle))
        joined = np.column_stack([times[first, 0], np.maximum.reduceat(times[:, 1], first), np.add.reduceat(times[:, 2:], first, axis=0)])
        out = pd.DataFrame(joined, columns=["first", "last", *COUNTERS])
        out.insert(0, "session", spans["session"].to_numpy()[order[first]])
        self._keep(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        spans = self._known()
        over = spans["last"] + self.idle <= timerValues.getCurrentWatermarkInMs()
        if over.any():
            yield self._out("session", spans[over])
            self._keep(spans[~over])

    def close(self) -> None:
        pass


def live_sessions(windows: DataFrame, session: str, at: str, detected: str, alerted: str, idle_seconds: int = 600, late_seconds: int = 600, groups: int = GROUPS) -> DataFrame:
    """``(session, kind, started_at, ended_at, windows, detections, alerts)``: closed sessions, and late windows by key and batch.

    A session ends ``idle_seconds`` after its last window, once the watermark (the latest time of earlier batches, less
    ``late_seconds``) has passed that. A window behind the watermark changes no session; it is counted in a row of kind
    'late'. State and counts come from the query's checkpoint after a restart. The watermark's own column is left out of
    what the processor reads, as Spark would drop late rows before it. Keys are handled in ``groups`` groups by hash, which
    a checkpoint fixes; a task holds a group's windows of one batch and its open sessions. A null key is a group of its own.
    """
    ms = F.unix_millis(F.col(at).cast("timestamp"))
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)).cast("long")
    rows = windows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, f"{late_seconds} seconds")
    rows = rows.select(F.col(session).alias("session"), ms.alias("ms"), flag(detected).alias("detected"), flag(alerted).alias("alerted"))
    rows = rows.withColumn("of", F.when(F.col("session").isNull(), -1).otherwise(F.pmod(F.xxhash64("session"), F.lit(groups))))
    kind = windows.schema[session].dataType.simpleString()
    typed = f"session {kind}, kind string, first long, last long, {', '.join(f'{c} long' for c in COUNTERS)}"
    out = rows.groupBy("of").transformWithStateInPandas(LiveSessions(1000 * idle_seconds), typed, "Append", "EventTime")
    return out.select("session", "kind", F.timestamp_millis("first").alias("started_at"), F.timestamp_millis("last").alias("ended_at"), *COUNTERS)


def run_available(stream: DataFrame, checkpoint: str, write, mode: str = "append", empty_batches: bool = True) -> StreamingQuery:
    """Run a stream over what is there now, its state in RocksDB; ``write(batch, number)`` stores its rows.

    Event-time timers that the last data sets off need an empty batch after it. A stream with timeouts by the clock would
    ask for such batches for ever, and is run without them.
    """
    conf = stream.sparkSession.conf
    wanted = {_PROVIDER: _ROCKSDB, _EMPTY: str(empty_batches).lower()}
    before = {k: conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        conf.set(k, v)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    return query
