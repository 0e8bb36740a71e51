"""Live sessions with late windows and restarts, and several tables behind one commit log."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from echotable.sources import analyses as A
from echotable.sources.commits import TableLog
from echotable.streaming import live as L
from echotable.streaming import sessions as N


def plain_sessions(batches, idle, late):
    """Sessions of all windows that weren't behind the watermark when they came, and the late ones by key."""
    mark, kept, behind = 0, {}, {}
    for rows in batches:
        for s, t, alert in rows:
            if t < mark:
                behind[s] = behind.get(s, 0) + 1
            else:
                kept.setdefault(s, []).append((t, alert))
        mark = max([mark, *(t - late for _, t, _ in rows)])
    out = []
    for s, rows in kept.items():
        run = []
        for t, alert in sorted(rows):
            if run and t - run[-1][0] >= idle:
                out.append((s, run[0][0], run[-1][0], len(run), sum(a for _, a in run)))
                run = []
            run.append((t, alert))
        out.append((s, run[0][0], run[-1][0], len(run), sum(a for _, a in run)))
    return sorted(out), behind


def test_sessions_with_late_rows_and_restarts(spark, tmp_path):
    rng = random.Random(12)
    batches, now = [], 1000
    for _ in range(3):
        now += 400
        batches.append([(rng.choice("abc"), now + rng.randint(-700, 60), rng.random() < 0.3) for _ in range(25)])
    batches.append([("end", now + 10_000, False)])
    log = TableLog(spark, f"{tmp_path}/tables")
    for rows in batches:  # every batch in a query of its own, which goes on from the checkpoint
        spark.createDataFrame(rows, "s string, t long, alert boolean").withColumn("t", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        windows = spark.readStream.schema("s string, t timestamp, alert boolean").parquet(f"{tmp_path}/in").withColumn("found", F.lit(True))
        N.run_available(N.live_sessions(windows, "s", "t", "found", "alert", 60, 100), f"{tmp_path}/state", L.store_batches(log, "rows", "x"))
    got = log.read("rows").where("session <> 'end'").collect()
    sessions, late = plain_sessions(batches[:3], 60, 100)
    closed = sorted((r.session, int(r.started_at.timestamp()), int(r.ended_at.timestamp()), r.windows, r.alerts) for r in got if r.kind == "session")
    assert closed == sessions
    counted = {}
    for r in got:
        if r.kind == "late":
            counted[r.session] = counted.get(r.session, 0) + r.windows
    assert counted == late and late


def test_keys_are_handled_in_groups(spark, tmp_path):
    n, calls = 300, []

    class Told:
        """State and timers of one group, and how often it is asked."""

        def getValueState(self, name, schema):
            return self

        held, at = None, []
        get = lambda self: self.held
        update = lambda self, v: (calls.append("put"), setattr(self, "held", v))
        clear = lambda self: setattr(self, "held", None)
        listTimers = lambda self: list(self.at)
        deleteTimer = lambda self, t: setattr(self, "at", [])
        registerTimer = lambda self, t: setattr(self, "at", [t])
        getCurrentWatermarkInMs = lambda self: self.mark

    told, sessions = Told(), N.LiveSessions(60)
    told.mark = 0
    sessions.init(told)
    rows = pd.DataFrame({"session": [f"s{i % n}" for i in range(2 * n)], "ms": [(i % n) + 1000 * (i // n) for i in range(2 * n)], "detected": 1, "alerted": 0})
    assert not list(sessions.handleInputRows((0,), iter([rows]), told)) and calls == ["put"] and told.at == [60]
    told.mark = 1000
    out = pd.concat(sessions.handleExpiredTimer((0,), told, None))
    assert len(out) == n and (out.windows == 1).all() and out.session.nunique() == n and told.at == [1060]
    late = pd.concat(sessions.handleInputRows((0,), iter([rows]), told))
    assert (late.kind == "late").all() and late.windows.sum() == n
    told.mark = 5000
    assert (pd.concat(sessions.handleExpiredTimer((0,), told, None)).windows == 2).all() and told.held is None


def record(i, content, agree=True):
    scores = [("A", 0.7), ("B", 0.3)]
    return (i, f"F{i}", content, "upload", "A", "High", agree, not agree, "normal", "x", scores, scores)


RECORD = (
    "event_id long, audio_id string, sha256 string, source string, python_class string, event_severity string, alert_raised boolean, review_required boolean, "
    "review_priority string, review_ids string, ra array<struct<class_name:string,confidence:double>>, rb array<struct<class_name:string,confidence:double>>"
)


@pytest.mark.parametrize("allow", [False, True])
def test_six_tables_at_once_and_only_once(spark, tmp_path, allow):
    log = TableLog(spark, f"{tmp_path}/tables")

    def failing(batch, number):
        batch.select("audio_id").write.parquet(f"{tmp_path}/tables/audio_files/records-{number:09d}-lost")
        raise RuntimeError("lost between two tables")

    sink = A.persist_analyses(log, "records", allow)
    for rows, sinks in (([record(1, "x"), record(2, "y", False), record(3, "x")], [sink]), ([record(4, "y"), record(5, None)], [failing, sink])):
        spark.createDataFrame(rows, RECORD).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for write in sinks:
            stream = A.with_duplicates(spark.readStream.schema(RECORD).parquet(f"{tmp_path}/in"))
            try:
                N.run_available(stream, f"{tmp_path}/state", write)
            except StreamingQueryException:
                assert write is failing
    assert sorted(r.audio_id for r in log.read("audio_files").collect()) == ["F1", "F2", "F5"]
    events = {r.event_id: r.audio_id for r in log.read("events").collect()}
    assert events == ({1: "F1", 2: "F2", 3: "F1", 4: "F2", 5: "F5"} if allow else {1: "F1", 2: "F2", 5: "F5"})
    assert log.read("confidence_scores").count() == 4 * len(events)
    assert log.read("alerts").count() == len(events) - 1 and [r.event_id for r in log.read("reviews").collect()] == [2]
    audit = {}
    for r in log.read("audit").collect():
        audit[r.action, r.outcome] = audit.get((r.action, r.outcome), 0) + 1
    copies = ("audio_duplicate_allowed", "success") if allow else ("audio_duplicate_rejected", "failure")
    assert audit == {("audio_upload", "success"): 3, copies: 2, ("prediction", "success"): len(events), ("alert_generated", "success"): len(events) - 1, ("review_queued", "success"): 1}
    before = log.folders("events")
    sink(spark.createDataFrame([(*record(9, "z"), None)], RECORD + ", duplicate_of string"), 0)  # a replay of a committed batch
    assert log.folders("events") == before


def test_commit_log_reads_what_is_committed_only(spark, tmp_path):
    log = TableLog(spark, f"{tmp_path}/t")
    with pytest.raises(ValueError):
        log.read("a")
    assert log.commit("1", {"a": spark.range(3), "b": spark.range(1)}) and not log.commit("1", {"a": spark.range(9)})
    spark.range(50).write.parquet(f"{tmp_path}/t/a/2-lost")
    assert log.read("a").count() == 3 and log.read("b").count() == 1
    assert log.commit("2", {"a": spark.range(4)}) and log.read("a").count() == 7


def test_sources_are_deduplicated_in_one_batch_and_over_batches(spark, tmp_path):
    spark.createDataFrame([(1, 10), (1, 10), (2, 11)], "k long, t long").withColumn("t", F.timestamp_seconds("t")).coalesce(1).write.parquet(f"{tmp_path}/in")
    like = spark.read.parquet(f"{tmp_path}/in")
    out = L.drain(L.ingest(L.read(spark, f"{tmp_path}/in", like), ["k"], "t"), f"{tmp_path}/x")
    assert sorted(r.k for r in out.collect()) == [1, 2]
    like.withColumn("k", F.col("k") + 1).write.mode("append").parquet(f"{tmp_path}/in")
    out = L.drain(L.ingest(L.read(spark, f"{tmp_path}/in", like), ["k"], "t"), f"{tmp_path}/x")
    assert sorted(r.k for r in out.collect()) == [1, 2, 3]
