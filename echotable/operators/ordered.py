"""Ordered logic: streaks, islands, outages, range counts, rate limits, lockouts, lifecycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotable.functions.config import ALERTS_PER_WINDOW, DEDUP_SECONDS, LOCKOUT, REPEAT_RATE_SECONDS, THRESHOLDS
from echotable.operators import scan

LIFECYCLE = {"acknowledge": "Acknowledged", "resolve": "Resolved", "dismiss": "Dismissed", "escalate": "Escalated"}
FINAL = ("Resolved", "Dismissed")


def _seconds(at: str) -> Column:
    return F.col(at).cast("timestamp").cast("double")


def islands(rows: DataFrame, by: list[str], at: str, value: str, tie: str, gap_seconds: float | None = None) -> DataFrame:
    """Contiguous runs of one value: ``(*by, value, started_at, ended_at, length)``.

    A null value equals null. A gap over ``gap_seconds`` ends a run.
    """
    order = Window.partitionBy(*by).orderBy(at, tie)
    new = ~F.col(value).eqNullSafe(F.lag(value).over(order)) | (F.row_number().over(order) == 1)
    if gap_seconds is not None:
        new = new | (_seconds(at) - F.lag(_seconds(at)).over(order) > gap_seconds)
    run = F.sum(F.col("_new").cast("int")).over(order)
    marked = rows.withColumn("_new", new).withColumn("_run", run)
    return marked.groupBy(*by, "_run", value).agg(F.min(at).alias("started_at"), F.max(at).alias("ended_at"), F.count("*").alias("length")).drop("_run")


def confirm_repeats(rows: DataFrame, session: str, at: str, class_col: str, qualifies: str, tie: str, needed: int | None = None, window_seconds: float | None = None, part_rows: int = scan.PART) -> DataFrame:
    """``rows`` with ``consecutive, confirmed, newly_confirmed``, folded in order within each session.

    After a streak fires its count starts over and it stays confirmed. Sessions of any length are folded in parts
    of ``part_rows`` rows at once (``scan.fold``). A null ``qualifies`` is false.
    """
    limits = THRESHOLDS["repeat_detection"]
    needed = needed or limits["required_consecutive_detections"]
    how = scan.Streaks(needed, window_seconds if window_seconds is not None else limits["window_seconds"])
    told = rows.withColumn("_ok", F.coalesce(F.col(qualifies), F.lit(False)))
    return scan.fold(told, session, at, tie, how, [class_col, "_ok"], "consecutive long, confirmed boolean, newly_confirmed boolean", part_rows).drop("_ok")


def sustained(rows: DataFrame, session: str, at: str, class_col: str, tie: str) -> DataFrame:
    """``rows`` with ``sustained_seconds``: how long their class has been on top of the session without a break."""
    order = Window.partitionBy(session).orderBy(at, tie)
    new = F.coalesce(~F.col(class_col).eqNullSafe(F.lag(class_col).over(order)), F.lit(True)) | (F.row_number().over(order) == 1)
    since = F.max(F.when(F.col("_new"), _seconds(at))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_new", new).withColumn("sustained_seconds", _seconds(at) - since).drop("_new")


def outages(probes: DataFrame, by: str, at: str, up: str) -> DataFrame:
    """Runs of failed probes, one still open included: ``(by, started_at, ended_at, length)``."""
    return islands(probes, [by], at, up, at).where(~F.col(up)).drop(up)


def repeats_within(rows: DataFrame, by: list[str], at: str, seconds: int = REPEAT_RATE_SECONDS) -> DataFrame:
    """``rows`` with ``repeats``: events of the group in the last ``seconds``, this one included; those without a time are counted among themselves.

    Seconds are counted, not rows. Time is cut into buckets as long as the window, so that a window is the first part of its
    own bucket and the rest of the one before: two running sums within a bucket, each a task's bounded work.
    """
    keys = [F.col(f"`{c}`").alias(f"_by{i}") for i, c in enumerate(by)]
    names, length = [f"_by{i}" for i in range(len(by))], F.lit(seconds + 1)
    counted = rows.groupBy(*keys, F.floor(_seconds(at)).alias("_sec")).agg(F.count("*").alias("_n"))
    placed = counted.select(*names, "_sec", "_n", F.floor(F.col("_sec") / length).alias("_bucket"), F.pmod("_sec", length).alias("_place"))
    later = placed.select(*names, F.lit(None).cast("long").alias("_sec"), F.col("_n"), (F.col("_bucket") + 1).alias("_bucket"), "_place").where("_bucket is not null")
    told = placed.withColumn("_own", F.lit(True)).unionByName(later.withColumn("_own", F.lit(False)))
    part = Window.partitionBy(*names, "_bucket")
    sofar = part.orderBy("_place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.coalesce(F.sum(F.when(~F.col("_own"), F.col("_n"))).over(part), F.lit(0))
    repeats = before + F.sum(F.when(F.col("_own"), F.col("_n")).otherwise(-F.col("_n"))).over(sofar)
    sums = told.withColumn("repeats", repeats).where("_own").select(*names, "_sec", "repeats")
    same = F.floor(_seconds(at)).eqNullSafe(F.col("_sec"))
    for name, c in zip(names, by):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(name))
    return rows.join(sums, same, "left").drop(*names, "_sec")


def collapse_repeats(alerts: DataFrame, key: str, at: str, tie: str, seconds: int = DEDUP_SECONDS) -> DataFrame:
    """One row per burst of alerts with one key: ``(key, first_at, last_at, n)``; a burst is gapless."""
    marked = alerts.withColumn("_same", F.lit(1))
    return islands(marked, [key], at, "_same", tie, seconds).select(key, F.col("started_at").alias("first_at"), F.col("ended_at").alias("last_at"), F.col("length").alias("n"))


def capped(alerts: DataFrame, by: str, at: str, window_seconds: int, most: int = ALERTS_PER_WINDOW) -> DataFrame:
    """``alerts`` with ``within_cap``: at most ``most`` in the trailing window."""
    return repeats_within(alerts, [by], at, window_seconds).withColumn("within_cap", F.col("repeats") <= most).drop("repeats")


def rate_limited(rows: DataFrame, by: str, at: str, tie: str, most: int, seconds: int, part_rows: int = scan.PART) -> DataFrame:
    """``rows`` with ``allowed``: a sliding limit in which refused attempts don't count."""
    return scan.fold(rows, by, at, tie, scan.RateLimit(most, seconds), [], "allowed boolean", part_rows)


def lockouts(attempts: DataFrame, user: str, at: str, tie: str, failed: str, failures: int = LOCKOUT["failures"], minutes: int = LOCKOUT["minutes"], part_rows: int = scan.PART) -> DataFrame:
    """``(user, n_lockouts, n_refused)``: a lock after ``failures`` in a row; attempts while locked are refused."""
    rows = attempts.where(F.col(user).isNotNull()).select(user, at, tie, F.coalesce(F.col(failed), F.lit(False)).alias("_failed"))
    told = scan.fold(rows, user, at, tie, scan.Lockouts(failures, 60 * minutes), ["_failed"], "locked boolean, refused boolean", part_rows)
    return told.groupBy(user).agg(F.count_if("locked").alias("n_lockouts"), F.count_if("refused").alias("n_refused"))


def replay_lifecycle(actions: DataFrame, alert: str, at: str, tie: str, action: str) -> DataFrame:
    """``(alert, status, n_refused)``: acknowledge, resolve, dismiss and escalate in order; final states refuse changes.

    Whatever comes before it, the first final action decides, else the last known one; so two grouped aggregates are
    enough, and a busy alert is no single task's list. Unknown actions before the end change nothing.
    """
    named = F.create_map(*[F.lit(x) for pair in LIFECYCLE.items() for x in pair])[F.col(action)]
    rows = actions.select(F.col(alert).alias("_alert"), F.struct(at, tie, action).alias("_at"), named.alias("_status"))
    final = F.col("_status").isin(*FINAL)
    ends = rows.groupBy("_alert").agg(F.min(F.when(final, F.struct("_at", "_status"))).alias("_end"), F.max(F.when(F.col("_status").isNotNull(), F.struct("_at", "_status"))).alias("_last"))
    late = rows.join(ends.where("_end is not null").select("_alert", F.col("_end._at").alias("_since")), "_alert").where("_at > _since").groupBy("_alert").agg(F.count("*").alias("n_refused"))
    status = F.coalesce("_end._status", "_last._status", F.lit("New"))
    return ends.join(late, "_alert", "left").select(F.col("_alert").alias(alert), status.alias("status"), F.coalesce("n_refused", F.lit(0)).cast("long").alias("n_refused"))
