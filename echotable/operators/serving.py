"""Search, dashboards, monitoring and retention over event tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotable.functions import scores as S
from echotable.functions.config import CHECKED_ACTIONS, LEAST_BASELINE, PURGE_BATCH, RETENTION_BY_SEVERITY, RETENTION_DAYS, SEVERITIES, THRESHOLDS

#: Sort keys of the seven documented orders; every order ends with the id.
ORDERS = {
    "newest": [("created_at", "desc")], "oldest": [("created_at", "asc")], "confidence_desc": [("python_confidence", "desc")], "confidence_asc": [("python_confidence", "asc")],
    "difference_desc": [("difference", "desc")], "difference_asc": [("difference", "asc")], "severity": [("severity", "rank")],
}


def canonical(values, known: list[str] | tuple[str, ...]) -> tuple[list[str], list[str]]:
    """Known names (in their own case) and unknown ones from repeated or comma-joined arguments."""
    wanted = [v.strip() for part in ([values] if isinstance(values, str) else values or []) for v in part.split(",") if v.strip()]
    by_fold = {k.casefold(): k for k in known}
    return [by_fold[v.casefold()] for v in wanted if v.casefold() in by_fold], [v for v in wanted if v.casefold() not in by_fold]


def search(events: DataFrame, filters: dict) -> DataFrame:
    """Conjunction of the given filters: lists by membership, ranges inclusive, an end date whole.

    Null columns match no filter, as in SQL.
    """
    tests: list[Column] = []
    for name in ("class_name", "severity", "quality", "status", "consistency", "source"):
        if filters.get(name):
            tests.append(F.col(name).isin(list(filters[name])))
    if filters.get("since"):
        tests.append(F.col("created_at") >= F.lit(filters["since"]).cast("timestamp"))
    if filters.get("until"):
        tests.append(F.col("created_at") < F.date_add(F.lit(filters["until"]).cast("date"), 1).cast("timestamp"))
    for name in ("python_confidence", "difference"):
        lo, hi = filters.get(name, (None, None))
        tests += [F.col(name) >= lo] * (lo is not None) + [F.col(name) <= hi] * (hi is not None)
    for name in ("review_required", "critical_class"):
        if filters.get(name) is not None:
            tests.append(F.col(name) == filters[name])
    if filters.get("text"):
        needle = f"%{filters['text']}%"
        tests.append(reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(needle), F.lit(False)) for c in filters["text_columns"]]))
    return reduce(lambda df, t: df.where(t), tests, events)


def visible_to(events: DataFrame, viewer, sees_all: bool = False) -> DataFrame:
    """A viewer's own events; all for a role that may; none without a viewer."""
    if viewer is None:
        return events.where(F.lit(False))
    return events if sees_all else events.where(F.col("created_by") == viewer)


def review_state(events: DataFrame, reviews: DataFrame, state: str) -> DataFrame:
    """Events that are queued, decided or not queued, by their reviews."""
    by = reviews.groupBy("event_id").agg(F.max(F.col("status") != "Decided").alias("pending"))
    if state == "not_queued":
        return events.join(by, "event_id", "left_anti")
    return events.join(by.where("pending" if state == "queued" else "not pending"), "event_id", "left_semi")


def involving(events: DataFrame, reviews: DataFrame, name: str) -> DataFrame:
    """Events that a person created or reviewed."""
    keys = events.where(F.col("created_by").cast("string") == name).select("event_id").union(reviews.where(F.col("reviewer") == name).select("event_id"))
    return events.join(keys.distinct(), "event_id", "left_semi")


def order_by(events: DataFrame, order: str, key: str = "event_id") -> DataFrame:
    """One of the documented orders; nulls last when falling, first when rising."""
    cols = []
    for name, how in ORDERS[order]:
        c = S.severity_rank(F.col(name)) if how == "rank" else F.col(name)
        cols.append(c.asc_nulls_first() if how == "asc" else c.desc_nulls_last())
    return events.orderBy(*cols, F.col(key).desc())


def page(events: DataFrame, order: str, number: int, size: int, key: str = "event_id") -> DataFrame:
    """Page ``number`` from 1. Deep pages cost a full sort; the first ones a top-k."""
    return order_by(events, order, key).offset((number - 1) * size).limit(size)


def latest(rows: DataFrame, by: str, at: str, key: str) -> DataFrame:
    """The latest row of each group, equal times by the larger key."""
    cols = [c for c in rows.columns if c != by]
    return rows.groupBy(by).agg(F.max_by(F.struct(*cols), F.struct(at, key)).alias("x")).select(by, "x.*")


def since(rows: DataFrame, now: Column, hours: int, at: str = "created_at") -> DataFrame:
    """Rows of the last ``hours`` before ``now``."""
    return rows.where((F.col(at) > now - F.make_interval(hours=F.lit(hours))) & (F.col(at) <= now))


def zero_filled(counts: DataFrame, col: str, order: tuple[str, ...], value: str = "n") -> DataFrame:
    """Counts for every value of a fixed list."""
    dim = counts.sparkSession.createDataFrame([(x, i) for i, x in enumerate(order)], f"{col} string, place int")
    return F.broadcast(dim).join(counts, col, "left").select(col, "place", F.coalesce(value, F.lit(0)).cast("long").alias(value))


def histogram(rows: DataFrame, col: str, bins: int = 10) -> DataFrame:
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col(col) * bins))).cast("int")
    return rows.where(F.col(col).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def daily(rows: DataFrame, now: Column, days: int = 14, at: str = "created_at") -> DataFrame:
    """Counts of each of the last ``days`` days, empty ones as 0."""
    spark = rows.sparkSession
    last = F.to_date(now)
    calendar = spark.range(days).select(F.date_sub(last, F.col("id").cast("int")).alias("day"))
    counts = rows.where((F.to_date(at) > F.date_sub(last, days)) & (F.to_date(at) <= last)).groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n"))
    return F.broadcast(calendar).join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def anomalies(events: DataFrame, alerts: DataFrame, reviews: DataFrame, audit: DataFrame, users: DataFrame, now: Column, limits=THRESHOLDS["monitoring"], floor: float = THRESHOLDS["confidence"]["min_confidence"]) -> DataFrame:
    """``(check, observed, threshold)`` of each of the eight checks that fires; one aggregate per table.

    ``audit``: at, action, outcome; ``users``: locked_until. Low confidence is below ``floor``; events
    without a confidence don't count. The error rate and the queue depth fire above their limit, the
    others at it; a locked account fires ``failed_logins`` by itself.
    """
    start, week = now - F.make_interval(mins=F.lit(limits["window_minutes"])), now - F.make_interval(days=F.lit(7))
    scored, low = F.col("python_confidence").isNotNull(), F.col("python_confidence") < floor
    recent, before = (F.col("created_at") >= start) & (F.col("created_at") <= now), (F.col("created_at") >= week) & (F.col("created_at") < start)
    e = events.agg(F.count_if(recent & scored).alias("n"), F.count_if(recent & low).alias("low"), F.count_if(before & scored).alias("n0"), F.count_if(before & low).alias("low0"))
    a = alerts.agg(F.count_if((F.col("severity") == "Critical") & recent).alias("critical"))
    r = reviews.agg(F.count_if(F.col("status") == "Pending Review").alias("queue"))
    new = (F.col("at") >= start) & (F.col("at") <= now)
    failed = F.col("outcome") == "failure"
    done = lambda name: new & F.col("action").isin(*CHECKED_ACTIONS[name]) & (failed if name == "failed_uploads" else F.lit(True))
    t = audit.agg(F.count_if(new).alias("actions"), F.count_if(new & failed).alias("failures"), *[F.count_if(done(name)).alias(name) for name in CHECKED_ACTIONS])
    u = users.agg(F.count_if(F.col("locked_until") > now).alias("locked"))
    one = e.crossJoin(a).crossJoin(r).crossJoin(t).crossJoin(u)  # one row each
    share = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    usual = limits["low_confidence_vs_baseline"] * F.greatest(share("low0", "n0"), F.lit(LEAST_BASELINE))
    reached = lambda name: F.col(name) >= limits[name]
    checks = [
        ("failed_uploads", F.col("failed_uploads"), limits["failed_uploads"], reached("failed_uploads")),
        ("model_failures", F.col("model_failures"), limits["model_failures"], reached("model_failures")),
        ("low_confidence_spike", share("low", "n"), limits["low_confidence_share"], (F.col("n") >= limits["low_confidence_min_events"]) & (share("low", "n") >= limits["low_confidence_share"]) & (share("low", "n") >= usual)),
        ("critical_alerts", F.col("critical"), limits["critical_alerts"], F.col("critical") >= limits["critical_alerts"]),
        ("duplicate_files", F.col("duplicate_files"), limits["duplicate_files"], reached("duplicate_files")),
        ("failed_logins", F.col("failed_logins"), limits["failed_logins"], reached("failed_logins") | (F.col("locked") > 0)),
        ("error_rate", share("failures", "actions"), limits["error_rate"], share("failures", "actions") > limits["error_rate"]),
        ("review_queue", F.col("queue"), limits["review_queue_depth"], F.col("queue") > limits["review_queue_depth"]),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("check"), v.cast("double").alias("observed"), F.lit(float(t)).alias("threshold"), ok.alias("fired")) for n, v, t, ok in checks])
    return one.select(F.explode(rows).alias("x")).select("x.*").where("fired").drop("fired")


def with_files(events: DataFrame, files: DataFrame) -> DataFrame:
    """Events with the columns of their audio file; an event without a file is left out."""
    return events.join(files, "audio_key")


def paged(events: DataFrame, order: str, number: int, size: int, key: str = "event_id") -> DataFrame:
    """One page with ``total``, the rows of all pages, and ``pages`` beside each row."""
    total = events.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))
    return page(events, order, number, size, key).crossJoin(F.broadcast(total))  # one row


def summary_cards(events: DataFrame, alerts: DataFrame, reviews: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """One row of the dashboard's totals; one aggregate for each table."""
    recent = (F.col("created_at") > now - F.make_interval(hours=F.lit(hours))) & (F.col("created_at") <= now)
    is_ = lambda c, v: F.col(c) == v
    e = events.agg(
        F.count("*").alias("events_total"), F.count_if(recent).alias("events_window"), F.count_if("review_required").alias("awaiting_review"),
        F.count_if(recent & is_("severity", "Critical")).alias("critical_window"), F.count_if(is_("consistency", "Strong Match")).alias("strong"),
        F.count_if(is_("consistency", "Model Disagreement")).alias("disagreements"), F.count_if(is_("consistency", "Uncertain Result")).alias("uncertain"),
        F.count_if(is_("source", "microphone")).alias("live"), F.count_if(is_("quality", "Unusable")).alias("unusable"),
    )
    a = alerts.agg(F.count_if(is_("status", "New")).alias("open_alerts"), F.count_if(is_("status", "Acknowledged")).alias("acknowledged_alerts"), F.count_if("false_alarm").alias("false_alarms"))
    r = reviews.agg(F.count_if(is_("status", "Pending Review")).alias("queue_depth"), F.count_if(is_("status", "Decided")).alias("decided"))
    return e.crossJoin(a).crossJoin(r)  # one row each


def retention_days(artifact: str, severity: Column) -> Column:
    """Days that an artifact is kept: the longer of the default and the severity's own; null keeps it for ever."""
    default = RETENTION_DAYS[artifact]
    days = F.lit(default).cast("int")
    for s in SEVERITIES:
        own = RETENTION_BY_SEVERITY.get(s, {}).get(artifact)
        if own and default is not None:
            days = F.when(severity == s, F.lit(max(default, own))).otherwise(days)
    return days


def due_for_purge(rows: DataFrame, now: Column, batch: int = PURGE_BATCH) -> DataFrame:
    """``(artifact, id, created_at, keep_days)``: of each kind of artifact the oldest ``batch`` whose time is over.

    ``rows``: artifact, id, created_at, severity, held. A held row stays, and one of a kind without a limit.
    """
    days = F.lit(None).cast("int")
    for name in RETENTION_DAYS:
        days = F.when(F.col("artifact") == name, retention_days(name, F.col("severity"))).otherwise(days)
    due = rows.where(~F.coalesce("held", F.lit(False))).select("artifact", "id", "created_at", days.alias("keep_days"))
    due = due.where(F.date_add(F.to_date("created_at"), F.col("keep_days")) < F.to_date(now))
    order = Window.partitionBy("artifact").orderBy("created_at", "id")
    return due.withColumn("place", F.row_number().over(order)).where(F.col("place") <= batch).drop("place")


def retention_plan(files: DataFrame, events: DataFrame, alerts: DataFrame, reviews: DataFrame, now: Column, batch: int = PURGE_BATCH) -> DataFrame:
    """``(audio_key, created_at, keep_days)`` of the files to purge, the oldest ``batch``.

    A file is held while flagged, or while any of its events has a pending review or an alert that
    isn't final. ``files``: audio_key, created_at, flagged; ``events``: event_id, audio_key, severity.
    """
    pending = reviews.where(F.col("status").isin("Pending Review", "Manual Review")).select("event_id")
    unfinished = alerts.where(~F.col("status").isin("Resolved", "Dismissed")).select("event_id")
    held = events.join(pending.union(unfinished).distinct(), "event_id", "left_semi").select("audio_key").distinct()
    days = events.groupBy("audio_key").agg(F.max(retention_days("audio", F.col("severity"))).alias("keep_days"))
    due = files.where("not flagged").join(held, "audio_key", "left_anti").join(days, "audio_key", "left")
    due = due.withColumn("keep_days", F.coalesce("keep_days", F.lit(RETENTION_DAYS["audio"])))
    due = due.where(F.date_add(F.to_date("created_at"), F.col("keep_days")) < F.to_date(now))
    return due.orderBy("created_at", "audio_key").limit(batch)


def within_budget(rows: DataFrame, elapsed_ms: str, budget_sec: str) -> DataFrame:
    """``rows`` with ``within_budget`` and, where it isn't, ``budget_overrun_ms``; a missing budget is 0."""
    over = F.round(F.col(elapsed_ms) - F.coalesce(budget_sec, F.lit(0.0)) * 1000, 3)
    return rows.withColumn("within_budget", over <= 0).withColumn("budget_overrun_ms", F.when(over > 0, over))


def filled(template: str, columns: list[str]) -> Column:
    """A reason text with ``{name}`` and ``{name:.2f}`` replaced by columns; names not in ``columns`` stay as they are.

    A null is written as ``None``.
    """
    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)(?::\.(\d+)f)?\}", template):
        if m[1] not in columns:
            continue
        # rounds the exact binary value, ties to even
        value = F.expr(f"format_number(cast(`{m[1]}` as double), '0{'.' * (m[2] > '0')}{'0' * int(m[2])}')") if m[2] else F.col(m[1]).cast("string")
        parts += [F.lit(template[at : m.start()]), F.when(F.col(m[1]).isNull(), "None").otherwise(value)]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def dedup_key(*parts: Column) -> Column:
    """Lower-case, trimmed parts joined by a bar; inner white space counts as one space, null as empty."""
    return F.concat_ws("|", *[F.regexp_replace(F.lower(F.trim(F.coalesce(p.cast("string"), F.lit("")))), r"\s+", " ") for p in parts])


def snapshot(rows: DataFrame, columns: list[str], name: str = "snapshot") -> DataFrame:
    """``rows`` with some columns as one JSON text beside the others."""
    return rows.select(*[c for c in rows.columns if c not in columns], F.to_json(F.struct(*columns)).alias(name))


def restored(rows: DataFrame, schema: str, name: str = "snapshot") -> DataFrame:
    """The reverse of ``snapshot``; a text that isn't JSON of the schema gives nulls."""
    return rows.withColumn(name, F.from_json(name, schema)).select(*[c for c in rows.columns if c != name], f"{name}.*")


def newest(rows: DataFrame, n: int, at: str = "created_at", tie: str = "event_id") -> DataFrame:
    """The ``n`` newest rows, newest first; of equal times the larger ``tie`` first. Every task keeps ``n`` of its own."""
    return rows.orderBy(F.col(at).desc(), F.col(tie).desc()).limit(n)


def alert_queue(alerts: DataFrame, status: str = "New", severities: list[str] | None = None, page: int = 1, size: int = 25) -> DataFrame:
    """A page of alerts, newest first; ``status`` 'all' takes every one."""
    rows = alerts if status == "all" else alerts.where(F.col("status") == status)
    rows = rows.where(F.col("severity").isin(severities)) if severities else rows
    return rows.orderBy(F.col("created_at").desc(), F.col("alert_id").desc()).offset((page - 1) * size).limit(size)


def latest_detection(events: DataFrame, scores: DataFrame, alerts: DataFrame, top: int = 3) -> DataFrame:
    """The newest event as one row, with the first ``top`` classes of each model in rank order and the status of its newest alert."""
    one = newest(events, 1)
    ranked = scores.where(F.col("rank") <= top).join(F.broadcast(one.select("event_id")), "event_id", "left_semi")
    names = ranked.groupBy("event_id").pivot("model", ["python", "gtm"]).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "class_name"))), lambda x: x.class_name), ","))
    last = alerts.join(F.broadcast(one.select("event_id")), "event_id", "left_semi").groupBy("event_id").agg(F.max_by("status", F.struct("created_at", "alert_id")).alias("alert_status"))
    return one.join(names, "event_id", "left").join(last, "event_id", "left")
