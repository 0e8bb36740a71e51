"""Queries on events, alerts and reviews: search, dashboards, monitoring, retention, ordered logic."""

from __future__ import annotations

from pyspark.sql import functions as F

from echotable.functions import scores as S
from echotable.functions.config import SEVERITIES, STATUSES
from echotable.operators import compare as C
from echotable.operators import decisions as Y
from echotable.operators import ordered as O
from echotable.operators import select as X
from echotable.operators import serving as V
from echotable.sources import domain as D

QUERIES, ORACLES = {}, {}
_NOW = f"TIMESTAMP '{D.NOW}'"


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("f1_search_events", f"WITH {D.EVENTS} SELECT event_id, class_name, severity FROM ev WHERE class_name IN ('error', 'click') AND severity IN ('High', 'Critical') AND created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-21' AND python_confidence BETWEEN 0.2 AND 0.9 AND review_required")
def f1(spark, d):
    f = {"class_name": ["error", "click"], "severity": ["High", "Critical"], "since": "2024-01-10", "until": "2024-01-20", "python_confidence": (0.2, 0.9), "review_required": True}
    return V.search(D.sound_events(spark, d), f).select("event_id", "class_name", "severity")


@query("f2_viewer_scope", f"WITH {D.EVENTS} SELECT event_id, created_by FROM ev WHERE created_by = 8")
def f2(spark, d):
    return V.visible_to(D.sound_events(spark, d), 8).select("event_id", "created_by")


_SIX = ("class_name", "severity", "consistency", "audio_id", "filename", "username")


def _with_files(spark, d):
    e = D.sound_events(spark, d).withColumn("audio_key", F.col("event_id") % 1000)
    return V.with_files(e, D.audio_files(spark, d))


_JOINED = f"{D.EVENTS}, {D.FILES}, ja AS (SELECT * FROM ev JOIN au ON event_id % 1000 = audio_key)"


@query("j1_event_files", f"WITH {_JOINED} SELECT event_id, class_name, audio_id, filename FROM ja")
def j1(spark, d):
    return _with_files(spark, d).select("event_id", "class_name", "audio_id", "filename")


@query("f3_name_contains", f"WITH {_JOINED} SELECT event_id, audio_id, filename FROM ja WHERE filename ILIKE '%clip_DE-1%' OR username ILIKE '%clip_DE-1%' OR audio_id ILIKE '%clip_DE-1%'")
def f3(spark, d):
    return V.search(_with_files(spark, d), {"text": "clip_DE-1", "text_columns": ("audio_id", "filename", "username")}).select("event_id", "audio_id", "filename")


@query("f4_free_text", f"WITH {_JOINED} SELECT event_id, filename FROM ja WHERE {' OR '.join(f"{c} ILIKE '%RIT%'" for c in _SIX)}")
def f4(spark, d):
    return V.search(_with_files(spark, d), {"text": "RIT", "text_columns": _SIX}).select("event_id", "filename")


@query("f6_canonical_names", f"WITH {D.EVENTS} SELECT event_id, severity FROM ev WHERE severity IN ('High', 'Low')")
def f6(spark, d):
    names, _ = V.canonical(["HIGH, low", "unheard-of"], SEVERITIES)
    return V.search(D.sound_events(spark, d), {"severity": names}).select("event_id", "severity")


@query("f7_date_range", f"WITH {D.EVENTS} SELECT event_id, created_at FROM ev WHERE created_at >= TIMESTAMP '2024-01-03' AND created_at < TIMESTAMP '2024-01-06'")
def f7(spark, d):
    return V.search(D.sound_events(spark, d), {"since": "2024-01-03", "until": "2024-01-05"}).select("event_id", "created_at")


@query("f5_review_state", f"WITH {D.EVENTS}, {D.REVIEWS}, b AS (SELECT event_id, bool_or(status <> 'Decided') AS pending FROM rv GROUP BY 1) SELECT event_id FROM ev JOIN b USING (event_id) WHERE pending")
def f5(spark, d):
    return V.review_state(D.sound_events(spark, d), D.reviews(spark, d), "queued").select("event_id")


@query("f8_look_back", f"WITH {D.EVENTS} SELECT event_id, created_at FROM ev WHERE created_at > {_NOW} - INTERVAL 36 HOUR AND created_at <= {_NOW}")
def f8(spark, d):
    return V.since(D.sound_events(spark, d), D.now(), 36).select("event_id", "created_at")


@query("f9_audit_trail", "SELECT event_id, event_type AS action, user_id AS actor, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome FROM events WHERE event_type IN ('error', 'signup') ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 50")
def f9(spark, d):
    a = D.table(spark, d, "events").select("event_id", F.col("event_type").alias("action"), F.col("user_id").alias("actor"), F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("outcome"), "ts")
    return a.where("action in ('error', 'signup')").orderBy(F.desc("ts"), F.desc("event_id")).offset(50).limit(50).drop("ts")


@query("f17_illegal_values", f"WITH {D.ALERTS} SELECT status, count(*) AS n FROM al WHERE status NOT IN ('New', 'Acknowledged') GROUP BY 1")
def f17(spark, d):
    return D.alerts(spark, d).where(~F.col("status").isin("New", "Acknowledged")).groupBy("status").agg(F.count("*").alias("n"))


@query("f18_overdue_reviews", f"WITH {D.REVIEWS} SELECT review_id, priority FROM rv WHERE status = 'Pending Review' AND queued_at < {_NOW} - INTERVAL 60 MINUTE")
def f18(spark, d):
    late = F.col("queued_at") < D.now() - F.make_interval(mins=F.lit(60))
    return D.reviews(spark, d).where((F.col("status") == "Pending Review") & late).select("review_id", "priority")


@query("j2_involving_person", f"WITH {D.EVENTS}, {D.REVIEWS} SELECT event_id FROM ev WHERE event_id IN (SELECT event_id FROM rv WHERE reviewer = 'src3') OR created_by::VARCHAR = 'src3'")
def j2(spark, d):
    return V.involving(D.sound_events(spark, d), D.reviews(spark, d), "src3").select("event_id")


@query("j3_event_document", f"""WITH {D.EVENTS}, {D.REVIEWS}, r AS (SELECT event_id, count(*) AS n_reviews, min(review_id) AS first_review FROM rv GROUP BY 1)
SELECT event_id, class_name, severity, coalesce(n_reviews, 0) AS n_reviews, first_review FROM ev LEFT JOIN r USING (event_id)""")
def j3(spark, d):
    r = D.reviews(spark, d).groupBy("event_id").agg(F.count("*").alias("n_reviews"), F.min("review_id").alias("first_review"))
    return D.sound_events(spark, d).join(r, "event_id", "left").select("event_id", "class_name", "severity", F.coalesce("n_reviews", F.lit(0)).cast("long").alias("n_reviews"), "first_review")


@query("j4_review_context", f"WITH {D.EVENTS}, {D.REVIEWS} SELECT review_id, rv.status, class_name, created_at FROM rv LEFT JOIN ev USING (event_id)")
def j4(spark, d):
    e = D.sound_events(spark, d).select("event_id", "class_name", "created_at")
    return D.reviews(spark, d).join(e, "event_id", "left").select("review_id", "status", "class_name", "created_at")


@query("j19_latest_review", f"WITH {D.REVIEWS} SELECT event_id, max_by(review_id, (queued_at, review_id)) AS review_id FROM rv GROUP BY 1")
def j19(spark, d):
    return V.latest(D.reviews(spark, d).select("event_id", "review_id", "queued_at"), "event_id", "queued_at", "review_id").select("event_id", "review_id")


@query("j19_window_as_of", """SELECT l.event_id, r.event_id AS window_id FROM (SELECT * FROM events WHERE event_type = 'error') l ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def j19_window(spark, d):
    """The latest viewed window of its session before each error."""
    e = D.table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    seen = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("window_id"), "ts")
    return X.as_of(e.where("event_type = 'error'"), seen, ["user_id"], "ts", "ts", ["window_id"], "window_id").select("event_id", "window_id")


@query("j19_alert_as_of", f"WITH {D.ALERTS} SELECT l.alert_id, r.alert_id AS resolved_alert FROM al l ASOF LEFT JOIN (SELECT source_key, resolved_at, max(alert_id) AS alert_id FROM al WHERE status = 'Resolved' GROUP BY 1, 2) r ON l.source_key = r.source_key AND l.created_at >= r.resolved_at")
def j19_alert(spark, d):
    """The source's latest alert that was resolved when each alert was raised."""
    al = D.alerts(spark, d).select("alert_id", "source_key", "created_at", "resolved_at", "status")
    known = al.where("status = 'Resolved' and resolved_at is not null").select("source_key", "resolved_at", F.col("alert_id").alias("resolved_alert"))
    return X.as_of(al, known, ["source_key"], "created_at", "resolved_at", ["resolved_alert"], "resolved_alert").select("alert_id", "resolved_alert")


@query("j19_review_as_of", f"""WITH {D.REVIEWS}, a AS (SELECT event_id, event_id % 700 AS k, {_NOW} - to_minutes(event_id % 200) AS at_ FROM events)
SELECT a.event_id, r.review_id FROM a ASOF LEFT JOIN (SELECT event_id, queued_at, max(review_id) AS review_id FROM rv GROUP BY 1, 2) r ON a.k = r.event_id AND a.at_ >= r.queued_at""")
def j19_review(spark, d):
    """The latest review that an event had at the time it was looked at."""
    looked = D.table(spark, d, "events").select("event_id", (F.col("event_id") % 700).alias("k"), (D.now() - F.make_dt_interval(mins=(F.col("event_id") % 200).cast("int"))).alias("at"))
    known = D.reviews(spark, d).select(F.col("event_id").alias("k"), "queued_at", "review_id")
    return X.as_of(looked, known, ["k"], "at", "queued_at", ["review_id"], "review_id").select("event_id", "review_id")


@query("a1_counts", f"WITH {D.EVENTS} SELECT severity, consistency, class_name, count(*) AS n FROM ev WHERE created_at > {_NOW} - INTERVAL 240 HOUR AND created_at <= {_NOW} GROUP BY 1, 2, 3")
def a1(spark, d):
    return V.since(D.sound_events(spark, d), D.now(), 240).groupBy("severity", "consistency", "class_name").agg(F.count("*").alias("n"))


@query("a2_summary_cards", f"""WITH {D.EVENTS}, {D.ALERTS}, {D.REVIEWS}, w AS (SELECT *, created_at > {_NOW} - INTERVAL 240 HOUR AND created_at <= {_NOW} AS recent FROM ev)
SELECT * FROM (SELECT count(*) AS events_total, count(*) FILTER (recent) AS events_window, count(*) FILTER (review_required) AS awaiting_review, count(*) FILTER (recent AND severity = 'Critical') AS critical_window,
  count(*) FILTER (consistency = 'Strong Match') AS strong, count(*) FILTER (consistency = 'Model Disagreement') AS disagreements, count(*) FILTER (consistency = 'Uncertain Result') AS uncertain,
  count(*) FILTER (source = 'microphone') AS live, count(*) FILTER (quality = 'Unusable') AS unusable FROM w),
 (SELECT count(*) FILTER (status = 'New') AS open_alerts, count(*) FILTER (status = 'Acknowledged') AS acknowledged_alerts, count(*) FILTER (false_alarm) AS false_alarms FROM al),
 (SELECT count(*) FILTER (status = 'Pending Review') AS queue_depth, count(*) FILTER (status = 'Decided') AS decided FROM rv)""")
def a2(spark, d):
    return V.summary_cards(D.sound_events(spark, d), D.alerts(spark, d), D.reviews(spark, d), D.now(), 240)


@query("a3_class_analytics", f"WITH {D.EVENTS} SELECT class_name, count(*) AS n, round(coalesce(avg(python_confidence), 0), 4) AS mean_confidence, round(coalesce(avg(difference), 0), 4) AS mean_difference FROM ev GROUP BY 1")
def a3(spark, d):
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    return D.sound_events(spark, d).groupBy("class_name").agg(F.count("*").alias("n"), mean("python_confidence").alias("mean_confidence"), mean("difference").alias("mean_difference"))


@query("a4_model_agreement", f"""WITH {D.EVENTS} SELECT CASE WHEN difference <= 0.05 THEN 'strong' WHEN difference <= 0.15 THEN 'acceptable' WHEN difference <= 0.3 THEN 'weak' ELSE 'apart' END AS band,
  count(*) AS n, count(*) FILTER (consistency NOT IN ('Model Disagreement', 'Uncertain Result')) AS agreed FROM ev GROUP BY 1""")
def a4(spark, d):
    x = F.col("difference")
    band = F.when(x <= 0.05, "strong").when(x <= 0.15, "acceptable").when(x <= 0.3, "weak").otherwise("apart")
    return D.sound_events(spark, d).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.count_if(~F.col("consistency").isin("Model Disagreement", "Uncertain Result")).alias("agreed"))


@query("a5_consistency_zero_filled", f"WITH {D.EVENTS} SELECT s AS consistency, (SELECT count(*) FROM ev WHERE consistency = s AND class_name = 'error' AND severity = 'Low' AND quality = 'Unusable') AS n FROM (SELECT unnest({list(STATUSES)}) AS s)")
def a5(spark, d):
    c = D.sound_events(spark, d).where("class_name = 'error' and severity = 'Low' and quality = 'Unusable'").groupBy("consistency").agg(F.count("*").alias("n"))
    return V.zero_filled(c, "consistency", STATUSES).drop("place")


@query("a6_alert_analytics", f"WITH {D.ALERTS} SELECT severity, status, count(*) AS n, count(*) FILTER (false_alarm) AS false_alarms FROM al GROUP BY GROUPING SETS ((severity), (status))")
def a6(spark, d):
    c = D.alerts(spark, d).groupingSets([["severity"], ["status"]], "severity", "status")
    return c.agg(F.count("*").alias("n"), F.count_if("false_alarm").alias("false_alarms"))


@query("a7_quality", f"WITH {D.EVENTS} SELECT quality, count(*) AS n, round(avg((consistency <> 'Model Disagreement')::INT), 4) AS agreement_rate, round(avg(difference), 4) AS mean_difference FROM ev GROUP BY 1")
def a7(spark, d):
    agree = F.when(F.col("consistency") == "Model Disagreement", 0).otherwise(1)
    return D.sound_events(spark, d).groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg(agree), 4).alias("agreement_rate"), F.round(F.avg("difference"), 4).alias("mean_difference"))


@query("a8_reviewers", f"WITH {D.REVIEWS} SELECT reviewer, count(*) FILTER (decision = 'confirm') AS confirm, count(*) FILTER (decision = 'override') AS override, round(count(*) FILTER (decision = 'override') / greatest(1, count(decision)), 4) AS override_rate FROM rv GROUP BY 1")
def a8(spark, d):
    g = D.reviews(spark, d).groupBy("reviewer").agg(F.count_if(F.col("decision") == "confirm").alias("confirm"), F.count_if(F.col("decision") == "override").alias("override"), F.count("decision").alias("decided"))
    return g.select("reviewer", "confirm", "override", F.round(F.col("override") / F.greatest(F.lit(1), F.col("decided")), 4).alias("override_rate"))


@query("a9_timeline", f"WITH {D.EVENTS} SELECT date_trunc('hour', created_at) AS bucket, count(*) AS n FROM ev GROUP BY 1")
def a9(spark, d):
    return D.sound_events(spark, d).groupBy(F.date_trunc("hour", "created_at").alias("bucket")).agg(F.count("*").alias("n"))


@query("a10_daily_series", f"""WITH {D.EVENTS}, c AS (SELECT CAST({_NOW} AS DATE) - i::INT AS day FROM range(14) t(i))
SELECT day, (SELECT count(*) FROM ev WHERE CAST(created_at AS DATE) = day AND severity = 'Critical' AND class_name = 'error') AS n FROM c""")
def a10(spark, d):
    return V.daily(D.sound_events(spark, d).where("severity = 'Critical' and class_name = 'error'"), D.now())


@query("a11_confidence_histogram", f"WITH {D.EVENTS} SELECT least(9, greatest(0, floor(python_confidence * 10)))::INT AS bin, count(*) AS n FROM ev GROUP BY 1")
def a11(spark, d):
    return V.histogram(D.sound_events(spark, d), "python_confidence")


@query("a12_false_positives", f"WITH {D.REVIEWS} SELECT original_class, count(*) FILTER (decision = 'override' AND review_id % 2 = 0) AS fp, count(*) FILTER (decision = 'override' AND review_id % 2 = 1) AS fn FROM rv GROUP BY 1")
def a12(spark, d):
    over = F.col("decision") == "override"
    return D.reviews(spark, d).groupBy("original_class").agg(F.count_if(over & (F.col("review_id") % 2 == 0)).alias("fp"), F.count_if(over & (F.col("review_id") % 2 == 1)).alias("fn"))


@query("a13_alert_response", f"WITH {D.ALERTS} SELECT severity, median(epoch(acknowledged_at) - epoch(created_at)) AS median_ack, median(epoch(resolved_at) - epoch(created_at)) AS median_resolve, count(*) FILTER (acknowledged_at IS NULL) AS unacknowledged FROM al GROUP BY 1")
def a13(spark, d):
    sec = lambda c: F.col(c).cast("timestamp").cast("double")
    al = D.alerts(spark, d).withColumns({"ack": sec("acknowledged_at") - sec("created_at"), "resolve": sec("resolved_at") - sec("created_at")})
    out = al.groupBy("severity").agg(F.count_if(F.col("acknowledged_at").isNull()).alias("unacknowledged"))
    for c in ("ack", "resolve"):
        out = out.join(X.summary(al, "severity", c).select("severity", F.col("median").alias(f"median_{c}")), "severity", "left")
    return out


@query("a14_review_progress", f"WITH {D.REVIEWS} SELECT count(*) AS n, round(100.0 * count(*) FILTER (status = 'Decided') / count(*), 2) AS progress FROM rv")
def a14(spark, d):
    return D.reviews(spark, d).agg(F.count("*").alias("n"), F.round(F.count_if(F.col("status") == "Decided") * 100.0 / F.count("*"), 2).alias("progress"))


_AN = "TIMESTAMP '2024-01-20 12:00:00'"


def _share(x: str, y: str) -> str:
    return f"CASE WHEN {y} > 0 THEN {x} / {y} ELSE 0 END"


@query("a15_anomalies", f"""WITH {D.EVENTS}, {D.ALERTS}, {D.REVIEWS}, {D.AUDIT}, {D.USERS}, e AS (SELECT count(*) FILTER (r) AS n, count(*) FILTER (r AND python_confidence < 0.4) AS low, count(*) FILTER (b) AS n0, count(*) FILTER (b AND python_confidence < 0.4) AS low0
  FROM (SELECT *, created_at >= {_AN} - INTERVAL 60 MINUTE AND created_at <= {_AN} AS r, created_at >= {_AN} - INTERVAL 7 DAY AND created_at < {_AN} - INTERVAL 60 MINUTE AS b FROM ev) WHERE python_confidence IS NOT NULL),
a AS (SELECT count(*) AS critical FROM al WHERE severity = 'Critical' AND created_at >= {_AN} - INTERVAL 60 MINUTE AND created_at <= {_AN}), q AS (SELECT count(*) AS queue FROM rv WHERE status = 'Pending Review'),
t AS (SELECT count(*) AS actions, count(*) FILTER (outcome = 'failure') AS failures, count(*) FILTER (action = 'audio_upload' AND outcome = 'failure') AS uploads, count(*) FILTER (action = 'model_failure') AS models,
  count(*) FILTER (action LIKE 'audio_duplicate_%') AS copies, count(*) FILTER (action LIKE 'login_%') AS logins FROM ad WHERE done_at >= {_AN} - INTERVAL 60 MINUTE AND done_at <= {_AN}),
u AS (SELECT count(*) FILTER (locked_until > {_AN}) AS locked FROM us),
c AS (SELECT 'failed_uploads' AS "check", uploads::DOUBLE AS observed, 5.0::DOUBLE AS threshold, uploads >= 5 AS fired FROM t UNION ALL SELECT 'model_failures', models, 1, models >= 1 FROM t
 UNION ALL SELECT 'low_confidence_spike', {_share('low', 'n')}, 0.5, n >= 10 AND {_share('low', 'n')} >= 0.5 AND {_share('low', 'n')} >= 2.0 * greatest({_share('low0', 'n0')}, 0.05) FROM e
 UNION ALL SELECT 'critical_alerts', critical, 10, critical >= 10 FROM a UNION ALL SELECT 'duplicate_files', copies, 5, copies >= 5 FROM t UNION ALL SELECT 'failed_logins', logins, 10, logins >= 10 OR locked > 0 FROM t, u
 UNION ALL SELECT 'error_rate', {_share('failures', 'actions')}, 0.2, {_share('failures', 'actions')} > 0.2 FROM t UNION ALL SELECT 'review_queue', queue, 100, queue > 100 FROM q)
SELECT "check", round(observed, 4) AS observed, threshold FROM c WHERE fired""")
def a15(spark, d):
    at = F.lit("2024-01-20 12:00:00").cast("timestamp")
    found = V.anomalies(D.sound_events(spark, d), D.alerts(spark, d), D.reviews(spark, d), D.audit(spark, d), D.users(spark, d), at)
    return found.withColumn("observed", F.round("observed", 4))


@query("a16_period_report", f"WITH {D.EVENTS} SELECT coalesce(class_name, 'all') AS class_name, coalesce(severity, 'all') AS severity, count(*) AS n FROM ev WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-15' GROUP BY GROUPING SETS ((class_name), (severity), ())")
def a16(spark, d):
    e = D.sound_events(spark, d).where("created_at >= timestamp'2024-01-05' and created_at < timestamp'2024-01-15'")
    g = e.groupingSets([["class_name"], ["severity"], []], "class_name", "severity").agg(F.count("*").alias("n"))
    return g.select(F.coalesce("class_name", F.lit("all")).alias("class_name"), F.coalesce("severity", F.lit("all")).alias("severity"), "n")


@query("a26_latency", "WITH r AS (SELECT event_type AS endpoint, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT endpoint, count(*) AS n, round(median(value), 4) AS median, max(value) FILTER (i = greatest(1, floor(n * 0.95 + 0.5))) AS p95, max(value) AS max FROM r GROUP BY 1")
def a26(spark, d):
    return X.summary(D.table(spark, d, "events").select(F.col("event_type").alias("endpoint"), "value"), "endpoint", "value").withColumn("median", F.round("median", 4))


@query("a28_table_counts", "SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'labels', count(*) FROM labels")
def a28(spark, d):
    count = lambda t: D.table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"))
    return count("events").unionByName(count("orders")).unionByName(count("labels"))


@query("o1_search_orders", f"WITH {D.EVENTS} SELECT event_id, severity FROM ev ORDER BY list_position({list(SEVERITIES)}, severity) DESC, event_id DESC LIMIT 40 OFFSET 40")
def o1(spark, d):
    return V.page(D.sound_events(spark, d), "severity", 2, 40).select("event_id", "severity")


@query("o3_recent", f"WITH {D.EVENTS} SELECT event_id, created_at FROM ev WHERE critical_class ORDER BY created_at DESC, event_id DESC LIMIT 12")
def o3(spark, d):
    return V.page(D.sound_events(spark, d).where("critical_class"), "newest", 1, 12).select("event_id", "created_at")


@query("o3_recent_events", f"WITH {D.EVENTS} SELECT event_id, severity FROM ev ORDER BY created_at DESC, event_id DESC LIMIT 8")
def o3_events(spark, d):
    return V.newest(D.sound_events(spark, d), 8).select("event_id", "severity")


@query("o3_review_items", f"WITH {D.EVENTS} SELECT event_id, class_name FROM ev WHERE review_required ORDER BY created_at DESC, event_id DESC LIMIT 5")
def o3_reviews(spark, d):
    return V.newest(D.sound_events(spark, d).where("review_required"), 5).select("event_id", "class_name")


@query("o3_latest_detection", f"""WITH {D.EVENTS}, {D.SCORES}, v AS (SELECT event_id, class_name, created_at FROM ev WHERE event_id IN (SELECT event_id FROM cp) ORDER BY created_at DESC, event_id DESC LIMIT 1),
a AS (SELECT o_orderkey // 7 AS event_id, o_orderkey AS alert_id, o_orderdate AS at_, o_orderstatus AS status FROM orders)
SELECT event_id, class_name, (SELECT string_agg(r.class_name, ',' ORDER BY rank) FROM rk r WHERE r.event_id = v.event_id AND model = 'python' AND rank <= 3) AS python, (SELECT string_agg(r.class_name, ',' ORDER BY rank) FROM rk r WHERE r.event_id = v.event_id AND model = 'gtm' AND rank <= 3) AS gtm,
(SELECT max_by(status, (at_, alert_id)) FROM a WHERE a.event_id = v.event_id) AS alert_status FROM v""")
def o3_latest(spark, d):
    scores = C.long_scores(D.score_vectors(spark, d))
    events = D.sound_events(spark, d).join(D.score_vectors(spark, d).select("event_id"), "event_id", "left_semi")
    al = D.table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 7).alias("event_id"), F.col("o_orderkey").alias("alert_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"))
    return V.latest_detection(events, scores, al).select("event_id", "class_name", "python", "gtm", "alert_status")


@query("o4_alert_queue", f"WITH {D.ALERTS} SELECT alert_id, severity FROM al WHERE status = 'New' AND severity IN ('Critical', 'High') ORDER BY created_at DESC, alert_id DESC LIMIT 20 OFFSET 20")
def o4_alerts(spark, d):
    return V.alert_queue(D.alerts(spark, d), "New", ["Critical", "High"], 2, 20).select("alert_id", "severity")


@query("o4_review_queue", f"WITH {D.REVIEWS} SELECT review_id, priority FROM rv WHERE status = 'Pending Review' ORDER BY list_position(['low', 'normal', 'high', 'critical'], priority) DESC, queued_at, review_id LIMIT 30")
def o4(spark, d):
    rank = S.rank_of(F.col("priority"), ("low", "normal", "high", "critical"))
    return D.reviews(spark, d).where("status = 'Pending Review'").orderBy(rank.desc(), "queued_at", "review_id").limit(30).select("review_id", "priority")


def _windows(spark, d):
    e = D.sound_events(spark, d)
    ok = (F.col("class_name") == F.col("gtm_class")) & S.quality_at_least(F.col("quality"), F.lit("Acceptable"))
    return e.select(F.col("created_by").alias("session_id"), "event_id", "class_name", F.col("created_at").alias("captured_at"), ok.alias("qualifies"))


@query("w3_repeat_confirmation", f"""WITH RECURSIVE {D.EVENTS}, o AS (SELECT event_id, created_by, class_name AS c, epoch(created_at) AS t, class_name = gtm_class AND quality IN ('Acceptable', 'Good') AS q,
  row_number() OVER (PARTITION BY created_by ORDER BY created_at, event_id) AS i FROM ev),
r AS (SELECT NULL::BIGINT AS event_id, created_by, 0::BIGINT AS i, NULL::VARCHAR AS class_, 0::BIGINT AS n, 0::DOUBLE AS last, false AS fired, 0::BIGINT AS consecutive, false AS newly FROM o WHERE i = 1
 UNION ALL SELECT event_id, created_by, i, CASE WHEN q THEN c END, CASE WHEN NOT q OR newly THEN 0 ELSE n1 END, t, q AND (f1 OR newly), CASE WHEN q THEN n1 ELSE 0 END, q AND newly
 FROM (SELECT *, NOT f1 AND n1 >= 2 AS newly FROM (SELECT *, CASE WHEN gap THEN 1 ELSE n0 + 1 END AS n1, f0 AND NOT gap AS f1 FROM (SELECT *, n0 > 0 AND t - last > 86400 AS gap FROM
  (SELECT o.event_id, o.created_by, o.i, o.c, o.t, o.q, r.last, CASE WHEN r.class_ = o.c THEN r.n ELSE 0 END AS n0, coalesce(r.class_ = o.c, false) AND r.fired AS f0 FROM r JOIN o ON o.created_by = r.created_by AND o.i = r.i + 1)))))
SELECT event_id, consecutive, fired AS confirmed, newly AS newly_confirmed FROM r WHERE i > 0""")
def w3(spark, d):
    out = O.confirm_repeats(_windows(spark, d), "session_id", "captured_at", "class_name", "qualifies", "event_id", 2, 86_400)
    return out.select("event_id", "consecutive", "confirmed", "newly_confirmed")


@query("w4_streak_islands", f"""WITH {D.EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY created_by ORDER BY created_at, event_id) - row_number() OVER (PARTITION BY created_by, class_name ORDER BY created_at, event_id) AS g FROM ev)
SELECT created_by AS session_id, class_name, min(created_at) AS started_at, max(created_at) AS ended_at, count(*) AS length FROM o GROUP BY created_by, class_name, g""")
def w4(spark, d):
    return O.islands(_windows(spark, d).drop("qualifies"), ["session_id"], "captured_at", "class_name", "event_id")


@query("w9_outages", """WITH o AS (SELECT user_id, event_id, ts, event_type <> 'error' AS up, row_number() OVER (PARTITION BY user_id ORDER BY ts) - row_number() OVER (PARTITION BY user_id, event_type <> 'error' ORDER BY ts) AS g FROM events)
SELECT user_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS length FROM o WHERE NOT up GROUP BY user_id, g""")
def w9(spark, d):
    p = D.table(spark, d, "events").select("user_id", "ts", (F.col("event_type") != "error").alias("up"))
    return O.outages(p, "user_id", "ts", "up")


@query("a27_uptime", "SELECT user_id, count(*) AS probes, round(avg((event_type <> 'error')::INT), 4) AS uptime FROM events GROUP BY 1")
def a27(spark, d):
    return D.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("probes"), F.round(F.avg((F.col("event_type") != "error").cast("int")), 4).alias("uptime"))


@query("w10_repeats", f"WITH {D.EVENTS} SELECT event_id, count(*) OVER (PARTITION BY class_name, source ORDER BY floor(epoch(created_at)) RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) AS repeats FROM ev")
def w10(spark, d):
    return O.repeats_within(D.sound_events(spark, d), ["class_name", "source"], "created_at").select("event_id", "repeats")


@query("w12_collapsed_alerts", """WITH g AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) > 3600 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY event_type || '|' || (user_id % 10) ORDER BY ts, event_id)),
r AS (SELECT event_type || '|' || (user_id % 10) AS dedup_key, ts, sum(n) OVER (PARTITION BY event_type || '|' || (user_id % 10) ORDER BY ts, event_id) AS run FROM g) SELECT dedup_key, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM r GROUP BY dedup_key, run""")
def w12(spark, d):
    e = D.table(spark, d, "events").withColumn("dedup_key", F.concat_ws("|", "event_type", (F.col("user_id") % 10).cast("string")))
    return O.collapse_repeats(e, "dedup_key", "ts", "event_id", 3600)


@query("w13_alert_cap", f"WITH {D.EVENTS} SELECT event_id, count(*) OVER (PARTITION BY class_name ORDER BY floor(epoch(created_at)) RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW) <= 20 AS within_cap FROM ev")
def w13(spark, d):
    return O.capped(D.sound_events(spark, d), "class_name", "created_at", 21_600).select("event_id", "within_cap")


@query("w15_rate_limit", """WITH RECURSIVE o AS (SELECT event_id, user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT event_id, user_id, i, true AS allowed, t AS newer, NULL::DOUBLE AS older FROM o WHERE i = 1
 UNION ALL SELECT event_id, user_id, i, ok, CASE WHEN ok THEN t ELSE newer END, CASE WHEN ok THEN newer ELSE older END
 FROM (SELECT o.*, r.newer, r.older, r.older IS NULL OR r.older <= o.t - 36000 AS ok FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)) SELECT event_id, allowed FROM r""")
def w15(spark, d):
    e = D.table(spark, d, "events").select("event_id", "user_id", "ts")
    return O.rate_limited(e, "user_id", "ts", "event_id", 2, 36_000).select("event_id", "allowed")


@query("w16_lockouts", """WITH RECURSIVE o AS (SELECT user_id, epoch(ts) AS t, event_type IN ('error', 'click') AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, 0::BIGINT AS i, 0 AS streak, -1::DOUBLE AS until, 0::BIGINT AS locks, 0::BIGINT AS refused FROM o WHERE i = 1
 UNION ALL SELECT user_id, i, CASE WHEN held THEN streak WHEN NOT bad OR streak = 2 THEN 0 ELSE streak + 1 END, CASE WHEN NOT held AND bad AND streak = 2 THEN t + 86400 ELSE until END,
  locks + (NOT held AND bad AND streak = 2)::BIGINT, refused + held::BIGINT FROM (SELECT o.*, r.streak, r.until, r.locks, r.refused, o.t < r.until AS held FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1))
SELECT user_id, max_by(locks, i) AS n_lockouts, max_by(refused, i) AS n_refused FROM r GROUP BY 1""")
def w16(spark, d):
    e = D.table(spark, d, "events").select("event_id", "user_id", "ts", F.col("event_type").isin("error", "click").alias("failed"))
    return O.lockouts(e, "user_id", "ts", "event_id", "failed", 3, 1440)


@query("w21_alert_lifecycle", """WITH a AS (SELECT l_orderkey AS alert_id, l_shipdate AS at_, l_suppkey, ['acknowledge', 'escalate', 'resolve', 'dismiss'][l_linenumber % 4 + 1] AS action FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY at_, l_suppkey, action) AS i FROM a), f AS (SELECT alert_id, count(*) AS n, min(i) FILTER (action IN ('resolve', 'dismiss')) AS ended, max_by(action, i) AS last FROM o GROUP BY 1)
SELECT f.alert_id, CASE coalesce(o.action, last) WHEN 'acknowledge' THEN 'Acknowledged' WHEN 'escalate' THEN 'Escalated' WHEN 'resolve' THEN 'Resolved' ELSE 'Dismissed' END AS status, coalesce(n - ended, 0) AS n_refused
FROM f LEFT JOIN o ON o.alert_id = f.alert_id AND o.i = ended""")
def w21(spark, d):
    action = F.element_at(F.array(*[F.lit(x) for x in ("acknowledge", "escalate", "resolve", "dismiss")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    a = D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("alert_id"), F.col("l_shipdate").alias("at"), F.monotonically_increasing_id().alias("i"), "l_suppkey", action.alias("action"))
    return O.replay_lifecycle(a, "alert_id", "at", "l_suppkey", "action")


@query("w22_first_decision", f"WITH {D.REVIEWS} SELECT event_id, min_by(decision, (queued_at, review_id)) FILTER (decision IS NOT NULL) AS decision, count(*) AS n FROM rv GROUP BY 1")
def w22(spark, d):
    first = F.min_by("decision", F.when(F.col("decision").isNotNull(), F.struct("queued_at", "review_id")))
    return D.reviews(spark, d).groupBy("event_id").agg(first.alias("decision"), F.count("*").alias("n"))


_ACTIONS = """ac AS (SELECT doc_id * 3 + n AS action_id, doc_id AS review_id, make_timestamp((1704067200 + (doc_id * 7 + n * 5) % 11)::BIGINT * 1000000) AS at_, ['confirm', 'override', 'reject', 'later'][(doc_id + n) % 4 + 1] AS decision,
  CASE WHEN (doc_id + n) % 3 > 0 THEN 'seen' ELSE ' ' END AS comments, ['en', 'de', 'xx', ''][(doc_id // 2 + n) % 4 + 1] AS final_class, CASE WHEN (doc_id + n) % 7 = 0 THEN 'Huge' END AS final_severity FROM labels, (SELECT unnest(range(3)) AS n))"""
_APPLIED = f"""{_ACTIONS}, fa AS (SELECT ac.*, quality = 1 AS done, CASE WHEN decision = 'later' THEN 'unknown_decision' WHEN decision IN ('override', 'reject') AND trim(comments) = '' THEN 'comments_required'
  WHEN decision = 'override' AND final_class = '' THEN 'final_class_required' WHEN decision = 'override' AND final_class NOT IN ('en', 'de', 'fr', 'es', 'it') THEN 'unknown_class' WHEN final_severity IS NOT NULL THEN 'unknown_severity' END AS fault FROM ac JOIN labels ON doc_id = review_id),
ap AS (SELECT *, CASE WHEN done THEN 'already_decided' WHEN nth_good > 1 OR (nth_good = 1 AND fault IS NOT NULL) THEN 'already_decided' WHEN fault IS NOT NULL THEN fault END AS error
  FROM (SELECT *, count(*) FILTER (fault IS NULL) OVER (PARTITION BY review_id ORDER BY at_, action_id) AS nth_good FROM fa))"""


def _applied(spark, d):
    pick = lambda names, at: F.element_at(F.array(*[F.lit(x) for x in names]), (at % len(names) + 1).cast("int"))
    a = D.table(spark, d, "labels").select(F.col("doc_id").alias("review_id"), F.explode(F.array(*map(F.lit, range(3)))).alias("n"))
    n = F.col("review_id") + F.col("n")
    a = a.select(
        (F.col("review_id") * 3 + F.col("n")).alias("action_id"), "review_id", F.timestamp_seconds(1704067200 + (F.col("review_id") * 7 + F.col("n") * 5) % 11).alias("at"), pick(("confirm", "override", "reject", "later"), n).alias("decision"),
        F.when(n % 3 > 0, "seen").otherwise(" ").alias("comments"), pick(("en", "de", "xx", ""), F.floor(F.col("review_id") / 2) + F.col("n")).alias("final_class"), F.when(n % 7 == 0, "Huge").alias("final_severity"), F.lit(False).alias("false_alarm"),
    )
    r = D.reviews(spark, d).select("review_id", "event_id", "original_class", F.when(F.col("status") == "Decided", "Reviewed").otherwise(F.col("status")).alias("status"))
    return r, Y.apply_decisions(a, r, classes=("en", "de", "fr", "es", "it"))


@query("w22_requests", f"WITH {_APPLIED} SELECT action_id, error FROM ap")
def w22_requests(spark, d):
    return _applied(spark, d)[1].select("action_id", "error")


@query("w22_review_decisions", f"""WITH {D.REVIEWS}, {_APPLIED} SELECT rv.review_id, CASE WHEN rv.status = 'Decided' OR a.decision IS NOT NULL THEN 'Reviewed' ELSE rv.status END AS status, a.decision,
  CASE a.decision WHEN 'confirm' THEN original_class ELSE nullif(a.final_class, '') END AS final_class, a.decision = 'reject' AS false_alarm FROM rv LEFT JOIN (SELECT * FROM ap WHERE error IS NULL) a USING (review_id)""")
def w22_decided(spark, d):
    return Y.decided(*_applied(spark, d)).select("review_id", "status", "decision", "final_class", "false_alarm")


@query("w22_cleared_events", f"""WITH {D.EVENTS}, {D.REVIEWS}, {_APPLIED} SELECT event_id, review_required AND event_id NOT IN (SELECT event_id FROM rv LEFT JOIN ap ON ap.review_id = rv.review_id AND error IS NULL WHERE rv.status = 'Decided' OR ap.review_id IS NOT NULL) AS requires_manual_review FROM ev""")
def w22_cleared(spark, d):
    e = D.sound_events(spark, d).select("event_id", F.col("review_required").alias("requires_manual_review"))
    return Y.cleared(e, Y.decided(*_applied(spark, d)))


@query("j17_retention_plan", f"""WITH {D.EVENTS}, {D.ALERTS}, {D.REVIEWS}, hold AS (SELECT event_id FROM rv WHERE status = 'Pending Review' UNION SELECT alert_id FROM al WHERE status IN ('New', 'Acknowledged')),
e AS (SELECT event_id, event_id // 2 AS audio_key, severity, created_at FROM ev), k AS (SELECT audio_key, max(CASE WHEN severity = 'Critical' THEN 730 ELSE 180 END) AS keep_days FROM e GROUP BY 1),
f AS (SELECT audio_key, min(created_at) AS created_at, bool_or(event_id % 101 = 0) AS flagged FROM e GROUP BY 1)
SELECT audio_key, created_at, keep_days FROM f JOIN k USING (audio_key) WHERE NOT flagged AND audio_key NOT IN (SELECT audio_key FROM e SEMI JOIN hold USING (event_id))
  AND CAST(created_at AS DATE) + keep_days::INT < DATE '2024-07-20' ORDER BY created_at, audio_key LIMIT 500""")
def j17(spark, d):
    e = D.sound_events(spark, d).select("event_id", F.floor(F.col("event_id") / 2).alias("audio_key"), "severity", "created_at")
    files = e.groupBy("audio_key").agg(F.min("created_at").alias("created_at"), F.max(F.col("event_id") % 101 == 0).alias("flagged"))
    al = D.alerts(spark, d).select(F.col("alert_id").alias("event_id"), "status")
    return V.retention_plan(files, e, al, D.reviews(spark, d), F.lit("2024-07-20").cast("timestamp")).select("audio_key", "created_at", "keep_days")


@query("w20_purge_batches", f"""WITH {D.EVENTS}, {D.FILES}, {D.REVIEWS}, r AS (SELECT 'event_records' AS artifact, event_id AS id, created_at, severity, event_id IN (SELECT event_id FROM rv WHERE status = 'Pending Review') AS held FROM ev
  UNION ALL SELECT CASE WHEN source = 'microphone' THEN 'microphone_session_audio' ELSE 'audio' END, event_id, created_at, severity, event_id % 10 = 3 FROM ev UNION ALL SELECT 'model_version', event_id, created_at, severity, false FROM ev),
k AS (SELECT *, CASE artifact WHEN 'event_records' THEN CASE severity WHEN 'High' THEN 1095 WHEN 'Critical' THEN 1825 ELSE 730 END WHEN 'audio' THEN CASE severity WHEN 'Critical' THEN 730 ELSE 180 END WHEN 'microphone_session_audio' THEN 7 END AS keep_days FROM r WHERE NOT held),
p AS (SELECT *, row_number() OVER (PARTITION BY artifact ORDER BY created_at, id) AS place FROM k WHERE CAST(created_at AS DATE) + keep_days < DATE '2026-01-20') SELECT artifact, id, created_at, keep_days FROM p WHERE place <= 200""")
def w20(spark, d):
    e = D.sound_events(spark, d)
    pending = D.reviews(spark, d).where("status = 'Pending Review'").select("event_id").distinct().withColumn("held", F.lit(True))
    events = e.join(pending, "event_id", "left").select(F.lit("event_records").alias("artifact"), F.col("event_id").alias("id"), "created_at", "severity", F.coalesce("held", F.lit(False)).alias("held"))
    kind = F.when(F.col("source") == "microphone", "microphone_session_audio").otherwise("audio")
    audio = e.select(kind.alias("artifact"), F.col("event_id").alias("id"), "created_at", "severity", (F.col("event_id") % 10 == 3).alias("held"))
    models = e.select(F.lit("model_version").alias("artifact"), F.col("event_id").alias("id"), "created_at", "severity", F.lit(False).alias("held"))
    return V.due_for_purge(events.unionByName(audio).unionByName(models), F.lit("2026-01-20").cast("timestamp"), 200)


@query("o2_page_totals", f"WITH {D.EVENTS}, m AS (SELECT * FROM ev WHERE critical_class) SELECT event_id, (SELECT count(*) FROM m) AS total, (SELECT ceil(count(*) / 25)::BIGINT FROM m) AS pages FROM m ORDER BY created_at DESC, event_id DESC LIMIT 25 OFFSET 50")
def o2(spark, d):
    return V.paged(D.sound_events(spark, d).where("critical_class"), "newest", 3, 25).select("event_id", "total", "pages")


@query("x5_reason_texts", f"WITH {D.EVENTS} SELECT event_id, 'Heard ' || class_name || ' at ' || printf('%.2f', python_confidence) || ' ({{unknown}})' AS reason FROM ev")
def x5(spark, d):
    text = V.filled("Heard {class_name} at {python_confidence:.2f} ({unknown})", ["class_name", "python_confidence"])
    return D.sound_events(spark, d).select("event_id", text.alias("reason"))


@query("x12_severity_ranks", f"WITH {D.EVENTS} SELECT event_id, list_position({list(SEVERITIES)}, severity) - 1 AS rank FROM ev")
def x12(spark, d):
    return D.sound_events(spark, d).select("event_id", S.severity_rank(F.col("severity")).cast("long").alias("rank"))


@query("x16_dedup_keys", "SELECT event_id, event_type || '|' || user_id || '|' AS dedup_key FROM events")
def x16(spark, d):
    e = D.table(spark, d, "events")
    return e.select("event_id", V.dedup_key(F.concat(F.lit("  "), F.upper("event_type")), F.col("user_id"), F.lit(None).cast("string")).alias("dedup_key"))


@query("x17_snapshots", f"WITH {D.EVENTS} SELECT event_id, class_name, severity, quality FROM ev")
def x17(spark, d):
    e = D.sound_events(spark, d).select("event_id", "class_name", "severity", "quality")
    return V.restored(V.snapshot(e, ["class_name", "severity", "quality"]), "class_name string, severity string, quality string")


@query("x18_time_budget", "SELECT event_id, round(value * 10 - 500, 3) <= 0 AS within_budget, CASE WHEN round(value * 10 - 500, 3) > 0 THEN round(value * 10 - 500, 3) END AS budget_overrun_ms FROM events")
def x18(spark, d):
    e = D.table(spark, d, "events").select("event_id", (F.col("value") * 10).alias("elapsed_ms"), F.lit(0.5).alias("budget_sec"))
    return V.within_budget(e, "elapsed_ms", "budget_sec").select("event_id", "within_budget", "budget_overrun_ms")
