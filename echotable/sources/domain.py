"""Sound-event tables derived from the star schema, with the same rules as DuckDB SQL.

Each function reads one table of a folder and derives the domain columns; the SQL text beside it is
the same derivation, for oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotable.functions import scores as S
from echotable.functions.config import CLASSES

#: The moment that look-back queries are asked at.
NOW = "2024-01-31 00:00:00"
CRITICAL_TYPES = ("error", "purchase")
_NEXT = {"click": "view", "view": "signup", "signup": "purchase", "purchase": "error", "error": "click"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp")


def sound_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per analysed event."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    other = F.create_map(*[F.lit(x) for pair in _NEXT.items() for x in pair])[F.col("event_type")]
    rows = e.select(
        "event_id", F.col("event_type").alias("class_name"), F.col("ts").alias("created_at"), F.col("user_id").alias("created_by"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("python_confidence"),
        F.when(F.col("event_id") % 4 == 0, other).otherwise(F.col("event_type")).alias("gtm_class"),
        (F.col("event_id") * 37 % 100 / F.lit(100.0)).alias("gtm_confidence"),
        F.when(k % 10 == 0, "Unusable").when(k % 10 <= 2, "Poor").when(k % 10 <= 5, "Acceptable").otherwise("Good").alias("quality"),
        F.element_at(F.array(*[F.lit(s) for s in ("Informational", "Low", "Medium", "High", "Critical")]), (F.floor(F.col("event_id") / 3) % 5 + 1).cast("int")).alias("severity"),
        F.when(F.col("event_id") % 5 == 0, "microphone").otherwise("upload").alias("source"),
    )
    status = S.consistency_status(F.col("class_name"), F.col("python_confidence"), F.col("gtm_class"), F.col("gtm_confidence"))
    rows = rows.withColumn("consistency", status).withColumn("difference", F.abs(F.col("python_confidence") - F.col("gtm_confidence")))
    return rows.withColumn("review_required", F.col("consistency").isin("Model Disagreement", "Uncertain Result")).withColumn("critical_class", F.col("class_name").isin(*CRITICAL_TYPES))


EVENTS = """ev0 AS (
  SELECT event_id, event_type AS class_name, ts AS created_at, user_id AS created_by,
         least(1.0::DOUBLE, value / 100) AS python_confidence,
         CASE WHEN event_id % 4 = 0 THEN CASE event_type WHEN 'click' THEN 'view' WHEN 'view' THEN 'signup'
              WHEN 'signup' THEN 'purchase' WHEN 'purchase' THEN 'error' ELSE 'click' END ELSE event_type END AS gtm_class,
         (event_id * 37 % 100) / 100.0::DOUBLE AS gtm_confidence,
         CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS k10,
         ['Informational', 'Low', 'Medium', 'High', 'Critical'][(event_id // 3) % 5 + 1] AS severity,
         CASE WHEN event_id % 5 = 0 THEN 'microphone' ELSE 'upload' END AS source
  FROM events
), ev1 AS (
  SELECT * EXCLUDE (k10), abs(python_confidence - gtm_confidence) AS difference,
         CASE WHEN k10 = 0 THEN 'Unusable' WHEN k10 <= 2 THEN 'Poor' WHEN k10 <= 5 THEN 'Acceptable' ELSE 'Good' END AS quality,
         CASE WHEN python_confidence < 0.4 AND gtm_confidence < 0.4 THEN 'Uncertain Result'
              WHEN class_name <> gtm_class THEN 'Model Disagreement'
              WHEN python_confidence < 0.4 THEN 'Uncertain Result'
              WHEN gtm_confidence < 0.4 THEN 'Weak Match'
              WHEN abs(python_confidence - gtm_confidence) <= 0.05 THEN 'Strong Match'
              WHEN abs(python_confidence - gtm_confidence) <= 0.15 OR least(python_confidence, gtm_confidence) >= 0.5 THEN 'Acceptable Match'
              ELSE 'Weak Match' END AS consistency
  FROM ev0
), ev AS (
  SELECT *, consistency IN ('Model Disagreement', 'Uncertain Result') AS review_required, class_name IN ('error', 'purchase') AS critical_class
  FROM ev1
)"""


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert per order: acknowledged at the first shipment, resolved at the last."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("acknowledged_at"), F.max("l_shipdate").alias("resolved_at"), F.max(F.col("l_returnflag") == "R").alias("false_alarm")
    )
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    severity = F.create_map(*[F.lit(x) for x in ("1-URGENT", "Critical", "2-HIGH", "High", "3-MEDIUM", "Medium", "4-NOT SPECIFIED", "Informational", "5-LOW", "Low")])
    status = F.create_map(*[F.lit(x) for x in ("O", "New", "P", "Acknowledged", "F", "Resolved")])
    return o.select(
        F.col("o_orderkey").alias("alert_id"), F.col("o_custkey").alias("source_key"), severity[F.col("o_orderpriority")].alias("severity"),
        status[F.col("o_orderstatus")].alias("status"), F.col("o_orderdate").alias("created_at"), "acknowledged_at", "resolved_at",
        F.coalesce("false_alarm", F.lit(False)).alias("false_alarm"),
    )


ALERTS = """al AS (
  SELECT o_orderkey AS alert_id, o_custkey AS source_key,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium'
              WHEN '4-NOT SPECIFIED' THEN 'Informational' WHEN '5-LOW' THEN 'Low' END AS severity,
         CASE o_orderstatus WHEN 'O' THEN 'New' WHEN 'P' THEN 'Acknowledged' WHEN 'F' THEN 'Resolved' END AS status,
         o_orderdate AS created_at, min(l_shipdate) AS acknowledged_at, max(l_shipdate) AS resolved_at,
         coalesce(bool_or(l_returnflag = 'R'), false) AS false_alarm
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL
)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per label: quality 1 is decided, a toxic one overridden."""
    r = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    return r.select(
        F.col("doc_id").alias("review_id"), (F.col("doc_id") % 700).alias("event_id"), F.col("source").alias("reviewer"), F.col("lang").alias("original_class"),
        F.when(F.col("quality") == 1, "Decided").otherwise("Pending Review").alias("status"),
        F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, "override").otherwise("confirm")).alias("decision"),
        F.when(F.col("doc_id") % 9 == 0, "critical").when(F.col("doc_id") % 3 == 0, "high").otherwise("normal").alias("priority"),
        F.expr(f"timestamp'{NOW}' - make_dt_interval(0, 0, cast(doc_id % 180 as int), 0)").alias("queued_at"),
    )


REVIEWS = f"""rv AS (
  SELECT doc_id AS review_id, doc_id % 700 AS event_id, source AS reviewer, lang AS original_class,
         CASE WHEN quality = 1 THEN 'Decided' ELSE 'Pending Review' END AS status,
         CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN 'override' ELSE 'confirm' END END AS decision,
         CASE WHEN doc_id % 9 = 0 THEN 'critical' WHEN doc_id % 3 = 0 THEN 'high' ELSE 'normal' END AS priority,
         TIMESTAMP '{NOW}' - to_minutes(doc_id % 180) AS queued_at
  FROM labels JOIN documents USING (doc_id)
)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clip per document; a later copy of a text is augmented from the first."""
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("clip"), F.col("lang").alias("class_label"), F.col("source").alias("source_group"), F.sha2("text", 256).alias("sha256"),
        (F.col("n_chars") / 100).alias("duration_sec"), F.element_at(F.array(*[F.lit(x) for x in ("CC0", "CC-BY", "CC-BY-NC", "")]), (F.col("doc_id") % 4 + 1).cast("int")).alias("licence"),
        F.element_at(F.array(*[F.lit(x) for x in ("indoor", "outdoor", "street")]), (F.col("doc_id") % 3 + 1).cast("int")).alias("environment"),
        F.concat(F.lit("author"), (F.col("doc_id") % 17).cast("string")).alias("author"),
    )
    first = d.groupBy("sha256").agg(F.min("clip").alias("parent"))
    rows = d.join(first, "sha256")
    audio_id = lambda c: F.format_string("CLP-%06d", F.col(c))
    original = F.col("clip") == F.col("parent")
    return rows.select(
        audio_id("clip").alias("audio_id"), "clip", "class_label", "source_group", "sha256", "duration_sec", "licence", "environment", "author",
        F.when(original, "original").otherwise("augmented").alias("role"), F.when(~original, audio_id("parent")).alias("parent_audio_id"),
    )


MANIFEST = """mf0 AS (
  SELECT doc_id AS clip, lang AS class_label, source AS source_group, sha256(text) AS sha256, n_chars / 100.0::DOUBLE AS duration_sec,
         ['CC0', 'CC-BY', 'CC-BY-NC', ''][doc_id % 4 + 1] AS licence, ['indoor', 'outdoor', 'street'][doc_id % 3 + 1] AS environment,
         'author' || (doc_id % 17) AS author, min(doc_id) OVER (PARTITION BY sha256(text)) AS parent
  FROM documents
), mf AS (
  SELECT 'CLP-' || lpad(clip::VARCHAR, 6, '0') AS audio_id, * EXCLUDE (parent),
         CASE WHEN clip = parent THEN 'original' ELSE 'augmented' END AS role,
         CASE WHEN clip <> parent THEN 'CLP-' || lpad(parent::VARCHAR, 6, '0') END AS parent_audio_id
  FROM mf0
)"""


def audio_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored file per document."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("audio_key"), F.format_string("SST-2024-01-%02d-%06d", F.col("doc_id") % 28 + 1, F.col("doc_id") % 1000000).alias("audio_id"),
        F.concat_ws("", F.lit("Clip_"), "lang", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("filename"), F.col("source").alias("username"), F.col("n_chars").alias("size_bytes"),
    )


FILES = """au AS (
  SELECT doc_id AS audio_key, 'SST-2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || '-' || lpad((doc_id % 1000000)::VARCHAR, 6, '0') AS audio_id,
         concat('Clip_', lang, '-', doc_id, '.wav') AS filename, source AS username, n_chars AS size_bytes
  FROM documents
)"""


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One audited action per event."""
    names = ("audio_upload", "login_failure", "audio_duplicate_rejected", "export", "model_failure")
    kinds = F.create_map(*[F.lit(x) for pair in zip(("click", "view", "signup", "purchase", "error"), names) for x in pair])
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("at"), kinds[F.col("event_type")].alias("action"), F.when(F.col("event_id") % 4 == 0, "failure").otherwise("success").alias("outcome"))


AUDIT = """ad AS (
  SELECT event_id, user_id, ts AS done_at, CASE event_type WHEN 'click' THEN 'audio_upload' WHEN 'view' THEN 'login_failure' WHEN 'signup' THEN 'audio_duplicate_rejected'
         WHEN 'purchase' THEN 'export' WHEN 'error' THEN 'model_failure' END AS action, CASE WHEN event_id % 4 = 0 THEN 'failure' ELSE 'success' END AS outcome FROM events
)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One account per customer; those in debt are locked for a day from the moment of asking."""
    lock = F.when(F.col("c_acctbal") < 0, now() + F.make_interval(days=F.lit(1)))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), lock.alias("locked_until"))


USERS = f"""us AS (SELECT c_custkey AS user_id, CASE WHEN c_acctbal < 0 THEN TIMESTAMP '{NOW}' + INTERVAL 1 DAY END AS locked_until FROM customer)"""


def score_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' score vectors and the true class of each clip: ten elements each of an embedding."""
    def part(lo: int) -> F.Column:
        piece = F.transform(F.slice("embedding", lo, 10), lambda x: x.cast("double"))
        power = lambda y: y * y * y * y * y * y
        return S.normalise(S.let(piece, lambda p: S.let(F.array_min(p), lambda low: F.transform(p, lambda x: power(x - low)))))

    v = table(spark, sf_dir, "embeddings").where("size(embedding) >= 20")
    truth = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("label").cast("int") + 1)
    return v.select(F.col("vec_id").alias("event_id"), truth.alias("actual"), part(1).alias("scores_a"), part(11).alias("scores_b"))


_CLS = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"
SCORES = f"""sc0 AS (
  SELECT vec_id AS event_id, {_CLS}[label + 1] AS actual,
         list_transform(embedding[1:10], lambda x: x::DOUBLE - list_min(embedding[1:10])::DOUBLE) AS a,
         list_transform(embedding[11:20], lambda x: x::DOUBLE - list_min(embedding[11:20])::DOUBLE) AS b
  FROM embeddings WHERE len(embedding) >= 20
), sc1 AS (
  SELECT event_id, actual, list_transform(a, lambda x: x * x * x * x * x * x) AS a, list_transform(b, lambda x: x * x * x * x * x * x) AS b FROM sc0
), sc AS (
  SELECT event_id, actual, list_transform(a, lambda x: x / list_sum(a)) AS a, list_transform(b, lambda x: x / list_sum(b)) AS b FROM sc1
), lg AS (
  SELECT event_id, actual, 'python' AS model, unnest({_CLS}) AS class_name, unnest(a) AS confidence FROM sc
  UNION ALL SELECT event_id, actual, 'gtm', unnest({_CLS}), unnest(b) FROM sc
), rk AS (
  SELECT *, row_number() OVER (PARTITION BY event_id, model ORDER BY confidence DESC, class_name) AS rank FROM lg
), pr AS (
  SELECT event_id, any_value(actual) AS actual,
         any_value(class_name) FILTER (model = 'python' AND rank = 1) AS python_class, any_value(confidence) FILTER (model = 'python' AND rank = 1) AS python_confidence,
         any_value(class_name) FILTER (model = 'gtm' AND rank = 1) AS gtm_class, any_value(confidence) FILTER (model = 'gtm' AND rank = 1) AS gtm_confidence,
         any_value(confidence) FILTER (model = 'python' AND rank = 1) - any_value(confidence) FILTER (model = 'python' AND rank = 2) AS margin,
         any_value(class_name) FILTER (model = 'python' AND rank = 2) AS second_class, any_value(confidence) FILTER (model = 'python' AND rank = 2) AS second_confidence
  FROM rk GROUP BY event_id
), cp AS (
  SELECT *, python_class = gtm_class AS agree, abs(python_confidence - gtm_confidence) AS difference,
         CASE WHEN python_confidence < 0.4 AND gtm_confidence < 0.4 THEN 'Uncertain Result'
              WHEN python_class <> gtm_class THEN 'Model Disagreement'
              WHEN python_confidence < 0.4 THEN 'Uncertain Result'
              WHEN gtm_confidence < 0.4 THEN 'Weak Match'
              WHEN abs(python_confidence - gtm_confidence) <= 0.05 THEN 'Strong Match'
              WHEN abs(python_confidence - gtm_confidence) <= 0.15 OR least(python_confidence, gtm_confidence) >= 0.5 THEN 'Acceptable Match'
              ELSE 'Weak Match' END AS status,
         python_class = gtm_class AND round(second_confidence, 6) >= 0.25 AS overlapping,
         ['Unusable', 'Poor', 'Acceptable', 'Good'][event_id % 4 + 1] AS quality
  FROM pr
)"""
