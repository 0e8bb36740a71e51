"""Queries that write what they derive from a table to the shared folder, and read it back through the library's readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from echotable.functions import scores as S
from echotable.functions.config import EXPORT_COLUMNS, RETENTION_BY_SEVERITY, RETENTION_DAYS
from echotable.operators import audio as W
from echotable.operators import compare as C
from echotable.operators import ordered as O
from echotable.operators import search as R
from echotable.operators import serving as V
from echotable.operators import split as P
from echotable.plans import compare, dataset, live
from echotable.sources import domain as D
from echotable.sources import files
from echotable.sources.scratch import fresh_folder

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("src1_manifest", f"WITH {D.MANIFEST} SELECT audio_id, audio_id || '.wav' AS filename, class_label, nullif(licence, '') AS licence, sha256, CASE WHEN clip % 5 = 0 THEN '''=' || clip END AS note FROM mf")
def src1(spark, d):
    """A manifest written as CSV with an extra column, blanks and cells that look like formulas, loaded again."""
    at = fresh_folder(spark, "manifest")
    m = D.manifest(spark, d).select("audio_id", F.concat("audio_id", F.lit(".wav")).alias("filename"), "class_label", "licence", "sha256", F.when(F.col("clip") % 5 == 0, F.concat(F.lit("="), F.col("clip").cast("string"))).alias("note"))
    files.export_csv(m, at, m.columns, limit=None)
    return files.load_manifest(spark, at)


def _assigned(spark, d):
    return P.split(dataset._split_rows(spark, d, F.floor(F.col("clip") / 3)))


@query("src2_split_documents", f"{dataset._QUOTA_SPLIT} SELECT audio_id, split, class_label, role, \"group\" FROM w")
def src2(spark, d):
    at = fresh_folder(spark, "documents")
    files.write_split_documents(_assigned(spark, d), at)
    return files.load_split(spark, at, multi_line=False)


@query("src3_logs", "SELECT event_id, event_type, value, json_extract_string(props, '$.k')::INT AS k FROM events")
def src3(spark, d):
    at = fresh_folder(spark, "log")
    D.table(spark, d, "events").select("event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k")).write.json(at)
    return files.load_log(spark, at, "event_id long, event_type string, value double, k int")


@query("src4_audio_parquet", "SELECT CASE WHEN doc_id % 3 > 0 THEN 'clip' || doc_id || '.wav' ELSE 'row' || doc_id END AS filename, sha256(text) AS content, lang AS label FROM documents")
def src4(spark, d):
    """Rows with an embedded audio struct, of which some have no path of their own."""
    at, name = fresh_folder(spark, "audio"), lambda kind, end="": F.concat(F.lit(kind), F.col("doc_id").cast("string"), F.lit(end))
    path = F.when(F.col("doc_id") % 3 > 0, name("clip", ".wav"))
    D.table(spark, d, "documents").select(F.struct(path.alias("path"), F.encode("text", "utf-8").alias("bytes")).alias("audio"), name("row").alias("filename"), F.col("lang").alias("category")).write.parquet(at)
    return files.load_audio_parquet(spark, at, "category").select("filename", F.sha2("content", 256).alias("content"), "label")


@query("snk1_export", f"WITH {D.EVENTS} SELECT event_id::VARCHAR AS event_id, class_name AS predicted_class, severity, consistency AS consistency_status, quality AS quality_verdict, CASE WHEN review_required THEN 'true' ELSE 'false' END AS requires_manual_review, NULL::VARCHAR AS location, {len(EXPORT_COLUMNS)} AS columns FROM ev")
def snk1(spark, d):
    """The event export with its fixed columns; those that the events lack are blank."""
    at = fresh_folder(spark, "export")
    e = D.sound_events(spark, d).select("event_id", "created_at", "created_by", "source", F.col("class_name").alias("predicted_class"), "severity", F.col("consistency").alias("consistency_status"), F.col("quality").alias("quality_verdict"), F.col("review_required").alias("requires_manual_review"))
    files.export_events(e, at, limit=None)
    back = spark.read.csv(at, header=True)
    return back.select("event_id", "predicted_class", "severity", "consistency_status", "quality_verdict", "requires_manual_review", "location", F.lit(len(back.columns)).alias("columns"))


@query("snk2_id_lists", f"{dataset._QUOTA_SPLIT} SELECT w.split, w.audio_id, m.licence FROM w JOIN m USING (audio_id)")
def snk2(spark, d):
    """The manifest by partition and the partitions' id lists, joined again."""
    at = fresh_folder(spark, "splits")
    files.write_splits(D.manifest(spark, d), _assigned(spark, d), at)
    stored = spark.read.parquet(f"{at}/manifest").select("audio_id", "licence", F.col("dataset_split").alias("split"))
    return files.load_split_ids(spark, at).join(stored, ["audio_id", "split"]).select("split", "audio_id", "licence")


@query("snk3_report", f"WITH {D.SCORES} SELECT event_id::VARCHAR AS event_id, status, agree::VARCHAR AS agree, count(*) OVER () AS clips, count(*) FILTER (agree) OVER () AS agreeing FROM cp")
def snk3(spark, d):
    """A comparison's rows as CSV and its one-row summary as JSON."""
    at = fresh_folder(spark, "report")
    rows = compare._compared(spark, d).select("event_id", "status", "agree")
    files.write_report(rows, rows.agg(F.count("*").alias("clips"), F.count_if("agree").alias("agreeing")), at)
    summary = spark.read.schema("clips long, agreeing long").json(f"{at}/summary")
    return spark.read.csv(f"{at}/rows", header=True).crossJoin(F.broadcast(summary))  # one row


_SOUGHT = ("reference number", "Anthe", "é", "no such text anywhere", "src1")


@query("f4_indexed_text", " UNION ALL ".join(f"SELECT '{t}' AS sought, doc_id FROM documents WHERE text ILIKE '%{t}%' OR source ILIKE '%{t}%' OR lang ILIKE '%{t}%'" for t in _SOUGHT))
def f4_indexed(spark, d):
    """Free texts in three columns, found through one trigram index."""
    at, columns = fresh_folder(spark, "trigrams"), ["text", "source", "lang"]
    rows = D.table(spark, d, "documents").select("doc_id", *columns)
    R.build(rows, "doc_id", columns, at)
    out = None
    for t in _SOUGHT:
        found = R.containing(rows, "doc_id", columns, t, at).select(F.lit(t).alias("sought"), "doc_id")
        out = found if out is None else out.unionByName(found)
    return out


@query("j5_effective_rules", f"WITH {D.SCORES}, ru AS ({compare._RULES_SQL}) SELECT event_id, rule_severity AS severity, min_confidence::DOUBLE AS min_confidence, min_quality FROM cp JOIN ru ON python_class = rule_class")
def j5(spark, d):
    j = C.with_rule(compare._compared(spark, d), C.rules_frame(spark))
    return j.select("event_id", "rule.severity", "rule.min_confidence", "rule.min_quality")


@query("u3_split_ids", f"{dataset._QUOTA_SPLIT}, a AS (SELECT audio_id FROM mf WHERE licence IN ('CC0', 'CC-BY')), b AS (SELECT audio_id FROM w WHERE split = 'train') SELECT audio_id, 'not in training' AS state FROM a WHERE audio_id NOT IN (FROM b) UNION ALL SELECT audio_id, 'not allowed' FROM b WHERE audio_id NOT IN (FROM a)")
def u3(spark, d):
    """Clips of an allowed licence against the training partition: ids that only one side has."""
    a = D.manifest(spark, d).where(F.col("licence").isin("CC0", "CC-BY")).select("audio_id")
    b = _assigned(spark, d).where("split = 'train'").select("audio_id")
    return a.exceptAll(b).withColumn("state", F.lit("not in training")).unionByName(b.exceptAll(a).withColumn("state", F.lit("not allowed")))


@query("w11_sustained_seconds", """WITH g AS (SELECT *, coalesce(event_type <> lag(event_type) OVER w, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g) SELECT event_id, round(epoch(ts) - epoch(min(ts) OVER (PARTITION BY user_id, run)), 3) AS sustained_seconds FROM r""")
def w11(spark, d):
    e = D.table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return O.sustained(e, "user_id", "ts", "event_type", "event_id").select("event_id", F.round("sustained_seconds", 3).alias("sustained_seconds"))


@query("x13_utc", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS zulu, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS offset_, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS naive FROM events")
def x13(spark, d):
    """One moment written with Z, with another zone's offset and without a zone, read as UTC each time."""
    ts = F.col("ts").cast("timestamp")
    text = lambda moment, end: F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(end))
    later = ts + F.make_dt_interval(hours=F.lit(2))
    return D.table(spark, d, "events").select("event_id", *[S.iso_utc(S.from_iso(t)).alias(c) for c, t in (("zulu", text(ts, "Z")), ("offset_", text(later, "+02:00")), ("naive", text(ts, "")))])


_KEPT = ", ".join(f"('{a}', {days if days is not None else 'NULL'}::INT)" for a, days in RETENTION_DAYS.items())
_LONGER = ", ".join(f"('{a}', '{s}', {days})" for s, by in RETENTION_BY_SEVERITY.items() for a, days in by.items())


@query("x14_retention_days", f"""WITH {D.EVENTS}, k(artifact, days) AS (VALUES {_KEPT}), l(artifact, severity, days) AS (VALUES {_LONGER})
SELECT event_id, k.artifact, CASE WHEN k.days IS NOT NULL THEN greatest(k.days, coalesce(l.days, 0)) END AS keep_days FROM ev CROSS JOIN k LEFT JOIN l ON l.artifact = k.artifact AND l.severity = ev.severity""")
def x14(spark, d):
    days = F.array(*[F.struct(F.lit(a).alias("artifact"), V.retention_days(a, F.col("severity")).alias("keep_days")) for a in RETENTION_DAYS])
    return D.sound_events(spark, d).select("event_id", F.explode(days).alias("x")).select("event_id", "x.*")


@query("v1_decoded", "SELECT 2 * vec_id + k AS clip_id, 16000::BIGINT AS rate, 1::BIGINT AS channels, 16::BIGINT AS bits, round((2.0 - 0.005 * k)::DOUBLE, 6) AS duration_sec, 32000 - 80 * k AS n FROM embeddings, (SELECT unnest(range(2)) AS k) WHERE len(embedding) = 64")
def v1(spark, d):
    """Recordings as WAV bytes, decoded again."""
    wav = W.encode_wav(live._recordings(spark, d)).select(F.col("clip_id").cast("string").alias("path"), "content")
    out = W.decode_wav(wav).where("error is null")
    return out.select(F.col("path").cast("long").alias("clip_id"), "rate", "channels", "bits", F.round("duration_sec", 6).alias("duration_sec"), F.size("samples").alias("n"))
