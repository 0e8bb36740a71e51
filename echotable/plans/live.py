"""Queries on streams, waveforms and models; streams run over what a table holds and are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from echotable.operators import audio as W
from echotable.operators import compare as C
from echotable.operators import duplicates as U
from echotable.operators import training as T
from echotable.sources import analyses as A
from echotable.sources import domain as D
from echotable.sources.commits import TableLog
from echotable.sources.scratch import Tables, fresh_folder
from echotable.streaming import live as L
from echotable.streaming import sessions as N

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _folder(spark) -> str:
    return fresh_folder(spark, "stream")


def _events(spark, d):
    return L.read(spark, f"{d}/event[s].parquet", D.table(spark, d, "events"))


@query("t1_ingest_once", "SELECT event_id, user_id, event_type FROM events")
def t1(spark, d):
    twice = _events(spark, d).unionByName(_events(spark, d))  # every key arrives two times
    return L.drain(L.ingest(twice, ["event_id"], "ts").select("event_id", "user_id", "event_type"), _folder(spark))


@query("t2_enriched_windows", "SELECT event_type, CASE event_type WHEN 'error' THEN 'Critical' WHEN 'purchase' THEN 'High' END AS rule_severity, count(*) AS n FROM events GROUP BY 1, 2")
def t2(spark, d):
    rules = spark.createDataFrame([("error", "Critical"), ("purchase", "High")], "rule_class string, rule_severity string")
    e = L.enrich(_events(spark, d), rules, "event_type").groupBy("event_type", "rule_severity").agg(F.count("*").alias("n"))
    return L.drain(e, _folder(spark), "complete")


@query("t3_stream_confirmation", """WITH RECURSIVE o AS (SELECT event_id, user_id, event_type AS c, epoch(ts) AS t, event_id % 4 <> 0 AS q, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT NULL::BIGINT AS event_id, user_id, 0::BIGINT AS i, NULL::VARCHAR AS class_, 0::BIGINT AS n, 0::DOUBLE AS last, false AS fired, 0::BIGINT AS consecutive, false AS newly FROM o WHERE i = 1
 UNION ALL SELECT event_id, user_id, i, CASE WHEN q THEN c END, CASE WHEN NOT q OR newly THEN 0 ELSE n1 END, t, q AND (f1 OR newly), CASE WHEN q THEN n1 ELSE 0 END, q AND newly
 FROM (SELECT *, NOT f1 AND n1 >= 2 AS newly FROM (SELECT *, CASE WHEN gap THEN 1 ELSE n0 + 1 END AS n1, f0 AND NOT gap AS f1 FROM (SELECT *, n0 > 0 AND t - last > 86400 AS gap FROM
  (SELECT o.event_id, o.user_id, o.i, o.c, o.t, o.q, r.last, CASE WHEN r.class_ = o.c THEN r.n ELSE 0 END AS n0, coalesce(r.class_ = o.c, false) AND r.fired AS f0 FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)))))
SELECT user_id AS session_id, event_id AS key, consecutive, fired AS confirmed, newly AS newly_confirmed FROM r WHERE i > 0""")
def t3(spark, d):
    e = _events(spark, d).select("user_id", "event_id", "ts", "event_type", (F.col("event_id") % 4 != 0).alias("ok"))
    return L.drain(L.confirm(e, "user_id", "ts", "event_type", "ok", "event_id", 2, 86_400), _folder(spark))


@query("t4_session_counters", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g) SELECT user_id, min(ts) AS started_at, max(ts) + INTERVAL 8 HOUR AS ended_at, count(*) AS windows, count(*) FILTER (event_type = 'error') AS alerts FROM s GROUP BY user_id, run""")
def t4(spark, d):
    e = _events(spark, d).withColumn("is_alert", F.col("event_type") == "error")
    return L.drain(L.session_counters(e, "user_id", "ts", "8 hours"), _folder(spark), "complete")


@query("t5_sliding_monitor", """SELECT started_at, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM (SELECT event_type, unnest(range(0, 12)) AS k, time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(5 * k) AS started_at FROM events) GROUP BY 1""")
def t5(spark, d):
    e = _events(spark, d).withColumn("is_error", F.col("event_type") == "error")
    return L.drain(L.monitor(e, "ts"), _folder(spark), "complete")


@query("t6_stream_timeline", "SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM events GROUP BY 1")
def t6(spark, d):
    return L.drain(L.timeline(_events(spark, d), "ts"), _folder(spark), "complete")


@query("t7_idempotent_sink", "SELECT event_id, event_type FROM events")
def t7(spark, d):
    out = _folder(spark)
    log = TableLog(spark, f"{out}/tables")
    for attempt in ("first", "again"):  # the second pass has lost its checkpoint and replays every batch
        L.run_available(_events(spark, d).select("event_id", "event_type"), f"{out}/{attempt}", L.store_batches(log, "rows", "events"))
    return log.read("rows")


_ARRIVALS = """a0 AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000 + CASE WHEN event_id % 11 = 0 THEN 259200000 ELSE 0 END AS came FROM events),
a1 AS (SELECT *, least(3, 4 * (came - min(came) OVER ()) // (max(came) OVER () - min(came) OVER () + 1)) AS batch FROM a0),
m AS (SELECT batch, max(ms) - 3600000 AS mark FROM a1 GROUP BY 1), a AS (SELECT *, ms < (SELECT max(mark) FROM m WHERE m.batch < a1.batch) IS TRUE AS late FROM a1)"""


def _live(spark, d):
    """Sessions of events that arrive in four batches, one in eleven three days late; the query restarts for each batch, and a last heartbeat ends all sessions."""
    base, at = _folder(spark), F.unix_millis("ts")
    e = D.table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    e = e.withColumn("came", at + F.when(F.col("event_id") % 11 == 0, 259_200_000).otherwise(0))
    low, high, last = e.agg(F.min("came"), F.max("came"), F.max(at)).first()
    e = e.withColumn("batch", F.least(F.lit(3), F.floor(4 * (F.col("came") - low) / (high - low + 1)))).drop("came")
    beat = spark.createDataFrame([(last + 30 * 86_400_000,)], "ms long").select(F.timestamp_millis("ms").alias("ts"), F.lit(4).alias("batch"))
    e.unionByName(beat, allowMissingColumns=True).withColumn("b", F.col("batch")).write.partitionBy("b").parquet(f"{base}/all")
    log = TableLog(spark, f"{base}/tables")
    schema = e.schema
    for n in range(5):
        spark.read.schema(schema).parquet(f"{base}/all/b={n}").write.mode("append").parquet(f"{base}/in")
        windows = spark.readStream.schema(schema).parquet(f"{base}/in")
        windows = windows.withColumn("detected", F.col("event_type") != "click").withColumn("alerted", F.col("event_type") == "error")
        L.run_available(N.live_sessions(windows, "user_id", "ts", "detected", "alerted", 8 * 3600, 3600), f"{base}/state", L.store_batches(log, "rows", "sessions"))
    return log.read("rows").where("session is not null")


@query("t4_live_sessions", f"""WITH {_ARRIVALS}, g AS (SELECT *, CASE WHEN ms - lag(ms) OVER w < 28800000 THEN 0 ELSE 1 END AS new FROM a WHERE NOT late WINDOW w AS (PARTITION BY user_id ORDER BY ms)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS run FROM g)
SELECT user_id AS session, make_timestamp(min(ms) * 1000) AS started_at, make_timestamp(max(ms) * 1000) AS ended_at, count(*) AS windows, count(*) FILTER (event_type <> 'click') AS detections, count(*) FILTER (event_type = 'error') AS alerts FROM s GROUP BY user_id, run""")
def t4_live(spark, d):
    return _live(spark, d).where("kind = 'session'").drop("kind")


@query("t8_late_rows", f"WITH {_ARRIVALS} SELECT user_id AS session, count(*) AS late FROM a WHERE late GROUP BY 1")
def t8(spark, d):
    return _live(spark, d).where("kind = 'late'").groupBy("session").agg(F.sum("windows").alias("late"))


def _records(spark, d):
    """Analysed records of which the odd ones come in a second batch; three in a row hold the same bytes."""
    r = C.compare(D.score_vectors(spark, d))
    severe = F.when(F.col("agree"), "High").otherwise("Low")
    name = lambda c: F.format_string("AUD-%09d", c)
    return r.select(
        "event_id", name(F.col("event_id")).alias("audio_id"), F.sha2(F.floor(F.col("event_id") / 3).cast("string"), 256).alias("sha256"), F.lit("upload").alias("source"),
        "python_class", severe.alias("event_severity"), F.col("agree").alias("alert_raised"), (~F.col("agree")).alias("review_required"), F.lit("normal").alias("review_priority"), F.lit("model_disagreement").alias("review_ids"), "ra", "rb",
    )


@query("snk4_analyses", f"""WITH {D.SCORES}, o AS (SELECT *, 'AUD-' || lpad(event_id::VARCHAR, 9, '0') AS audio_id, row_number() OVER (PARTITION BY event_id // 3 ORDER BY event_id % 2, event_id) AS nth,
  'AUD-' || lpad((first_value(event_id) OVER (PARTITION BY event_id // 3 ORDER BY event_id % 2, event_id))::VARCHAR, 9, '0') AS stored FROM cp),
k AS (SELECT * FROM o WHERE nth = 1)
SELECT 'audio_files' AS "table", audio_id AS key, sha256((event_id // 3)::VARCHAR) AS detail FROM k
UNION ALL SELECT 'events', audio_id, python_class FROM k
UNION ALL SELECT 'confidence_scores', event_id::VARCHAR, model || ' ' || rank || ' ' || class_name FROM rk SEMI JOIN k USING (event_id)
UNION ALL SELECT 'alerts', event_id::VARCHAR, sha256((event_id // 3)::VARCHAR) || ':' || python_class || ':High' FROM k WHERE agree
UNION ALL SELECT 'reviews', event_id::VARCHAR, 'normal' FROM k WHERE NOT agree
UNION ALL SELECT 'audit', stored, CASE WHEN nth = 1 THEN 'audio_upload success' ELSE 'audio_duplicate_rejected failure' END FROM o
UNION ALL SELECT 'audit', event_id::VARCHAR, 'prediction success' FROM k
UNION ALL SELECT 'audit', event_id::VARCHAR, CASE WHEN agree THEN 'alert_generated success' ELSE 'review_queued success' END FROM k""")
def snk4(spark, d):
    """Records streamed in two batches to six tables, the query restarted between them."""
    base = _folder(spark)
    log = TableLog(spark, f"{base}/tables")
    rows = Tables(spark, "records").save(_records(spark, d))
    for odd in (0, 1):
        rows.where(F.col("event_id") % 2 == odd).write.mode("append").parquet(f"{base}/in")
        stream = A.with_duplicates(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
        L.run_available(stream, f"{base}/state", A.persist_analyses(log, "records"))
    key = lambda c: F.col(c).cast("string").alias("key")
    parts = {
        "audio_files": ("audio_id", F.col("sha256")), "events": ("audio_id", F.col("python_class")), "confidence_scores": ("event_id", F.concat_ws(" ", "model", "rank", "class_name")),
        "alerts": ("event_id", F.col("dedup_key")), "reviews": ("event_id", F.col("priority")), "audit": ("target_id", F.concat_ws(" ", "action", "outcome")),
    }
    out = None
    for name, (k, detail) in parts.items():
        part = log.read(name).select(F.lit(name).alias("table"), key(k), detail.alias("detail"))
        out = part if out is None else out.unionByName(part)
    return out


def _clips(spark, d):
    """Waveforms from vectors: each repeated to a second of 16 kHz."""
    v = D.table(spark, d, "embeddings").where("size(embedding) = 64")
    x = F.flatten(F.array_repeat(F.transform("embedding", lambda e: (e / 4).cast("float")), 250))
    return v.select(F.col("vec_id").alias("clip_id"), "label", x.alias("samples"), F.lit(16_000).cast("long").alias("rate"))


@query("v2_quality_verdicts")
def v2(spark, d):
    return W.measure(_clips(spark, d)).select("clip_id", "verdict", "problems", F.round("peak_dbfs", 4).alias("peak_dbfs"), F.round("rms_dbfs", 4).alias("rms_dbfs"))


@query("v6_segment_features")
def v6(spark, d):
    f = W.segment_features(W.condition(_clips(spark, d)), "clip_id", "samples", "rate", 1.0)
    return f.groupBy("clip_id", "feature").agg(F.round(F.avg("value"), 3).alias("value"))


@query("v7_fingerprints")
def v7(spark, d):
    return W.fingerprints(_clips(spark, d)).select("clip_id", F.hex("fingerprint").alias("fingerprint"))


def _sources(spark, d):
    """What recordings are made of: a sound of each vector (even ids), and of each a copy (odd ids), half as loud and 5 ms shorter at the start."""
    v = D.table(spark, d, "embeddings").where("size(embedding) = 64").select("vec_id", "embedding", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    return v.select((2 * F.col("vec_id") + F.col("copy")).alias("clip_id"), "embedding", F.when(F.col("copy") == 1, 0.5).otherwise(1.0).alias("gain"), (80 * F.col("copy")).alias("skip"))


def _sounds(rows):
    return W.sounds(rows, "embedding", "gain", "skip")


def _recordings(spark, d):
    # a few numbers make a whole recording: every core gets its share of the rows
    return _sounds(_sources(spark, d).repartition(4 * spark.sparkContext.defaultParallelism, "clip_id")).select("clip_id", "samples", "rate")


def _shortlist(spark, clips):
    return U.near_prints(W.fingerprints(clips).select("clip_id", "fingerprint"), "clip_id", "fingerprint", 0.9)


@query("j11_audio_duplicates")
def j11_audio(spark, d):
    """Print matches of recordings, confirmed by the aligned correlation of what they hold; recordings are made where they are read."""
    near = Tables(spark, "near").save(_shortlist(spark, _recordings(spark, d)))
    out = U.confirmed_duplicates(_sources(spark, d), near, "clip_id", load=_sounds)
    return out.select("clip_id", "near_key", "place", F.round("similarity", 6).alias("similarity"), F.round("match", 4).alias("match"), "confirmed", "best")


@query("v9_augmented")
def v9(spark, d):
    recipes = F.array(*[F.lit(x) for x in ("noise", "shift", "volume", "reverb", "distance", "device_band", "partial", "overlay")])
    plan = _clips(spark, d).withColumn("seed", F.col("clip_id")).withColumn("recipe", F.element_at(recipes, (F.col("clip_id") % 8 + 1).cast("int")))
    below = F.transform("samples", lambda x, i: (F.sin(i * 0.05) * 0.2).cast("float"))
    return W.measure(W.augmented(plan.withColumn("below", F.when(F.col("recipe") == "overlay", below)), under="below")).select("clip_id", "recipe", F.round("peak_dbfs", 3).alias("peak_dbfs"))


@query("v10_loudest_windows")
def v10(spark, d):
    return W.loudest_windows(_clips(spark, d), "samples", 4000, 3).select("clip_id", F.array_join("window_starts", ",").alias("window_starts"))


@query("v14_envelope", "SELECT vec_id AS clip_id, (i * 8 // 64)::INT AS \"column\", min(x) AS low, max(x) AS high FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS x FROM embeddings WHERE len(embedding) = 64) GROUP BY 1, 2")
def v14(spark, d):
    return W.envelope(D.table(spark, d, "embeddings").where("size(embedding) = 64").withColumnRenamed("vec_id", "clip_id"), "clip_id", "embedding", 8)


@query("a29_band_statistics", "SELECT i AS band, round(avg(x::DOUBLE), 4) + 0.0 AS mean, round(stddev_pop(x::DOUBLE), 4) AS std FROM (SELECT unnest(range(64)) AS i, unnest(embedding) AS x FROM embeddings WHERE len(embedding) = 64 AND vec_id % 10 <> 0) GROUP BY 1")
def a29(spark, d):
    rows = D.table(spark, d, "embeddings").where("size(embedding) = 64 and vec_id % 10 <> 0").select(F.posexplode("embedding").alias("band", "x"))
    s = W.band_statistics(rows.withColumn("x", F.col("x").cast("double")), "band", "x")
    return s.select(F.col("band").cast("long").alias("band"), (F.round("mean", 4) + F.lit(0.0)).alias("mean"), F.round("std", 4).alias("std"))


@query("x22_class_weights", "WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT doc_id, round((SELECT sum(n) / count(*) FROM n) / n.n * CASE WHEN lang = 'de' THEN 1.5 ELSE 1 END, 4) AS weight FROM documents JOIN n USING (lang)")
def x22(spark, d):
    w = T.class_weights(D.table(spark, d, "documents").select("doc_id", "lang"), "lang", critical=("de",))
    return w.select("doc_id", F.round("weight", 4).alias("weight"))


@query("v13_linear_model")
def v13(spark, d):
    v = D.table(spark, d, "embeddings").where("size(embedding) = 64 and label is not null").select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    train = T.class_weights(v.where("vec_id % 10 <> 0"), "label", critical=())
    return T.predict_linear(T.fit_linear(train, "embedding", "label", max_iter=10), v.where("vec_id % 10 = 0"), "embedding").select("vec_id", "label", "predicted")


_MEMBERS = ", ".join(f"list_transform(embedding[{10 * i + 1}:{10 * i + 10}], lambda x: x::DOUBLE) AS m{i}" for i in range(4))
_SUM = " + ".join(f"CASE WHEN mask & {1 << i} > 0 THEN m{i}[c] ELSE 0 END" for i in range(4))


@query("v13_member_subsets", f"""WITH m AS (SELECT vec_id, label, {_MEMBERS} FROM embeddings WHERE len(embedding) = 64 AND label BETWEEN 0 AND 9),
s AS (SELECT vec_id, label, mask, list_transform(range(1, 11), lambda c: {_SUM}) AS s FROM m, (SELECT unnest(range(1, 16)) AS mask)),
g AS (SELECT mask, count(*) AS clips, count(*) FILTER (list_position(s, list_max(s)) - 1 = label) AS "right" FROM s GROUP BY 1)
SELECT mask, bit_count(mask)::INT AS size, clips, "right", round("right" / clips, 6) AS accuracy, row_number() OVER (ORDER BY "right" DESC, bit_count(mask), mask) AS place FROM g""")
def v13_subsets(spark, d):
    """Four members, each ten elements of a vector taken as its scores."""
    v = D.table(spark, d, "embeddings").where("size(embedding) = 64 and label between 0 and 9")
    v = v.select(F.col("label").cast("string").alias("label"), *[F.slice("embedding", 10 * i + 1, 10).alias(f"m{i}") for i in range(4)])
    return T.member_subsets(v, [f"m{i}" for i in range(4)], "label", [str(i) for i in range(10)]).withColumn("accuracy", F.round("accuracy", 6))


@query("w19_candidate_ranking", """WITH t AS (SELECT event_type AS family, user_id, round(avg(value) / 100, 6) AS score, count(*) AS cost, round(avg((value > 30)::INT), 6) AS recall FROM events GROUP BY 1, 2),
e AS (SELECT *, recall >= 0.5 AS eligible, max((recall >= 0.5)::INT) OVER (PARTITION BY family) = 1 AS any_ok FROM t)
SELECT family, user_id, eligible FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY CASE WHEN any_ok THEN eligible::INT ELSE 1 END DESC, round(score / 0.005) DESC, cost, user_id) AS place FROM e) WHERE place <= 3""")
def w19(spark, d):
    t = D.table(spark, d, "events").groupBy(F.col("event_type").alias("family"), "user_id").agg(F.round(F.avg("value") / 100, 6).alias("score"), F.count("*").alias("cost"), F.round(F.avg((F.col("value") > 30).cast("int")), 6).alias("recall"))
    t = t.withColumn("cost", F.struct("cost", "user_id"))
    return T.rank_candidates(t, "family", "score", "cost", "recall", 0.5).where("place <= 3").select("family", "user_id", "eligible")


@query("v4_segments", "SELECT vec_id AS clip_id, i AS segment, i * 0.25::DOUBLE AS start_sec, i * 0.25::DOUBLE + 0.25::DOUBLE AS end_sec, 4000 AS n FROM (SELECT vec_id, unnest(range(4)) AS i FROM embeddings WHERE len(embedding) = 64)")
def v4(spark, d):
    return W.segments(_clips(spark, d), "clip_id", "samples", "rate", 0.25).select("clip_id", "segment", "start_sec", "end_sec", F.size("samples").alias("n"))


@query("v5_mel_images")
def v5(spark, d):
    m = W.mel_images(_clips(spark, d), "clip_id", "samples", "rate", 0.5, bands=32, size=1024, hop=320, loudest_only=True)
    return m.select("clip_id", "segment", "n_frames", F.round(F.array_max("image"), 2).alias("loudest_db"))


@query("v15_class_spectra")
def v15(spark, d):
    m = W.realism(_clips(spark, d), "clip_id", "samples", "rate")
    return W.class_spectra(m, "label").withColumn("cosine", F.round("cosine", 4))
