"""Queries on the clip manifest and on fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from echotable.operators import dataset as M
from echotable.operators import duplicates as U
from echotable.operators import folds as K
from echotable.operators import split as P
from echotable.sources import domain as D

QUERIES, ORACLES = {}, {}
_LANGS = ["en", "de", "fr", "es", "it"]
# Keywords of recording environments, in rule order.
_ENV = {"vehicle": ("cockpit", "in car"), "outdoor": ("/fr/", "street"), "indoor": ("/en/", "room")}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("f12_manifest_violations", f"""WITH {D.MANIFEST} SELECT audio_id, unnest(list_filter([CASE WHEN class_label NOT IN ('en', 'de', 'fr') THEN 'unknown_class' END, CASE WHEN licence = '' THEN 'blank_licence' END], lambda x: x IS NOT NULL)) AS violation FROM mf""")
def f12(spark, d):
    return M.violations(D.manifest(spark, d), _LANGS[:3])


@query("f14_dataset_checks", f"""WITH {D.MANIFEST} SELECT 'licence_present' AS "check", count(*) FILTER (licence = '') AS failures, coalesce((SELECT string_agg(audio_id, ',' ORDER BY audio_id) FROM (SELECT audio_id FROM mf WHERE licence = '' ORDER BY 1 LIMIT 5)), '') AS examples FROM mf
UNION ALL SELECT 'licence_commercial', count(*) FILTER (licence LIKE '%-NC%'), coalesce((SELECT string_agg(audio_id, ',' ORDER BY audio_id) FROM (SELECT audio_id FROM mf WHERE licence LIKE '%-NC%' ORDER BY 1 LIMIT 5)), '') FROM mf
UNION ALL SELECT 'long_enough', count(*) FILTER (duration_sec < 0.5), coalesce((SELECT string_agg(audio_id, ',' ORDER BY audio_id) FROM (SELECT audio_id FROM mf WHERE duration_sec < 0.5 ORDER BY 1 LIMIT 5)), '') FROM mf""")
def f14(spark, d):
    rules = {"licence_present": F.col("licence") != "", "licence_commercial": ~F.col("licence").rlike("-NC(-|$)"), "long_enough": F.col("duration_sec") >= 0.5}
    return M.check_rows(D.manifest(spark, d), rules)


@query("f16_licence_reasons", f"WITH {D.MANIFEST} SELECT CASE WHEN licence = '' THEN 'missing' WHEN licence IN ('CC0', 'CC-BY') THEN 'allowed' ELSE 'rejected' END AS reason, count(*) AS n FROM mf GROUP BY 1")
def f16(spark, d):
    reason = F.when(F.col("licence") == "", "missing").when(F.col("licence").isin("CC0", "CC-BY"), "allowed").otherwise("rejected")
    return D.manifest(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("j6_quality_join", f"WITH {D.MANIFEST} SELECT audio_id, CASE WHEN l.doc_id IS NULL THEN 'not measured' WHEN quality = 0 THEN 'Unusable' ELSE 'Good' END AS verdict FROM mf LEFT JOIN labels l ON l.doc_id = clip")
def j6(spark, d):
    j = D.manifest(spark, d).join(D.table(spark, d, "labels"), F.col("clip") == F.col("doc_id"), "left")
    return j.select("audio_id", F.when(F.col("doc_id").isNull(), "not measured").when(F.col("quality") == 0, "Unusable").otherwise("Good").alias("verdict"))


@query("j7_lineage", f"WITH {D.MANIFEST} SELECT k.audio_id, CASE WHEN p.audio_id IS NULL THEN 'missing_parent' WHEN p.role <> 'original' THEN 'augmented_parent' ELSE 'label_differs' END AS fault FROM mf k LEFT JOIN mf p ON p.audio_id = k.parent_audio_id AND p.clip % 3 <> 0 WHERE k.parent_audio_id IS NOT NULL AND k.clip % 3 <> 0 AND (p.audio_id IS NULL OR p.role <> 'original' OR p.class_label <> k.class_label)")
def j7(spark, d):
    return M.lineage_faults(D.manifest(spark, d).where("clip % 3 <> 0"))


@query("j8_coverage", f"WITH {D.MANIFEST} SELECT audio_id, 'unassigned' AS state FROM mf WHERE clip NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'CLP-' || lpad(doc_id::VARCHAR, 6, '0'), 'phantom' FROM labels WHERE doc_id NOT IN (SELECT clip FROM mf)")
def j8(spark, d):
    assigned = D.table(spark, d, "labels").select(F.format_string("CLP-%06d", "doc_id").alias("audio_id"))
    return M.coverage(D.manifest(spark, d), assigned)


@query("j10_exact_duplicates", f"""WITH {D.MANIFEST}, b AS (SELECT * FROM mf WHERE clip % 2 = 0), s AS (SELECT sha256, min(audio_id) AS stored FROM mf WHERE clip % 2 = 1 GROUP BY 1)
SELECT audio_id, coalesce(stored, CASE WHEN min(audio_id) OVER (PARTITION BY sha256) <> audio_id THEN min(audio_id) OVER (PARTITION BY sha256) END) AS duplicate_of FROM b LEFT JOIN s USING (sha256)""")
def j10(spark, d):
    m = D.manifest(spark, d).select("audio_id", "sha256", "clip")
    return U.exact_matches(m.where("clip % 2 = 0"), m.where("clip % 2 = 1"), "sha256", "audio_id").select("audio_id", "duplicate_of")


@query("j15_class_by_priority", """WITH m(label, class_name, priority) AS (VALUES ('fr', 'Vehicle Horn', 2), ('page', 'Alarm or Siren', 1), ('ref', 'Animal Sound', 3)), e AS (SELECT page_id, unnest(string_split_regex(url, '[^a-z]+')) AS label FROM pages)
SELECT page_id, min_by(class_name, (priority, class_name)) AS class_name FROM e JOIN m USING (label) GROUP BY 1""")
def j15(spark, d):
    return M.by_priority(_labels(spark, d), "page_id", "labels", _mapping(spark))


@query("j16_first_allowed", """WITH m(label, class_name, priority) AS (VALUES ('fr', 'Vehicle Horn', 2), ('page', 'Alarm or Siren', 1), ('ref', 'Animal Sound', 3)), e AS (SELECT page_id, generate_subscripts(l, 1) AS place, unnest(l) AS label FROM (SELECT page_id, string_split_regex(url, '[^a-z]+') AS l FROM pages))
SELECT page_id, min_by(class_name, place) AS class_name FROM e JOIN m USING (label) GROUP BY 1""")
def j16(spark, d):
    return M.first_allowed(_labels(spark, d), "page_id", "labels", _mapping(spark))


def _labels(spark, d):
    return D.table(spark, d, "pages").select("page_id", F.split("url", "[^a-z]+").alias("labels"))


def _mapping(spark):
    return spark.createDataFrame([("fr", "Vehicle Horn", 2), ("page", "Alarm or Siren", 1), ("ref", "Animal Sound", 3)], "label string, class_name string, priority int")


@query("u1_merged_manifest", f"WITH {D.MANIFEST} SELECT audio_id, licence, CASE WHEN clip % 2 = 1 THEN author END AS author FROM mf")
def u1(spark, d):
    m = D.manifest(spark, d)
    return M.merge([m.where("clip % 2 = 0").select("audio_id", "licence"), m.where("clip % 2 = 1").select("audio_id", "licence", "author")])


@query("u5_first_by_content", f"WITH {D.MANIFEST} SELECT sha256, min(audio_id) AS audio_id FROM mf GROUP BY 1")
def u5(spark, d):
    return M.first_by_content(D.manifest(spark, d), "sha256", "audio_id").select("sha256", "audio_id")


@query("a22_duplicate_groups", f"WITH {D.MANIFEST} SELECT sha256, count(*) AS n, min(audio_id) AS first FROM mf GROUP BY 1 HAVING count(*) > 1")
def a22(spark, d):
    return M.duplicate_groups(D.manifest(spark, d), "sha256", "audio_id")


@query("a23_hash_mismatch", "SELECT doc_id FROM documents WHERE sha256(text) <> CASE WHEN doc_id % 50 = 0 THEN sha256('') ELSE sha256(text) END")
def a23(spark, d):
    stored = F.when(F.col("doc_id") % 50 == 0, F.sha2(F.lit(""), 256)).otherwise(F.sha2("text", 256))
    return D.table(spark, d, "documents").where(F.sha2("text", 256) != stored).select("doc_id")


@query("u2_split_overlap", "SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def u2(spark, d):
    t = D.table(spark, d, "labels")
    return t.where("quality = 1").select("doc_id").intersect(t.where("toxic = 1").select("doc_id"))


@query("u4_vocabulary_drift", "(SELECT DISTINCT lang AS name FROM documents EXCEPT SELECT unnest(['en', 'de', 'it'])) UNION (SELECT unnest(['en', 'de', 'it']) EXCEPT SELECT lang FROM documents)")
def u4(spark, d):
    have = D.table(spark, d, "documents").select(F.col("lang").alias("name"))
    want = spark.createDataFrame([("en",), ("de",), ("it",)], "name string")
    return have.subtract(want).union(want.subtract(have))


@query("w5_round_robin", f"""WITH {D.MANIFEST}, r AS (SELECT *, row_number() OVER (PARTITION BY class_label, author ORDER BY audio_id) AS turn, count(*) OVER (PARTITION BY class_label, author) AS many FROM mf)
SELECT audio_id, class_label, pick FROM (SELECT *, row_number() OVER (PARTITION BY class_label ORDER BY turn, many DESC, author) AS pick FROM r) WHERE pick <= 30""")
def w5(spark, d):
    return M.round_robin(D.manifest(spark, d), "class_label", "author", "audio_id", 30).select("audio_id", "class_label", F.col("pick").cast("long").alias("pick"))


@query("w6_hash_cap", f"WITH {D.MANIFEST} SELECT audio_id, class_label FROM (SELECT *, row_number() OVER (PARTITION BY class_label ORDER BY sha256('gtm|' || audio_id), audio_id) AS i FROM mf) WHERE i <= 40")
def w6(spark, d):
    return M.cap_by_hash(D.manifest(spark, d), "class_label", "audio_id", 40, "gtm").select("audio_id", "class_label")


@query("w8_new_numbers", f"""WITH {D.MANIFEST}, t AS (SELECT class_label, max(clip) AS top FROM mf WHERE clip % 5 = 0 GROUP BY 1)
SELECT audio_id, coalesce(top, 0) + row_number() OVER (PARTITION BY class_label ORDER BY audio_id) AS new_number FROM mf LEFT JOIN t USING (class_label) WHERE clip % 5 <> 0""")
def w8(spark, d):
    m = D.manifest(spark, d)
    taken = m.where("clip % 5 = 0").select("class_label", F.col("clip").alias("number"))
    return M.new_ids(m.where("clip % 5 <> 0"), "class_label", "audio_id", taken).select("audio_id", "new_number")


def _split_rows(spark, d, group):
    """The manifest with groups within classes, and only copies that have their parent's label."""
    m = D.manifest(spark, d).withColumn("source_group", F.concat_ws("/", "class_label", "source_group", group.cast("string")))
    first = m.where("role = 'original'").select(F.col("audio_id").alias("p"), F.col("class_label").alias("pl"))
    return m.join(first, F.col("parent_audio_id") == F.col("p"), "left").where("parent_audio_id is null or pl = class_label").drop("p", "pl")


@query("w18_group_split")
def w18(spark, d):
    return P.split(_split_rows(spark, d, F.col("clip") % 7), on_overflow="largest_room")


# One group after the other, as the rule is stated: largest first, ties in hash order, to the emptiest partition that it fits.
_QUOTA_SPLIT = f"""WITH RECURSIVE {D.MANIFEST}, m AS (
  SELECT k.* REPLACE (k.class_label || '/' || k.source_group || '/' || (k.clip // 3) AS source_group) FROM mf k LEFT JOIN mf p ON p.audio_id = k.parent_audio_id WHERE p.audio_id IS NULL OR p.class_label = k.class_label
), g AS (
  SELECT class_label, source_group, count(*) AS size, row_number() OVER (PARTITION BY class_label ORDER BY count(*) DESC, sha256('42:' || source_group)) AS i FROM m WHERE role = 'original' GROUP BY 1, 2
), n AS (SELECT class_label, sum(size) AS n FROM g GROUP BY 1),
q AS (SELECT class_label, round_even(n * 0.7::DOUBLE, 0)::BIGINT AS a, round_even(n * 0.15::DOUBLE, 0)::BIGINT AS b, n::BIGINT - round_even(n * 0.7::DOUBLE, 0)::BIGINT - round_even(n * 0.15::DOUBLE, 0)::BIGINT AS c FROM n),
s(class_label, i, a, b, c, split) AS (
  SELECT class_label, 0::BIGINT, a, b, c, NULL::VARCHAR FROM q
  UNION ALL
  SELECT class_label, i, a - size * (split = 'train')::INT, b - size * (split = 'val')::INT, c - size * (split = 'test')::INT, split FROM (
    SELECT class_label, i, a, b, c, size, CASE WHEN ra >= 0 AND ra >= rb AND ra >= rc THEN 'train' WHEN rb >= 0 AND rb >= rc THEN 'val' WHEN rc >= 0 THEN 'test' END AS split FROM (
      SELECT s.class_label, g.i, s.a, s.b, s.c, g.size, CASE WHEN s.a >= size THEN s.a / q.a ELSE -1 END AS ra, CASE WHEN s.b >= size THEN s.b / q.b ELSE -1 END AS rb, CASE WHEN s.c >= size THEN s.c / q.c ELSE -1 END AS rc
      FROM s JOIN g ON g.class_label = s.class_label AND g.i = s.i + 1 JOIN q ON q.class_label = s.class_label))
), o AS (SELECT m.audio_id, m.class_label, m.role, m.source_group AS "group", s.split FROM m JOIN g USING (class_label, source_group) JOIN s ON s.class_label = g.class_label AND s.i = g.i WHERE m.role = 'original'),
w AS (SELECT * FROM o UNION ALL SELECT k.audio_id, k.class_label, k.role, o."group", o.split FROM m k JOIN o ON o.audio_id = k.parent_audio_id WHERE k.role <> 'original')"""


@query("w18_quota_split", f"{_QUOTA_SPLIT} SELECT * FROM w")
def w18_quota(spark, d):
    return P.split(_split_rows(spark, d, F.floor(F.col("clip") / 3)))


@query("w17_folds", f"""WITH {D.MANIFEST}, b AS (SELECT author, class_label, count(*) AS c FROM mf GROUP BY 1, 2), h AS (SELECT author, max_by(class_label, (c, class_label)) AS home, sum(c) AS n FROM b GROUP BY 1),
k AS (SELECT author, (row_number() OVER (PARTITION BY home ORDER BY n DESC, sha256('42|' || author)) - 1) % 10 AS s FROM h)
SELECT least(s, 9 - s)::INT AS fold, count(*) AS n, count(DISTINCT author) AS authors FROM mf JOIN k USING (author) GROUP BY 1""")
def w17(spark, d):
    return M.folds(D.manifest(spark, d), "author", "class_label", 5).groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("author").alias("authors"))


@query("w17_stratified_folds")
def w17_stratified(spark, d):
    """Clips of each class and fold, groups being authors' recordings of one source."""
    m = D.manifest(spark, d).withColumn("group", F.concat_ws("/", "author", "source_group"))
    return K.stratified_folds(m, "group", "class_label", 5).groupBy("fold", "class_label").agg(F.count("*").alias("n"), F.count_distinct("group").alias("groups"))


@query("a25_split_counts", f"""{_QUOTA_SPLIT} SELECT class_label, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, true AS ok FROM w WHERE role = 'original' GROUP BY 1""")
def a25(spark, d):
    return P.split_counts(w18_quota(spark, d), tolerance=0)


@query("a17_manifest_statistics", f"WITH {D.MANIFEST} SELECT coalesce(class_label, 'all') AS class_label, count(*) AS n, count(*) FILTER (role = 'original') AS originals, count(*) FILTER (role <> 'original') AS augmented, count(*) FILTER (role = 'original') >= 100 AS meets_floor FROM mf GROUP BY ROLLUP (class_label)")
def a17(spark, d):
    n = F.count_if(F.col("role") == "original")
    r = D.manifest(spark, d).rollup("class_label").agg(F.count("*").alias("n"), n.alias("originals"), F.count_if(F.col("role") != "original").alias("augmented"), (n >= 100).alias("meets_floor"))
    return r.withColumn("class_label", F.coalesce("class_label", F.lit("all")))


@query("a18_verdict_tables", f"""WITH {D.MANIFEST}, v AS (SELECT class_label, environment, CASE WHEN l.doc_id IS NULL THEN 'not measured' WHEN quality = 0 THEN 'Unusable' ELSE 'Good' END AS verdict FROM mf LEFT JOIN labels l ON l.doc_id = clip)
SELECT class_label, environment, verdict, count(*) AS n FROM v GROUP BY GROUPING SETS ((class_label, verdict), (environment, verdict), (verdict))""")
def a18(spark, d):
    v = j6(spark, d).join(D.manifest(spark, d).select("audio_id", "class_label", "environment"), "audio_id")
    return v.groupingSets([["class_label", "verdict"], ["environment", "verdict"], ["verdict"]], "class_label", "environment", "verdict").agg(F.count("*").alias("n"))


@query("a19_durations", f"WITH {D.MANIFEST} SELECT class_label, round(min(duration_sec), 4) AS shortest, round(median(duration_sec), 4) AS median, round(max(duration_sec), 4) AS longest FROM mf GROUP BY 1")
def a19(spark, d):
    return D.manifest(spark, d).groupBy("class_label").agg(F.round(F.min("duration_sec"), 4).alias("shortest"), F.round(F.percentile("duration_sec", 0.5), 4).alias("median"), F.round(F.max("duration_sec"), 4).alias("longest"))


@query("a20_attribution", f"WITH {D.MANIFEST}, o AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY audio_id) AS i FROM mf) SELECT author, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, string_agg(audio_id, ',' ORDER BY audio_id) FILTER (i <= 6) AS first_clips FROM o GROUP BY 1")
def a20(spark, d):
    return M.attribution(D.manifest(spark, d))


@query("a21_distinct_counts", f"WITH {D.MANIFEST} SELECT count(DISTINCT class_label) AS classes, count(DISTINCT source_group) AS sources, count(DISTINCT author) AS authors, count(DISTINCT sha256) AS contents FROM mf")
def a21(spark, d):
    return D.manifest(spark, d).agg(*[F.count_distinct(c).alias(n) for c, n in (("class_label", "classes"), ("source_group", "sources"), ("author", "authors"), ("sha256", "contents"))])


@query("a24_imbalance", f"WITH {D.MANIFEST}, c AS (SELECT l AS class_label, (SELECT count(*) FROM mf WHERE class_label = l) AS n FROM (SELECT unnest({_LANGS}) AS l)) SELECT class_label, n, round((SELECT max(n) / min(n) FILTER (n > 0) FROM c), 4) AS ratio FROM c")
def a24(spark, d):
    return M.imbalance(D.manifest(spark, d), _LANGS).withColumn("ratio", F.round("ratio", 4))


@query("x9_source_groups", """SELECT doc_id, CASE WHEN source = 'src1' THEN 'freesound:' || doc_id WHEN source = 'src2' THEN 'tts:' || lang || ':call now' ELSE 'clip:' || doc_id END AS source_group FROM documents""")
def x9(spark, d):
    t = D.table(spark, d, "documents")
    is1, is2 = F.col("source") == "src1", F.col("source") == "src2"
    none = F.lit("")
    name = M.source_group(
        F.when(is1, "ESC-50 set").otherwise(none), F.when(is1, F.concat(F.lit("1-"), F.col("doc_id").cast("string"), F.lit("-A.wav"))).otherwise(none), none,
        F.when(is2, F.col("lang")).otherwise(none), F.when(is2, "Call, now!").otherwise(none), F.col("doc_id").cast("string"),
    )
    return t.select("doc_id", name.alias("source_group"))


@query("x11_environment", "SELECT page_id, CASE WHEN lower(url) LIKE '%cockpit%' THEN 'vehicle' WHEN lower(url) LIKE '%/fr/%' THEN 'outdoor' WHEN lower(url) LIKE '%/en/%' THEN 'indoor' ELSE 'unspecified' END AS environment, CASE WHEN lower(url) LIKE '%cockpit%' OR lower(url) LIKE '%/fr/%' OR lower(url) LIKE '%/en/%' THEN 'stated' ELSE 'unmatched' END AS basis FROM pages")
def x11(spark, d):
    e = M.environment(F.col("url"), F.lit(""), _ENV)
    return D.table(spark, d, "pages").select("page_id", e.alias("e")).select("page_id", "e.*")


@query("x8_csv_cells", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '''=' || url ELSE url END AS cell FROM pages")
def x8(spark, d):
    from echotable.functions import scores as S

    cell = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("="), "url")).otherwise(F.col("url"))
    return D.table(spark, d, "pages").select("page_id", S.csv_safe(cell).alias("cell"))


@query("x15_hash_seeds", "SELECT doc_id, CAST('0x' || substr(sha256(doc_id::VARCHAR), 1, 8) AS BIGINT) AS seed FROM documents")
def x15(spark, d):
    from echotable.functions import scores as S

    return D.table(spark, d, "documents").select("doc_id", S.hash_seed(F.col("doc_id").cast("string")).alias("seed"))


@query("x19_segments", f"WITH {D.MANIFEST}, k AS (SELECT audio_id, duration_sec, greatest(1, floor((duration_sec - 3.0) / 3.0 + 1 + 1e-9)::INT) AS n FROM mf) SELECT audio_id, i AS segment, round(i * 3.0, 3)::DOUBLE AS start_sec, round(least(i * 3.0 + 3.0, duration_sec), 3)::DOUBLE AS end_sec FROM k, LATERAL (SELECT unnest(range(n)) AS i)")
def x19(spark, d):
    m = D.manifest(spark, d).select("audio_id", F.posexplode(M.segment_bounds(F.col("duration_sec"), 3.0, 3.0)).alias("segment", "b"))
    return m.select("audio_id", F.col("segment").cast("long").alias("segment"), F.round("b.start_sec", 3).alias("start_sec"), F.round("b.end_sec", 3).alias("end_sec"))


@query("x21_augmentation_plan", f"""WITH {D.MANIFEST}, p AS (SELECT audio_id, class_label, unnest(range(1, 4)) AS copy FROM mf WHERE role = 'original'), s AS (SELECT *, CAST('0x' || substr(sha256(audio_id || ':' || copy), 1, 8) AS BIGINT) AS seed FROM p)
SELECT audio_id, copy, ['noise', 'shift', 'volume', 'reverb'][seed % 4 + 1] AS recipe FROM s""")
def x21(spark, d):
    plan = M.augmentation_plan(D.manifest(spark, d).where("role = 'original'"), 3, ["noise", "shift", "volume", "reverb"], ("noise",))
    return plan.select("audio_id", F.col("copy").cast("long").alias("copy"), "recipe")


def _prints(spark, d):
    v = D.table(spark, d, "embeddings").where("size(embedding) = 64").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    return v.select("vec_id", "label", U.fingerprint(F.col("v")).alias("print"))


_PRINTS = """m AS (SELECT vec_id, label, embedding, list_sort(embedding) AS s FROM embeddings WHERE len(embedding) = 64),
p AS (SELECT vec_id, label, list_transform(embedding, lambda x: (x::DOUBLE > (s[32]::DOUBLE + s[33]::DOUBLE) / 2)::INT) AS b FROM m)"""
_ALIKE = "1 - list_sum(list_transform(range(1, 65), lambda i: abs(x.b[i] - y.b[i]))) / 64"


_COPIES = """m2 AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 1)) AS e FROM m),
c AS (SELECT vec_id, list_transform(e, lambda x: (x > (list_sort(e)[32] + list_sort(e)[33]) / 2)::INT) AS b FROM m2)"""


def _copies(spark, d):
    """Prints of coarsely stored copies: every vector rounded to one place."""
    v = D.table(spark, d, "embeddings").where("size(embedding) = 64").withColumn("v", F.transform("embedding", lambda x: F.round(x.cast("double"), 1)))
    return v.select("vec_id", U.fingerprint(F.col("v")).alias("print"))


@query("j11_near_duplicates", f"""WITH {_PRINTS}, {_COPIES}, a AS (SELECT 2 * vec_id AS clip_id, b FROM p UNION ALL SELECT 2 * vec_id + 1, b FROM c),
q AS (SELECT x.clip_id, y.clip_id AS near_key, {_ALIKE} AS similarity FROM a x JOIN a y ON y.clip_id < x.clip_id)
SELECT clip_id, near_key, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY similarity DESC, near_key) AS i FROM q WHERE similarity >= 0.92) WHERE i <= 5""")
def j11(spark, d):
    clips = _prints(spark, d).select((2 * F.col("vec_id")).alias("clip_id"), "print").unionByName(_copies(spark, d).select((2 * F.col("vec_id") + 1).alias("clip_id"), "print"))
    return U.near_matches(clips, "clip_id", "print", 0.92, 5).select("clip_id", "near_key", F.round("similarity", 6).alias("similarity"))


@query("j12_hard_negatives", f"""WITH {_PRINTS}, q AS (SELECT x.vec_id, y.vec_id AS other, {_ALIKE} AS similarity FROM p x JOIN p y ON x.vec_id % 50 = 0 AND x.label <> y.label)
SELECT vec_id, other, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, other) AS i FROM q) WHERE i <= 3""")
def j12(spark, d):
    p = _prints(spark, d)
    return U.hard_negatives(p.where("vec_id % 50 = 0"), p, "vec_id", "print", "label").select("vec_id", "other", F.round("similarity", 6).alias("similarity"))


@query("e12_near_duplicate_thresholds", f"""WITH {_PRINTS}, {_COPIES},
h AS (SELECT x.vec_id, {_ALIKE} AS similarity, row_number() OVER (PARTITION BY x.vec_id ORDER BY {_ALIKE} DESC, y.vec_id) AS i FROM p x JOIN p y ON x.vec_id % 50 = 0 AND x.label <> y.label),
z AS (SELECT {_ALIKE} AS similarity, true AS is_copy FROM p x JOIN c y USING (vec_id) UNION ALL SELECT similarity, false FROM h WHERE i <= 3)
SELECT t AS threshold, round(count(*) FILTER (is_copy AND similarity >= t) / greatest(1, count(*) FILTER (is_copy)), 6) AS recall, count(*) FILTER (NOT is_copy AND similarity >= t) AS false_flags FROM z, (SELECT unnest([0.75, 0.8, 0.85, 0.9, 0.95]::DOUBLE[]) AS t) GROUP BY 1""")
def e12(spark, d):
    p = _prints(spark, d)
    copies = p.join(_copies(spark, d).withColumnRenamed("print", "copy"), "vec_id").select(U.similarity(F.col("print"), F.col("copy")).alias("similarity"), F.lit(True).alias("is_copy"))
    negatives = U.hard_negatives(p.where("vec_id % 50 = 0"), p, "vec_id", "print", "label").select("similarity", F.lit(False).alias("is_copy"))
    return U.evaluate_near(copies.unionByName(negatives), [0.75, 0.8, 0.85, 0.9, 0.95]).withColumn("recall", F.round("recall", 6))


_CODES = {"en": "ENG", "de": "DEU", "fr": "FRA"}
_CODE = "CASE class_label WHEN 'en' THEN 'ENG' WHEN 'de' THEN 'DEU' WHEN 'fr' THEN 'FRA' END"
_SOURCE_ROWS = f"""sr AS (SELECT * REPLACE (CASE WHEN clip % 13 = 0 THEN 'SS-' || clip ELSE 'SS-' || CASE WHEN clip % 17 = 0 THEN 'XXX' ELSE coalesce({_CODE}, 'SPA') END || '-' || lpad((clip % 10000)::VARCHAR, 4, '0') END AS audio_id),
  CASE WHEN clip % 19 = 0 THEN 'train' END AS dataset_split, environment AS recording_environment, source_group || '.wav' AS filename FROM mf)"""


def _source_rows(spark, d):
    code = F.coalesce(F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair])[F.col("class_label")], F.lit("SPA"))
    clip = F.col("clip")
    name = F.when(clip % 13 == 0, F.concat(F.lit("SS-"), clip.cast("string"))).otherwise(F.concat(F.lit("SS-"), F.when(clip % 17 == 0, "XXX").otherwise(code), F.lit("-"), F.lpad((clip % 10000).cast("string"), 4, "0")))
    m = D.manifest(spark, d).withColumn("audio_id", name)
    return m.withColumn("dataset_split", F.when(clip % 19 == 0, "train")).withColumn("recording_environment", F.col("environment")).withColumn("filename", F.concat("source_group", F.lit(".wav")))


@query("f13_assembly_problems", f"""WITH {D.MANIFEST}, {_SOURCE_ROWS}, g AS (SELECT *, {_CODE} AS code, regexp_extract(audio_id, '^SS-([A-Z]{{3}})-[0-9]{{4}}$', 1) AS got FROM sr)
SELECT audio_id, unnest(list_filter([CASE WHEN dataset_split IS NOT NULL THEN 'split_already_set' END, CASE WHEN code IS NULL THEN 'unknown_class' END, CASE WHEN got = '' THEN 'malformed_id' END, CASE WHEN got <> '' AND got <> code THEN 'code_of_another_class' END,
  CASE WHEN licence = '' THEN 'empty_licence' END, CASE WHEN licence LIKE '%-NC%' THEN 'non_commercial_licence' END, CASE WHEN environment NOT IN ('indoor', 'outdoor') THEN 'unknown_environment' END], lambda x: x IS NOT NULL)) AS problem FROM g""")
def f13(spark, d):
    return M.assembly_problems(_source_rows(spark, d), _CODES)


@query("x10_id_parts", f"""WITH {D.MANIFEST}, {_SOURCE_ROWS} SELECT audio_id, nullif(regexp_extract(audio_id, '^SS-([A-Z]{{3}})-[0-9]{{4}}$', 1), '') AS code, nullif(regexp_extract(audio_id, '^SS-[A-Z]{{3}}-([0-9]{{4}})$', 1), '')::INT AS number FROM sr""")
def x10(spark, d):
    return _source_rows(spark, d).select("audio_id", M.clip_id_parts(F.col("audio_id")).alias("x")).select("audio_id", "x.code", "x.number")


@query("x10_upload_days", f"WITH {D.FILES} SELECT audio_id, DATE '2024-01-01' + (audio_key % 28)::INT AS day FROM au")
def x10_days(spark, d):
    return D.audio_files(spark, d).select("audio_id", M.day_of_recording(F.col("audio_id")).alias("day"))


_SPLIT = "CASE clip % 10 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END"


@query("f10_split_rows", f"WITH {D.MANIFEST} SELECT audio_id FROM mf WHERE {_SPLIT} = 'test' AND role = 'original'")
def f10(spark, d):
    m = D.manifest(spark, d).withColumn("dataset_split", F.expr(_SPLIT))
    return M.select_split(m, "test").select("audio_id")


@query("f11_reportable", f"WITH {D.MANIFEST}, b AS (SELECT *, {_SPLIT} AS split FROM mf) SELECT count(*) FILTER (split <> 'test') AS wrong_split, count(*) FILTER (role <> 'original') AS augmented, count(*) FILTER (split <> 'test' OR role <> 'original') = 0 AS ok FROM b")
def f11(spark, d):
    from echotable.operators import compare as C

    m = D.manifest(spark, d).withColumn("split", F.expr(_SPLIT))
    return C.reportable(m).select("wrong_split", "augmented", "ok")


@query("f15_defects", f"WITH {D.MANIFEST} SELECT audio_id, unnest(list_filter([CASE WHEN duration_sec < 2 THEN 'too_short' END, CASE WHEN -(clip % 60) <= -50 THEN 'too_quiet' END], lambda x: x IS NOT NULL)) AS defect FROM mf")
def f15(spark, d):
    return M.defects(D.manifest(spark, d).withColumn("rms_dbfs", -(F.col("clip") % 60)), shortest=2.0)


@query("j9_unmatched_files", "SELECT doc_id::VARCHAR || '.wav' AS filename, 'file_missing' AS state FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id::VARCHAR || '.wav', 'not_in_manifest' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def j9(spark, d):
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".wav")).alias("filename")
    return M.unmatched_files(D.table(spark, d, "documents").select(name), D.table(spark, d, "labels").select(name))


@query("u6_table_differences", "SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def u6(spark, d):
    return M.differences(D.table(spark, d, "documents").select("doc_id"), D.table(spark, d, "labels").select("doc_id"))


@query("w7_keep_lowest", f"WITH {D.MANIFEST} SELECT audio_id, class_label FROM (SELECT *, row_number() OVER (PARTITION BY class_label ORDER BY audio_id) AS i FROM mf) WHERE i <= 25")
def w7(spark, d):
    return M.keep_lowest(D.manifest(spark, d), "class_label", "audio_id", 25).select("audio_id", "class_label")


@query("a31_skip_reasons", f"WITH {D.MANIFEST} SELECT CASE WHEN licence = '' THEN 'no_licence' WHEN licence LIKE '%-NC%' THEN 'non_commercial' WHEN duration_sec < 1 THEN 'too_short' ELSE 'accepted' END AS reason, count(*) AS n FROM mf GROUP BY 1")
def a31(spark, d):
    reason = F.when(F.col("licence") == "", "no_licence").when(F.col("licence").contains("-NC"), "non_commercial").when(F.col("duration_sec") < 1, "too_short")
    return M.reason_counts(D.manifest(spark, d), reason)


@query("x19_covering_segments", f"""WITH {D.MANIFEST}, k AS (SELECT audio_id, (clip % 9000 + n0)::BIGINT AS n FROM (SELECT *, floor(duration_sec * 100)::BIGINT AS n0 FROM mf)),
c AS (SELECT audio_id, n, ceil(n / 300)::BIGINT AS k FROM k), s AS (SELECT DISTINCT audio_id, n, CASE WHEN k <= 1 THEN 0 ELSE round_even(i * ((n - 300) / greatest(k - 1, 1)), 0)::BIGINT END AS first_sample FROM (SELECT *, unnest(range(greatest(k, 1))) AS i FROM c WHERE n > 0))
SELECT audio_id, first_sample AS start, least(n, first_sample + 300) AS "end" FROM s""")
def x19_cover(spark, d):
    n = (F.col("clip") % 9000 + F.floor(F.col("duration_sec") * 100)).cast("long")
    return D.manifest(spark, d).select("audio_id", F.explode(M.covering_bounds(n, F.lit(300).cast("long"))).alias("b")).select("audio_id", "b.start", "b.end")


@query("x20_fraction_cuts", f"""WITH {D.MANIFEST}, t AS (SELECT *, CASE WHEN duration_sec >= 3.3 THEN 3.0 ELSE greatest(0.5, duration_sec * 0.8) END::DOUBLE AS take FROM mf),
c AS (SELECT audio_id, class_label, take, list_transform([0.1, 0.4, 0.7]::DOUBLE[], lambda f: round(greatest(0.0, least(f * duration_sec, duration_sec - take)), 3)) AS l FROM t),
u AS (SELECT *, list_filter(l, lambda x, i: list_position(l, x) = i) AS starts FROM c), e AS (SELECT audio_id, class_label, take, unnest(starts) AS s, generate_subscripts(starts, 1) AS nth FROM u)
SELECT audio_id || 'S' || nth AS audio_id, audio_id AS parent_audio_id, class_label, s AS segment_start_sec, round(s + take, 3) AS segment_end_sec FROM e""")
def x20(spark, d):
    cuts = M.fraction_cuts(D.manifest(spark, d), (0.1, 0.4, 0.7), 3.0, 0.5)
    return cuts.select("audio_id", "parent_audio_id", "class_label", "segment_start_sec", "segment_end_sec")
