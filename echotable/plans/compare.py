"""Queries on two models' scores: agreement, rules, review, evaluation, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from echotable.functions.config import CRITICAL_CLASSES, effective_rules
from echotable.operators import compare as C
from echotable.sources import domain as D

QUERIES, ORACLES = {}, {}
_CRIT = ", ".join(f"'{c}'" for c in CRITICAL_CLASSES)


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _compared(spark, d):
    q = F.element_at(F.array(*[F.lit(x) for x in ("Unusable", "Poor", "Acceptable", "Good")]), (F.col("event_id") % 4 + 1).cast("int"))
    return C.compare(D.score_vectors(spark, d)).withColumn("quality", q)


def _r(*cols):
    return [F.round(c, 4).alias(c) for c in cols]


@query("agreement_by_status_class", f"WITH {D.SCORES} SELECT status, python_class, count(*) AS n, round(avg(difference), 4) AS mean_difference FROM cp GROUP BY 1, 2")
def agreement(spark, d):
    return _compared(spark, d).groupBy("status", "python_class").agg(F.count("*").alias("n"), F.round(F.avg("difference"), 4).alias("mean_difference"))


@query("w1_score_ranks", f"WITH {D.SCORES} SELECT event_id, model, class_name, round(confidence, 6) AS confidence, rank, rank = 1 AS is_top FROM rk")
def ranks(spark, d):
    return C.long_scores(D.score_vectors(spark, d)).withColumn("confidence", F.round("confidence", 6)).withColumn("rank", F.col("rank").cast("long"))


@query("w2_margins", f"WITH {D.SCORES} SELECT event_id, python_class, round(margin, 6) AS margin, second_class FROM cp")
def margins(spark, d):
    return _compared(spark, d).select("event_id", "python_class", F.round("margin", 6).alias("margin"), "second_class")


@query("o7_top3_classes", f"WITH {D.SCORES} SELECT event_id, model, string_agg(class_name, ',' ORDER BY rank) AS top3 FROM rk WHERE rank <= 3 GROUP BY 1, 2")
def top3(spark, d):
    s = C.long_scores(D.score_vectors(spark, d)).where("rank <= 3").groupBy("event_id", "model")
    return s.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "class_name"))), lambda x: x.class_name), ",").alias("top3"))


@query("x1_consistency", f"WITH {D.SCORES} SELECT event_id, status, agree, overlapping, round(difference, 6) AS difference FROM cp")
def consistency(spark, d):
    return _compared(spark, d).select("event_id", "status", "agree", "overlapping", F.round("difference", 6).alias("difference"))


@query("x2_review_reasons", f"""WITH {D.SCORES} SELECT event_id, concat_ws('; ',
  CASE WHEN status IN ('Model Disagreement', 'Uncertain Result') THEN status END, CASE WHEN status = 'Weak Match' THEN 'Weak model agreement' END,
  CASE WHEN python_confidence < 0.4 THEN 'Low Python confidence' END, CASE WHEN gtm_confidence < 0.4 THEN 'Low GTM confidence' END,
  CASE WHEN overlapping THEN 'Possible overlapping sounds' END) AS reasons FROM cp""")
def reasons(spark, d):
    from echotable.functions import scores as S

    c = _compared(spark, d)
    return c.select("event_id", S.review_reasons(F.col("status"), F.col("python_confidence"), F.col("gtm_confidence"), F.col("overlapping")).alias("reasons"))


_RULES_SQL = " UNION ALL ".join(
    f"SELECT '{r['class']}' AS rule_class, '{r['severity']}' AS rule_severity, {r['min_confidence']} AS min_confidence, {r['min_top_two_margin']} AS min_margin, '{r['min_audio_quality']}' AS min_quality, "
    f"{'NULL' if r['noise_level_dbfs_limit'] is None else r['noise_level_dbfs_limit']}::DOUBLE AS noise_limit" for r in effective_rules()
)


@query("x3_severity_and_gates", f"""WITH {D.SCORES}, ru AS ({_RULES_SQL}), j AS (
  SELECT *, CASE WHEN python_class = 'Glass Breaking' AND python_confidence >= 0.85 THEN 'Critical' ELSE rule_severity END AS event_severity,
    list_position(['Unusable', 'Poor', 'Acceptable', 'Good'], quality) >= list_position(['Unusable', 'Poor', 'Acceptable', 'Good'], min_quality) AS q_ok
  FROM cp JOIN ru ON python_class = rule_class)
SELECT event_id, event_severity, concat_ws(',', CASE WHEN python_confidence < min_confidence THEN 'min_confidence' END, CASE WHEN margin < min_margin THEN 'min_top_two_margin' END,
  CASE WHEN NOT agree THEN 'requires_model_agreement' END, CASE WHEN NOT q_ok THEN 'min_audio_quality' END, CASE WHEN noise_limit IS NOT NULL THEN 'noise_level_dbfs' END,
  CASE WHEN event_severity IN ('Low', 'Informational') THEN 'min_alert_severity' END) AS failed_gates FROM j""")
def severity(spark, d):
    return C.apply_rules(_compared(spark, d), C.rules_frame(spark)).select("event_id", "event_severity", "failed_gates")


_REVIEW_SQL = f"""rw AS (SELECT *, concat_ws(',', CASE WHEN NOT agree THEN 'model_disagreement' END,
  CASE WHEN python_confidence < 0.4 OR gtm_confidence < 0.4 THEN 'low_confidence' END, CASE WHEN quality IN ('Poor', 'Unusable') THEN 'poor_audio_quality' END,
  CASE WHEN margin < 0.2 THEN 'similar_top_classes' END, CASE WHEN overlapping THEN 'overlapping_sounds' END,
  CASE WHEN python_confidence < 0.4 AND gtm_confidence < 0.4 THEN 'unsupported_sound_pattern' END,
  CASE WHEN python_class IN ({_CRIT}) AND status IN ('Weak Match', 'Model Disagreement', 'Uncertain Result') THEN 'critical_without_agreement' END,
  CASE WHEN python_class IN ({_CRIT}) AND (quality IN ('Poor', 'Unusable') OR margin < 0.2) THEN 'possible_false_alarm' END) AS review_ids FROM cp)"""


@query("x4_review_conditions", f"""WITH {D.SCORES}, {_REVIEW_SQL} SELECT event_id, review_ids, CASE
  WHEN review_ids LIKE '%critical_without%' OR review_ids LIKE '%false_alarm%' THEN 'critical'
  WHEN review_ids LIKE '%model_dis%' OR review_ids LIKE '%low_conf%' OR review_ids LIKE '%poor_audio%' THEN 'high'
  WHEN review_ids <> '' THEN 'normal' END AS review_priority FROM rw""")
def review(spark, d):
    return C.review(_compared(spark, d)).select("event_id", "review_ids", "review_priority")


@query("x6_final_decision", f"""WITH {D.SCORES}, ru AS ({_RULES_SQL}), {_REVIEW_SQL}, j AS (
  SELECT *, CASE WHEN python_class = 'Glass Breaking' AND python_confidence >= 0.85 THEN 'Critical' ELSE rule_severity END AS event_severity,
    list_position(['Unusable', 'Poor', 'Acceptable', 'Good'], quality) >= list_position(['Unusable', 'Poor', 'Acceptable', 'Good'], min_quality) AS q_ok
  FROM cp JOIN ru ON python_class = rule_class),
g AS (SELECT event_id, python_confidence >= min_confidence AND margin >= min_margin AND agree AND q_ok AND noise_limit IS NULL AND event_severity NOT IN ('Low', 'Informational') AND status NOT IN ('Model Disagreement', 'Uncertain Result') AS alert_raised FROM j),
f AS (SELECT alert_raised, review_ids <> '' AS review_required FROM g JOIN rw USING (event_id))
SELECT CASE WHEN alert_raised THEN 'Alert Raised' WHEN review_required THEN 'Manual Review' ELSE 'Recorded' END AS event_status, alert_raised, review_required, count(*) AS n FROM f GROUP BY 1, 2, 3""")
def decision(spark, d):
    both = C.final_decision(C.review(C.apply_rules(_compared(spark, d), C.rules_frame(spark))))
    return both.groupBy("event_status", "alert_raised", "review_required").agg(F.count("*").alias("n"))


_E1 = f"""{D.SCORES}, cl AS (SELECT unnest({D._CLS}) AS c),
cm AS (SELECT x.c AS actual, y.c AS predicted, (SELECT count(*) FROM cp WHERE cp.actual = x.c AND cp.python_class = y.c) AS n FROM cl x, cl y),
pc AS (SELECT c AS class_name, (SELECT n FROM cm WHERE actual = c AND predicted = c) AS tp, (SELECT sum(n) FROM cm WHERE actual = c) AS support,
       (SELECT sum(n) FROM cm WHERE predicted = c) AS n_predicted FROM cl),
pf AS (SELECT *, CASE WHEN n_predicted > 0 THEN tp / n_predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM pc),
pm AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pf)"""


def _labelled(spark, d):
    return _compared(spark, d).select(F.col("event_id").cast("string").alias("audio_id"), "actual", F.col("python_class").alias("predicted"))


@query("e1_confusion", f"WITH {_E1} SELECT actual, predicted, n FROM cm")
def confusion(spark, d):
    return C.confusion(_labelled(spark, d))


@query("e2_per_class", f"WITH {_E1} SELECT class_name, tp::BIGINT AS tp, support::BIGINT AS support, n_predicted::BIGINT AS n_predicted, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1 FROM pm")
def per_class(spark, d):
    return C.per_class(C.confusion(_labelled(spark, d))).select("class_name", "tp", "support", "n_predicted", *_r("precision", "recall", "f1"))


@query("e3_summary", f"""WITH {_E1} SELECT sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 4) AS accuracy, round(avg(precision), 4) AS macro_precision, round(avg(recall), 4) AS macro_recall,
  round(avg(f1), 4) AS macro_f1, round(sum(f1 * support) / sum(support), 4) AS weighted_f1, round(sum(tp) FILTER (class_name IN ({_CRIT})) / sum(support) FILTER (class_name IN ({_CRIT})), 4) AS critical_recall FROM pm""")
def summary(spark, d):
    m = C.summary(C.per_class(C.confusion(_labelled(spark, d))))
    return m.select("n", *_r("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1", "critical_recall"))


@query("e4_top2_accuracy", f"WITH {D.SCORES} SELECT count(*) AS n, round(avg((actual IN (python_class, second_class))::INT), 4) AS top2_accuracy FROM cp")
def top2(spark, d):
    c = _compared(spark, d)
    hit = F.array_contains(F.transform(F.slice("ra", 1, 2), lambda x: x.class_name), F.col("actual"))
    return c.agg(F.count("*").alias("n"), F.round(F.avg(hit.cast("int")), 4).alias("top2_accuracy"))


@query("e5_severe_errors", f"WITH {D.SCORES} SELECT event_id::VARCHAR AS audio_id, actual, python_class AS predicted, python_class NOT IN ({_CRIT}) AS silent_miss, python_class IN ({_CRIT}) AS misattributed FROM cp WHERE actual IN ({_CRIT}) AND actual <> python_class")
def severe(spark, d):
    return C.severe_errors(_labelled(spark, d)).orderBy(F.desc("silent_miss"), "audio_id")


@query("e6_floors", f"""WITH {_E1}, m AS (SELECT sum(tp) / sum(support) AS accuracy, avg(f1) AS macro_f1, sum(tp) FILTER (class_name IN ({_CRIT})) / sum(support) FILTER (class_name IN ({_CRIT})) AS critical_recall FROM pm),
v AS (SELECT 'accuracy' AS metric, accuracy AS value, 0.85::DOUBLE AS floor FROM m UNION ALL SELECT 'macro_f1', macro_f1, 0.8 FROM m UNION ALL SELECT 'critical_recall', critical_recall, 0.85 FROM m) SELECT metric, round(value, 6) AS value, floor, value >= floor - 1e-12 AS passed FROM v""")
def floors(spark, d):
    m = C.summary(C.per_class(C.confusion(_labelled(spark, d))))
    return C.check_floors(m, {"accuracy": 0.85, "macro_f1": 0.80, "critical_recall": 0.85}).withColumn("value", F.round("value", 6))


@query("e7_metrics_by_split", f"""WITH {D.SCORES}, s AS (SELECT *, CASE event_id % 10 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM cp)
SELECT split, count(*) AS n, round(avg((actual = python_class)::INT), 4) AS accuracy FROM s GROUP BY 1""")
def by_split(spark, d):
    split = F.when(F.col("event_id") % 10 == 0, "val").when(F.col("event_id") % 10 == 1, "test").otherwise("train")
    rows = _compared(spark, d).select(split.alias("split"), "actual", F.col("python_class").alias("predicted"))
    return C.summary(C.per_class(C.confusion(rows, keys=("split",)), ("split",)), ("split",)).select("split", "n", *_r("accuracy"))


@query("e8_comparison_report", f"""WITH {D.SCORES} SELECT coalesce(actual, 'all') AS class_name, count(*) AS n, round(avg(agree::INT), 4) AS agreement_rate,
  round(avg((python_class = actual)::INT), 4) AS accuracy_a, round(avg((gtm_class = actual)::INT), 4) AS accuracy_b,
  round(coalesce(avg(CASE WHEN agree THEN (python_class = actual)::INT END), 0), 4) AS accuracy_when_agreed FROM cp GROUP BY ROLLUP (actual)""")
def report(spark, d):
    c = _compared(spark, d)
    right = (F.col("python_class") == F.col("actual")).cast("int")
    return c.rollup("actual").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("agree").cast("int")), 4).alias("agreement_rate"), F.round(F.avg(right), 4).alias("accuracy_a"),
        F.round(F.avg((F.col("gtm_class") == F.col("actual")).cast("int")), 4).alias("accuracy_b"),
        F.round(F.coalesce(F.avg(F.when(F.col("agree"), right)), F.lit(0.0)), 4).alias("accuracy_when_agreed"),
    ).withColumn("class_name", F.coalesce("actual", F.lit("all"))).drop("actual")


@query("e10_true_rank", f"WITH {D.SCORES} SELECT event_id, model, rank AS true_rank FROM rk WHERE class_name = actual")
def true_rank(spark, d):
    s = D.score_vectors(spark, d)
    ranks_ = C.long_scores(s).join(s.select("event_id", "actual"), "event_id").where("class_name = actual")
    return ranks_.select("event_id", "model", F.col("rank").cast("long").alias("true_rank"))


@query("e13_calibration", f"""WITH {D.SCORES}, g AS (SELECT f.v AS floor, m.v AS margin_min, s.v AS strong, a.v AS acceptable FROM (SELECT unnest([0.3, 0.4, 0.5, 0.6]::DOUBLE[]) AS v) f,
  (SELECT unnest([0.0, 0.1, 0.2]::DOUBLE[]) AS v) m, (SELECT unnest([0.05, 0.1]::DOUBLE[]) AS v) s, (SELECT unnest([0.15, 0.25]::DOUBLE[]) AS v) a)
SELECT floor, margin_min, strong, acceptable, count(*) AS n, count(*) FILTER (ok) AS accepted, count(*) FILTER (ok AND python_class = actual) AS correct,
  CASE WHEN count(*) FILTER (ok) > 0 THEN round(count(*) FILTER (ok AND python_class = actual) / count(*) FILTER (ok), 4) ELSE 0 END AS precision
FROM (SELECT *, agree AND python_confidence >= floor AND gtm_confidence >= floor AND difference <= acceptable AND margin >= margin_min AS ok FROM cp, g) GROUP BY 1, 2, 3, 4""")
def calibration(spark, d):
    from itertools import product

    points = [tuple(map(float, p)) for p in product((0.3, 0.4, 0.5, 0.6), (0.0, 0.1, 0.2), (0.05, 0.1), (0.15, 0.25))]
    grid = spark.createDataFrame(points, "floor double, margin_min double, strong double, acceptable double")
    out = C.calibrate(_compared(spark, d), grid)
    return out.select("floor", "margin_min", "strong", "acceptable", "n", "accepted", "correct", F.round("precision", 4).alias("precision"))


@query("v12_ensemble", f"""WITH {D.SCORES}, m AS (SELECT event_id, class_name, avg(confidence) AS confidence FROM lg GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY confidence DESC, class_name DESC) AS rn FROM m) SELECT event_id, class_name AS predicted, round(confidence, 6) AS confidence FROM o WHERE rn = 1""")
def ensemble(spark, d):
    return C.ensemble(C.long_scores(D.score_vectors(spark, d))).withColumn("confidence", F.round("confidence", 6))


@query("v11_weighted_windows", f"""WITH {D.SCORES} SELECT event_id % 50 AS clip, class_name, round(sum(confidence * (event_id % 5 + 1)) / sum(event_id % 5 + 1), 6) AS score FROM lg WHERE model = 'python' GROUP BY 1, 2""")
def windows(spark, d):
    s = C.long_scores(D.score_vectors(spark, d)).where("model = 'python'").select((F.col("event_id") % 50).alias("clip"), "class_name", F.col("confidence").alias("score"), (F.col("event_id") % 5 + 1).alias("weight"))
    return C.weighted_windows(s, "clip").withColumn("score", F.round("score", 6))


@query("o6_largest_disagreements", f"WITH {D.SCORES} SELECT event_id, round(difference, 6) AS difference FROM cp WHERE NOT agree ORDER BY difference DESC, event_id LIMIT 15")
def disagreements(spark, d):
    return _compared(spark, d).where("not agree").orderBy(F.desc("difference"), "event_id").limit(15).select("event_id", F.round("difference", 6).alias("difference"))


@query("j14_score_agreement", f"""WITH {D.SCORES} SELECT count(*) AS n, round(max(x), 6) AS max_deviation, round(avg((agree)::INT), 4) AS class_match
FROM (SELECT agree, list_max(list_transform(range(1, 11), lambda i: abs(a[i] - b[i]))) AS x FROM cp JOIN sc USING (event_id))""")
def frontend(spark, d):
    v = D.score_vectors(spark, d)
    gap = F.array_max(F.zip_with("scores_a", "scores_b", lambda x, y: F.abs(x - y)))
    c = C.compare(v.withColumn("gap", gap))
    return c.agg(F.count("*").alias("n"), F.round(F.max("gap"), 6).alias("max_deviation"), F.round(F.avg(F.col("agree").cast("int")), 4).alias("class_match"))


@query("e9_report_floor", f"""WITH {D.SCORES}, c AS (SELECT 'total' AS "check", (SELECT count(*) FROM cp) AS observed, 100 AS needed UNION ALL SELECT x, (SELECT count(*) FROM cp WHERE actual = x), 10 FROM (SELECT unnest({D._CLS}) AS x))
SELECT "check", observed, needed, observed >= needed AS ok FROM c""")
def report_floor(spark, d):
    return C.report_floor(_compared(spark, d))


@query("o5_worst_classes", f"WITH {_E1} SELECT class_name, round(f1, 4) AS f1, support::BIGINT AS support FROM pm ORDER BY pm.f1, pm.support, class_name LIMIT 3")
def worst(spark, d):
    return C.worst_classes(C.per_class(C.confusion(_labelled(spark, d)))).select("class_name", *_r("f1"), "support")


def _two_models(spark, d):
    c = _compared(spark, d)
    rows = lambda name, col: c.select(F.lit(name).alias("model"), F.lit("test").alias("split"), F.col("event_id").alias("audio_id"), "actual", F.col(col).alias("predicted"))
    return rows("python", "python_class").unionByName(rows("gtm", "gtm_class"))


@query("e11_model_table", f"""WITH {D.SCORES}, m AS (SELECT 'python' AS model, actual, python_class AS predicted FROM cp UNION ALL SELECT 'gtm', actual, gtm_class FROM cp)
SELECT model, 'test' AS split, count(*) AS clips, round(avg((actual = predicted)::INT), 4) AS accuracy, round(avg((actual = predicted)::INT) FILTER (actual IN ({_CRIT})), 4) AS critical_recall FROM m GROUP BY 1""")
def model_table(spark, d):
    return C.model_table(_two_models(spark, d)).select("model", "split", "clips", *_r("accuracy", "critical_recall"))


@query("e11_comparable", f"""WITH {D.SCORES}, m AS (SELECT 'same' AS "set", 'python' AS model, event_id FROM cp UNION ALL SELECT 'same', 'gtm', event_id FROM cp
UNION ALL SELECT 'fewer', 'python', event_id FROM cp UNION ALL SELECT 'fewer', 'gtm', event_id FROM cp WHERE event_id % 2 = 0 UNION ALL SELECT 'other', 'python', event_id FROM cp UNION ALL SELECT 'other', 'gtm', event_id + 1 FROM cp),
t AS (SELECT "set", model, count(*) AS clips, list(event_id ORDER BY event_id) AS ids FROM m GROUP BY 1, 2)
SELECT "set", count(*) AS models, count(DISTINCT ids) = 1 AS ok, CASE WHEN count(DISTINCT clips) > 1 THEN 'row counts differ' WHEN count(DISTINCT ids) > 1 THEN 'clips differ' ELSE '' END AS reason FROM t GROUP BY 1""")
def models_comparable(spark, d):
    """Two models on the same clips, one of them on half of them, and one on as many others."""
    r = _two_models(spark, d)
    gtm = F.col("model") == "gtm"
    sets = {"same": r, "fewer": r.where(~gtm | (F.col("audio_id") % 2 == 0)), "other": r.withColumn("audio_id", F.col("audio_id") + gtm.cast("int"))}
    out = None
    for name, rows in sets.items():
        one = C.comparable(C.model_table(rows)).withColumn("set", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("e14_agreement_figures", f"""WITH {D.SCORES} SELECT count(*) AS n, round(avg((python_class = actual)::INT), 4) AS python_accuracy, round(avg((gtm_class = actual)::INT), 4) AS gtm_accuracy, round(avg(agree::INT), 4) AS agreement_rate,
  round(coalesce(avg((python_class = actual)::INT) FILTER (agree), 0), 4) AS accuracy_when_models_agree FROM cp""")
def agreement_figures(spark, d):
    return C.agreement_figures(_compared(spark, d))


@query("a30_robustness", f"""WITH {D.SCORES}, r AS (SELECT *, ['clean', 'noise', 'far', 'clipped'][event_id % 4 + 1] AS condition, event_id % 11 = 0 AS rejected, status IN ('Model Disagreement', 'Uncertain Result') AS review FROM cp)
SELECT condition, count(*) AS clips, count(*) FILTER (rejected) AS rejected, round(count(*) FILTER (NOT rejected AND python_class = actual) / count(*), 4) AS python_accuracy, round(count(*) FILTER (NOT rejected AND gtm_class = actual) / count(*), 4) AS gtm_accuracy,
  count(*) FILTER (NOT rejected AND review) AS reviewed, round(avg((python_class = actual)::INT) FILTER (NOT rejected AND actual IN ({_CRIT})), 4) AS critical_recall FROM r GROUP BY 1""")
def robustness(spark, d):
    name = F.element_at(F.array(*[F.lit(x) for x in ("clean", "noise", "far", "clipped")]), (F.col("event_id") % 4 + 1).cast("int"))
    rows = _compared(spark, d).select(name.alias("condition"), "actual", (F.col("event_id") % 11 == 0).alias("rejected"), "python_class", "gtm_class", F.col("status").isin("Model Disagreement", "Uncertain Result").alias("review_required"))
    return C.robustness(rows).select("condition", "clips", "rejected", *_r("python_accuracy", "gtm_accuracy"), "reviewed", *_r("critical_recall"))


@query("x7_score_sums", f"WITH {D.SCORES} SELECT event_id, round(list_sum(a), 6) AS total_a, round(list_max(b), 6) AS top_b FROM sc")
def score_sums(spark, d):
    v = D.score_vectors(spark, d)
    return v.select("event_id", F.round(F.aggregate("scores_a", F.lit(0.0), lambda a, x: a + x), 6).alias("total_a"), F.round(F.array_max("scores_b"), 6).alias("top_b"))


@query("j13_aligned_models", f"WITH {D.SCORES} SELECT event_id, python_class, gtm_class FROM cp")
def aligned(spark, d):
    c = _compared(spark, d)
    return C.align(c.select("event_id", "python_class"), c.select("event_id", "gtm_class"), "event_id")
