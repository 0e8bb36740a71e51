"""Comparing two models' scores, rules, review, and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotable.functions import scores as S
from echotable.functions.config import CLASSES, CRITICAL_CLASSES, REVIEW_CONDITIONS, THRESHOLDS, effective_rules


def compare(vectors: DataFrame, classes=CLASSES, thresholds=THRESHOLDS) -> DataFrame:
    """Both predictions of each event, their margin, difference, status and overlap.

    ``vectors`` holds ``scores_a`` and ``scores_b`` in the order of ``classes``; other columns stay.
    """
    r = vectors.withColumn("ra", S.ranked(S.named(F.col("scores_a"), classes))).withColumn("rb", S.ranked(S.named(F.col("scores_b"), classes)))
    a, b = F.get("ra", F.lit(0)), F.get("rb", F.lit(0))
    r = r.select(
        *[c for c in vectors.columns if c not in ("scores_a", "scores_b")], "ra", "rb",
        a.class_name.alias("python_class"), a.confidence.alias("python_confidence"), b.class_name.alias("gtm_class"), b.confidence.alias("gtm_confidence"),
        S.top_two_margin(F.col("ra")).alias("margin"), F.get("ra", F.lit(1)).class_name.alias("second_class"), F.get("ra", F.lit(1)).confidence.alias("second_confidence"),
    )
    agree = F.col("python_class") == F.col("gtm_class")
    status = S.consistency_status(F.col("python_class"), F.col("python_confidence"), F.col("gtm_class"), F.col("gtm_confidence"), thresholds)
    overlap = agree & (F.round("second_confidence", 6) >= thresholds["confidence"]["overlap_secondary_confidence"])
    return r.withColumns({"agree": agree, "difference": F.abs(F.col("python_confidence") - F.col("gtm_confidence")), "status": status, "overlapping": F.coalesce(overlap, F.lit(False))})


def long_scores(vectors: DataFrame, key: str = "event_id", classes=CLASSES) -> DataFrame:
    """One row per (event, model, class) with its rank; equal scores are ranked by name. No shuffle."""
    parts = []
    for model, col in (("python", "scores_a"), ("gtm", "scores_b")):
        pairs = vectors.select(key, F.lit(model).alias("model"), F.posexplode(S.ranked(S.named(F.col(col), classes))).alias("at", "p"))
        parts.append(pairs.select(key, "model", F.col("p.class_name").alias("class_name"), F.col("p.confidence").alias("confidence"), (F.col("at") + 1).alias("rank"), (F.col("at") == 0).alias("is_top")))
    return parts[0].unionByName(parts[1])


def rank_scores(scores: DataFrame, key: str = "event_id", model: str = "model") -> DataFrame:
    """The same ranking for scores that arrive one row per class."""
    order = Window.partitionBy(key, model).orderBy(F.desc("confidence"), "class_name")
    return scores.withColumn("rank", F.row_number().over(order)).withColumn("is_top", F.col("rank") == 1)


def align(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two models' rows by key; keys of only one side are an error raised when the rows are read."""
    x, y = a.withColumn("_a", F.lit(True)), b.withColumn("_b", F.lit(True))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    fault = F.raise_error(F.concat(F.lit("unaligned key "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")
    return x.join(y, key, "full").where(F.when(both, F.lit(True)).otherwise(fault)).drop("_a", "_b")


def rules_frame(spark, rules: list[dict] | None = None) -> DataFrame:
    """The effective rules as a table: one row per class."""
    rules = effective_rules() if rules is None else rules
    esc = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (
        ("id", T.StringType()), ("confidence_gte", T.DoubleType()), ("consecutive_gte", T.LongType()), ("noise_level_dbfs_gte", T.DoubleType()),
        ("repeats_within_window_gte", T.LongType()), ("sustained_seconds_gte", T.LongType()), ("to_severity", T.StringType()))]))
    schema = T.StructType([T.StructField(n, t) for n, t in (
        ("rule_class", T.StringType()), ("severity", T.StringType()), ("enabled", T.BooleanType()), ("min_confidence", T.DoubleType()), ("min_margin", T.DoubleType()),
        ("needs_agreement", T.BooleanType()), ("min_quality", T.StringType()), ("min_alert_severity", T.StringType()), ("noise_limit", T.DoubleType()), ("escalation", esc))])
    number = lambda v: None if v is None else float(v)
    rows = []
    for r in rules:
        steps = [(e.get("id"), number(e.get("confidence_gte")), e.get("consecutive_gte"), number(e.get("noise_level_dbfs_gte")), e.get("repeats_within_window_gte"), e.get("sustained_seconds_gte"), e.get("to_severity")) for e in r["escalation"]]
        rows.append((r["class"], r["severity"], r["enabled"], number(r["min_confidence"]), number(r["min_top_two_margin"]), r["requires_model_agreement"], r["min_audio_quality"], r["min_alert_severity"], number(r["noise_level_dbfs_limit"]), steps))
    return spark.createDataFrame(rows, schema)


def apply_rules(events: DataFrame, rules: DataFrame, class_col: str = "python_class", with_repeats: bool = False) -> DataFrame:
    """Severity and alert gates of each event by the rule of its class.

    Needs ``python_confidence, margin, agree, quality``; ``consecutive``, ``noise_level_dbfs``, and with
    ``with_repeats`` also ``repeats`` and ``sustained_seconds``, count where present. An event whose
    class has no rule is an error. The first escalation whose every condition holds sets the severity;
    without ``with_repeats`` those on repeats and duration never hold.
    """
    have = set(events.columns)
    seen = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    e = events.join(F.broadcast(rules), F.col(class_col) == F.col("rule_class"), "left")
    noise, steps = seen("noise_level_dbfs", "double"), seen("consecutive", "long")
    repeats, lasted = (seen("repeats", "long"), seen("sustained_seconds", "double")) if with_repeats else (F.lit(None).cast("long"), F.lit(None).cast("double"))

    def holds(x: Column) -> Column:
        tests = [(x.confidence_gte, F.col("python_confidence")), (x.consecutive_gte, steps), (x.noise_level_dbfs_gte, noise), (x.repeats_within_window_gte, repeats), (x.sustained_seconds_gte, lasted)]
        return reduce(lambda p, q: p & q, [want.isNull() | F.coalesce(got >= want, F.lit(False)) for want, got in tests])

    first = F.get(F.filter("escalation", holds), F.lit(0))
    severity = F.coalesce(first.to_severity, F.col("severity"))
    gates = {
        "min_confidence": F.col("min_confidence").isNull() | (F.col("python_confidence") >= F.col("min_confidence")),
        "min_top_two_margin": F.col("min_margin").isNull() | (F.col("margin") >= F.col("min_margin")),
        "requires_model_agreement": ~F.coalesce("needs_agreement", F.lit(False)) | F.col("agree"),
        "min_audio_quality": F.col("min_quality").isNull() | S.quality_at_least(F.col("quality"), F.col("min_quality")),
        "enabled": F.coalesce("enabled", F.lit(True)),
        "noise_level_dbfs": F.col("noise_limit").isNull() | F.coalesce(noise >= F.col("noise_limit"), F.lit(False)),
        "min_alert_severity": F.col("min_alert_severity").isNull() | (S.severity_rank(severity) >= S.severity_rank(F.col("min_alert_severity"))),
    }
    gate = F.array(*[F.struct(F.lit(n).alias("gate"), F.coalesce(ok, F.lit(False)).alias("passed")) for n, ok in gates.items()])
    known = F.when(F.col("rule_class").isNull(), F.raise_error(F.concat(F.lit("no rule for class "), F.coalesce(F.col(class_col), F.lit("null")))).cast("string")).otherwise(severity)
    out = e.withColumns({"event_severity": known, "escalation_id": first.id, "gates": gate})
    out = out.withColumn("alert_eligible", F.forall("gates", lambda g: g.passed)).withColumn("failed_gates", F.array_join(F.transform(F.filter("gates", lambda g: ~g.passed), lambda g: g.gate), ","))
    return out.select(*events.columns, "event_severity", "escalation_id", "alert_eligible", "failed_gates")


def with_rule(events: DataFrame, rules: DataFrame, class_col: str = "python_class") -> DataFrame:
    """``events`` with the effective rule of their class as a struct ``rule``; a class without one is an error."""
    named = rules.select(F.col("rule_class"), F.struct(*[c for c in rules.columns if c != "rule_class"]).alias("rule"))
    fault = F.raise_error(F.concat(F.lit("no rule for class "), F.coalesce(F.col(class_col), F.lit("null"))))
    j = events.join(F.broadcast(named), F.col(class_col) == F.col("rule_class"), "left")
    return j.withColumn("rule", F.when(F.col("rule_class").isNull(), fault.cast(named.schema["rule"].dataType)).otherwise(F.col("rule"))).drop("rule_class")


def review(events: DataFrame, conditions=REVIEW_CONDITIONS, thresholds=THRESHOLDS, classes=CLASSES, critical=CRITICAL_CLASSES) -> DataFrame:
    """``review_ids``, ``review_priority`` and ``review_required`` of compared events."""
    floor = thresholds["confidence"]["min_confidence"]
    cols = {
        "python_confidence": F.col("python_confidence"), "gtm_confidence": F.col("gtm_confidence"), "models_agree": F.col("agree"), "overlapping": F.col("overlapping"),
        "unknown_class": ~F.col("python_class").isin(*classes), "class_is_critical": F.col("python_class").isin(*critical), "top_two_margin": F.col("margin"),
        "below_min_confidence_on_both": (F.col("python_confidence") < floor) & (F.col("gtm_confidence") < floor), "confidence_difference": F.col("difference"),
        "quality": F.col("quality"), "consistency_status": F.col("status"),
    }
    found = events.withColumn("_m", S.review_matches(conditions, cols, thresholds))
    return found.select(
        *events.columns, F.array_join(F.transform("_m", lambda m: m.id), ",").alias("review_ids"), S.top_priority(F.col("_m")).alias("review_priority"), (F.size("_m") > 0).alias("review_required"),
    )


def final_decision(events: DataFrame) -> DataFrame:
    """Event status from alert, review and confirmation."""
    raised = F.col("alert_eligible") & ~F.col("status").isin("Model Disagreement", "Uncertain Result")
    status = F.when(raised, "Alert Raised").when(F.col("review_required"), "Manual Review").otherwise("Recorded")
    return events.withColumn("alert_raised", raised).withColumn("event_status", status)


def confusion(rows: DataFrame, labels=CLASSES, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(*keys, actual, predicted, n)`` in label order, zero cells kept; an unknown label is an error."""
    known = F.array(*[F.lit(x) for x in labels])
    checked = rows.withColumn("actual", F.when(F.array_contains(known, F.col("actual")), F.col("actual")).otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.coalesce("actual", F.lit("null")))).cast("string")))
    checked = checked.withColumn("predicted", F.when(F.array_contains(known, F.col("predicted")), F.col("predicted")).otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.coalesce("predicted", F.lit("null")))).cast("string")))
    counts = checked.groupBy(*keys, "actual", "predicted").agg(F.count("*").alias("n"))
    spark = rows.sparkSession
    names = spark.createDataFrame([(x,) for x in labels], "name string")
    cells = names.toDF("actual").crossJoin(F.broadcast(names.toDF("predicted")))  # labels by labels
    if keys:
        cells = F.broadcast(cells).crossJoin(counts.select(*keys).distinct())
    return cells.join(counts, [*keys, "actual", "predicted"], "left").select(*keys, "actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_class(matrix: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1, support and predicted count by class; 0 where undefined."""
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    rows = matrix.groupBy(*keys, F.col("actual").alias("class_name")).agg(hit.alias("tp"), F.sum("n").alias("support"))
    cols = matrix.groupBy(*keys, F.col("predicted").alias("class_name")).agg(F.sum("n").alias("n_predicted"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = rows.join(cols, [*keys, "class_name"])
    out = out.withColumn("precision", safe(F.col("tp"), F.col("n_predicted"))).withColumn("recall", safe(F.col("tp"), F.col("support")))
    total = F.col("precision") + F.col("recall")
    return out.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), total))


def summary(classes: DataFrame, keys: tuple[str, ...] = (), critical=CRITICAL_CLASSES) -> DataFrame:
    """Accuracy, macro and weighted means over all classes, and critical recall."""
    is_critical = F.col("class_name").isin(*critical)
    return classes.groupBy(*keys).agg(
        F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        (F.sum(F.when(is_critical, F.col("tp"))) / F.sum(F.when(is_critical, F.col("support")))).alias("critical_recall"),
    )


def severe_errors(rows: DataFrame, critical=CRITICAL_CLASSES) -> DataFrame:
    """Critical events that were missed: silently, or under another critical name."""
    wrong = rows.where(F.col("actual").isin(*critical) & (F.col("actual") != F.col("predicted")))
    silent = ~F.col("predicted").isin(*critical)
    return wrong.withColumn("silent_miss", silent).withColumn("misattributed", ~silent)


def check_floors(metrics: DataFrame, floors: dict[str, float], tolerance: float = 1e-12) -> DataFrame:
    """``(metric, value, floor, passed)``; a metric without a floor is skipped."""
    wide = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(f)).alias("floor")) for m, f in floors.items()]))
    return metrics.select(wide.alias("x")).select("x.*").withColumn("passed", F.coalesce(F.col("value") >= F.col("floor") - tolerance, F.lit(False)))


def reportable(rows: DataFrame, split: str = "test") -> DataFrame:
    """One row: rows of another split and augmented ones, with up to five examples of each."""
    other, augmented = F.col("split") != split, F.col("role") != "original"
    near = rows.where(other | augmented)
    bad = near.agg(F.count_if(other).alias("wrong_split"), F.count_if(augmented).alias("augmented"))
    first = lambda c: near.where(c).select("audio_id").distinct().orderBy("audio_id").limit(5).agg(F.array_join(F.array_sort(F.collect_list("audio_id")), ",").alias("e"))
    return bad.crossJoin(first(other).withColumnRenamed("e", "wrong_examples")).crossJoin(first(augmented).withColumnRenamed("e", "augmented_examples")).withColumn("ok", (F.col("wrong_split") == 0) & (F.col("augmented") == 0))


def calibrate(vectors: DataFrame, grid: DataFrame, critical=CRITICAL_CLASSES, target: float = 0.97) -> DataFrame:
    """Accepted share, precision and critical precision of each threshold point.

    ``grid`` holds ``floor, margin_min, strong, acceptable``: a fixed list. A clip is accepted where its
    models agree well enough at the point and its margin is wide enough. ``eligible`` points reach the
    target precision. Clips are first counted by the thresholds that they pass, so only those counts,
    whose number the grid bounds, are crossed with its points.
    """
    points = [tuple(float(x) for x in p) for p in grid.select("floor", "margin_min", "strong", "acceptable").collect()]
    floors, margins = sorted({p[0] for p in points}), sorted({p[1] for p in points})
    gaps = sorted({x for p in points for x in p[2:]})
    passed = lambda value, cuts: reduce(lambda a, b: a + b, [F.when(value >= c, 1).otherwise(0) for c in cuts])
    beyond = reduce(lambda a, b: a + b, [F.when(F.col("difference") > c, 1).otherwise(0) for c in gaps])
    right = F.col("python_class") == F.col("actual")
    binned = vectors.select(
        passed(F.least("python_confidence", "gtm_confidence"), floors).alias("f"), passed(F.col("margin"), margins).alias("m"),
        F.when(F.col("difference").isNull(), len(gaps)).otherwise(beyond).alias("d"), "agree", right.alias("right"), F.col("python_class").isin(*critical).alias("danger"),
        (F.col("python_confidence").isNull() | F.col("gtm_confidence").isNull()).alias("unknown"),
    )
    binned = binned.groupBy("f", "m", "d", "agree", "right", "danger", "unknown").agg(F.count("*").alias("clips"))
    places = [(*p, floors.index(p[0]), margins.index(p[1]), gaps.index(p[2]), gaps.index(p[3])) for p in points]
    numbered = vectors.sparkSession.createDataFrame(places, "floor double, margin_min double, strong double, acceptable double, pf int, pm int, ps int, pa int")
    g = binned.crossJoin(F.broadcast(numbered))  # counts by points, both bounded by the grid
    sure = ~F.col("unknown") & (F.col("f") > F.col("pf"))
    accepted = F.col("agree") & sure & (F.col("d") <= F.col("pa")) & (F.col("m") > F.col("pm"))
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("clips"))), F.lit(0))
    out = g.groupBy("floor", "margin_min", "strong", "acceptable").agg(
        F.sum("clips").alias("n"), total(accepted).alias("accepted"), total(accepted & F.col("right")).alias("correct"),
        total(accepted & F.col("danger")).alias("critical"), total(accepted & F.col("danger") & F.col("right")).alias("critical_correct"),
        total(F.col("agree") & sure & (F.col("d") <= F.col("ps"))).alias("strong_matches"),
    )
    safe = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = out.withColumns({"accepted_share": safe("accepted", "n"), "precision": safe("correct", "accepted"), "critical_precision": safe("critical_correct", "critical")})
    return out.withColumn("eligible", F.col("precision") >= target)


def ensemble(scores: DataFrame, key: str = "event_id") -> DataFrame:
    """Unweighted mean of the members' probabilities by class, and its prediction."""
    mean = scores.groupBy(key, "class_name").agg(F.avg("confidence").alias("confidence"))
    return mean.groupBy(key).agg(F.max(F.struct("confidence", "class_name")).alias("m")).select(key, F.col("m.class_name").alias("predicted"), F.col("m.confidence").alias("confidence"))


def weighted_windows(windows: DataFrame, key: str, how: str = "arithmetic") -> DataFrame:
    """Energy-weighted mean of window scores by class: arithmetic, or of logarithms."""
    w = F.col("weight")
    if how == "log":
        value = F.exp(F.sum(w * F.ln(F.greatest("score", F.lit(1e-9)))) / F.sum(w))
    else:
        value = F.sum(F.col("score") * w) / F.sum(w)
    return windows.groupBy(key, "class_name").agg(value.alias("score"))


def report_floor(rows: DataFrame, classes=CLASSES, least: int = 100, least_per_class: int = 10, class_col: str = "actual") -> DataFrame:
    """``(check, observed, needed, ok)``: the report's clips in all (``total``) and of each class, absent ones too."""
    spark = rows.sparkSession
    counts = rows.groupBy(F.col(class_col).alias("check")).agg(F.count("*").alias("observed"))
    each = F.broadcast(spark.createDataFrame([(c,) for c in classes], "check string")).join(counts, "check", "left").select("check", F.coalesce("observed", F.lit(0)).cast("long").alias("observed"), F.lit(least_per_class).alias("needed"))
    total = rows.agg(F.lit("total").alias("check"), F.count("*").alias("observed"), F.lit(least).alias("needed"))
    return total.unionByName(each).withColumn("ok", F.col("observed") >= F.col("needed"))


def worst_classes(classes: DataFrame, n: int = 3) -> DataFrame:
    """The classes of lowest F1, smaller support first among equals, then by name."""
    return classes.orderBy("f1", "support", "class_name").limit(n)


def model_table(rows: DataFrame, classes=CLASSES, critical=CRITICAL_CLASSES) -> DataFrame:
    """One row per model of ``(model, split, audio_id, actual, predicted)``: its metrics, its splits and its worst class."""
    by = ("model",)
    counted = rows.groupBy("model").agg(F.count_distinct("audio_id").alias("clips"), F.array_join(F.array_sort(F.collect_set("split")), ",").alias("split"), F.bit_xor(F.xxhash64("audio_id", "actual")).alias("clip_set"))
    each = per_class(confusion(rows.select("model", "actual", "predicted"), classes, by), by)
    worst = each.groupBy("model").agg(F.min_by("class_name", F.struct("f1", "support", "class_name")).alias("worst_class"))
    return summary(each, by, critical).join(worst, "model").join(counted, "model")


def comparable(table: DataFrame, split: str = "test") -> DataFrame:
    """One row on a model table: whether all models were scored on one split and on the same clips, and why not."""
    one = table.agg(F.count("*").alias("models"), F.count_if(F.col("split") != split).alias("other_split"), F.count_distinct("clips").alias("sizes"), F.count_distinct("clip_set").alias("sets"))
    reason = F.when(F.col("models") == 0, "nothing to compare").when(F.col("other_split") > 0, "other split").when(F.col("sizes") > 1, "row counts differ").when(F.col("sets") > 1, "clips differ")
    return one.select("models", reason.isNull().alias("ok"), F.coalesce(reason, F.lit("")).alias("reason"))


def agreement_figures(compared: DataFrame) -> DataFrame:
    """One row: clips, accuracy of both models, how often they agree, and the accuracy where they do."""
    right_a, right_b = (F.col(c) == F.col("actual") for c in ("python_class", "gtm_class"))
    same = F.col("python_class") == F.col("gtm_class")
    share = lambda x: F.round(F.coalesce(F.avg(x.cast("int")), F.lit(0.0)), 4)
    return compared.agg(
        F.count("*").alias("n"), share(right_a).alias("python_accuracy"), share(right_b).alias("gtm_accuracy"), share(same).alias("agreement_rate"),
        F.round(F.coalesce(F.avg(F.when(same, right_a.cast("int"))), F.lit(0.0)), 4).alias("accuracy_when_models_agree"),
    )


def robustness(rows: DataFrame, critical=CRITICAL_CLASSES) -> DataFrame:
    """Per condition: clips, rejected ones, accuracy of both models over all clips, critical recall and reviews.

    ``rows``: condition, actual, rejected, python_class, gtm_class, review_required. A rejected clip
    counts as wrong; critical recall is over the clips that were not rejected, null without any.
    """
    heard = ~F.col("rejected")
    right = lambda c: heard & (F.col(c) == F.col("actual"))
    danger = heard & F.col("actual").isin(*critical)
    g = rows.groupBy("condition").agg(
        F.count("*").alias("clips"), F.count_if("rejected").alias("rejected"), (F.count_if(right("python_class")) / F.count("*")).alias("python_accuracy"),
        (F.count_if(right("gtm_class")) / F.count("*")).alias("gtm_accuracy"), F.count_if(danger).alias("danger"), F.count_if(danger & right("python_class")).alias("caught"),
        F.count_if(heard & F.col("review_required")).alias("reviewed"),
    )
    return g.withColumn("critical_recall", F.when(F.col("danger") > 0, F.col("caught") / F.col("danger"))).drop("danger", "caught")
