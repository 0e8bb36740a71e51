"""Review decisions: what each requested action does to its review, and what a decided review does to its event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotable.functions.config import CLASSES, SEVERITIES

DECISIONS = ("confirm", "override", "reject")


def _text(c: str) -> Column:
    return F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))


def _fault(classes, severities) -> Column:
    """Why a request can't be applied, whatever its review's state; null for a good one."""
    decision, unknown = F.lower(_text("decision")), lambda c, known: _text(c).isNotNull() & ~_text(c).isin(*known)
    override = decision == "override"
    return (
        F.when(decision.isNull() | ~decision.isin(*DECISIONS), "unknown_decision").when(decision.isin("override", "reject") & _text("comments").isNull(), "comments_required")
        .when(override & _text("final_class").isNull(), "final_class_required").when(override & unknown("final_class", classes), "unknown_class").when(unknown("final_severity", severities), "unknown_severity")
    )


def apply_decisions(actions: DataFrame, reviews: DataFrame, at: str = "at", tie: str = "action_id", classes=CLASSES, severities=SEVERITIES) -> DataFrame:
    """``actions`` with ``error``: the first good request for an open review is applied (null), later ones are refused.

    ``actions``: review_id, decision, comments, final_class, final_severity, false_alarm; ``reviews``: review_id, status. A request
    for no known review, or for one that was decided before, is refused as well.
    """
    asked = actions.withColumn("_fault", _fault(classes, severities)).join(reviews.select("review_id", (F.col("status") == "Reviewed").alias("_done")), "review_id", "left")
    good = F.col("_fault").isNull() & ~F.coalesce("_done", F.lit(True))
    first = asked.where(good).groupBy("review_id").agg(F.min(F.struct(at, tie)).alias("_first"))
    won = F.coalesce(F.struct(at, tie) == F.col("_first"), F.lit(False))
    error = F.when(F.col("_done").isNull(), "no_such_review").otherwise(
        F.coalesce(F.when(F.col("_done") | (F.struct(at, tie) > F.col("_first")), "already_decided"), "_fault", F.when(~won, "already_decided"))
    )
    return asked.join(first, "review_id", "left").withColumn("error", error).select(*actions.columns, "error")


def decided(reviews: DataFrame, applied: DataFrame) -> DataFrame:
    """``reviews`` with the outcome of the requests that were applied.

    Needs ``review_id, status, original_class``. Confirming keeps the models' class, a rejected event was none and counts as a
    false alarm, an override has its own class. Open reviews keep their status, the rest is null.
    """
    own = applied.where("error is null").select("review_id", F.lower(_text("decision")).alias("decision"), _text("final_class").alias("_class"), _text("final_severity").alias("final_severity"), _text("comments").alias("comments"), F.coalesce("false_alarm", F.lit(False)).alias("_alarm"))
    rows = reviews.drop("decision", "final_class", "final_severity", "comments", "false_alarm").join(own, "review_id", "left")
    made = F.col("decision").isNotNull()
    final = F.when(F.col("decision") == "confirm", F.col("original_class")).otherwise(F.col("_class"))
    return rows.withColumns({"status": F.when(made, "Reviewed").otherwise(F.col("status")), "final_class": final, "false_alarm": F.when(made, (F.col("decision") == "reject") | F.col("_alarm"))}).drop("_class", "_alarm")


def cleared(events: DataFrame, reviews: DataFrame) -> DataFrame:
    """``events`` whose ``requires_manual_review`` is taken back where a review of theirs is decided."""
    done = reviews.where("status = 'Reviewed'").select("event_id", F.lit(True).alias("_done")).distinct()
    flag = F.col("requires_manual_review") & F.col("_done").isNull()
    return events.join(done, "event_id", "left").withColumn("requires_manual_review", flag).drop("_done")
