"""Score vectors, consistency of two predictions, and review predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from echotable.functions.config import CRITICAL_CLASSES, PRIORITIES, QUALITIES, SEVERITIES, THRESHOLDS, resolve


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once per row, however often it is used inside lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def rank_of(value: Column, order: tuple[str, ...]) -> Column:
    """Place of a value in a fixed order, from 0; -1 where it isn't in it."""
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), value), F.lit(0)) - 1


def severity_rank(value: Column) -> Column:
    return rank_of(value, SEVERITIES)


def quality_at_least(value: Column, floor: Column) -> Column:
    """Unknown quality names never reach a floor."""
    have, need = rank_of(value, QUALITIES), rank_of(floor, QUALITIES)
    return F.coalesce((have >= 0) & (need >= 0) & (have >= need), F.lit(False))


def normalise(scores: Column) -> Column:
    """Scores that are NaN, infinite, null or negative as 0, the rest summing to 1; all zero: uniform."""
    clean = F.transform(scores, lambda x: F.when(x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf")), F.lit(0.0)).otherwise(x.cast("double")))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return let(clean, lambda c: let(total(c), lambda t: F.when(t > 0, F.transform(c, lambda x: x / t)).otherwise(F.transform(c, lambda _: 1.0 / F.size(c)))))


def named(scores: Column, names: list[str] | tuple[str, ...]) -> Column:
    """Array of (confidence, class) of a score vector."""
    return F.zip_with(scores, F.array(*[F.lit(n) for n in names]), lambda v, n: F.struct(v.alias("confidence"), n.alias("class_name")))


def predicted(pairs: Column) -> Column:
    """The largest (confidence, class)."""
    return F.array_max(pairs)


def ranked(pairs: Column) -> Column:
    """Pairs by falling confidence, equal ones by name."""
    keyed = F.array_sort(F.transform(pairs, lambda p: F.struct((-p.confidence).alias("less"), p.class_name.alias("class_name"), p.confidence.alias("confidence"))))
    return F.transform(keyed, lambda p: F.struct(p.class_name.alias("class_name"), p.confidence.alias("confidence")))


def top_two_margin(ranked_pairs: Column) -> Column:
    return F.coalesce(F.get(ranked_pairs, F.lit(0)).confidence - F.coalesce(F.get(ranked_pairs, F.lit(1)).confidence, F.lit(0.0)), F.lit(0.0))


def consistency_status(class_a: Column, conf_a: Column, class_b: Column, conf_b: Column, thresholds=THRESHOLDS) -> Column:
    """One of the five statuses of two independent predictions.

    Neither sure, or agreeing with the first unsure: uncertain. Different classes: disagreement.
    Agreeing with only the second unsure: weak. Else graded by the difference, where two confident
    models count as acceptable whatever it is.
    """
    floor = thresholds["confidence"]["min_confidence"]
    bands = thresholds["consistency"]
    sure = max(bands.get("confident_agreement_min", 1.01), floor)
    gap = F.abs(conf_a - conf_b)
    return (
        F.when((conf_a < floor) & (conf_b < floor), "Uncertain Result")
        .when(class_a != class_b, "Model Disagreement")
        .when(conf_a < floor, "Uncertain Result")
        .when(conf_b < floor, "Weak Match")
        .when(gap <= bands["strong_match_max_diff"], "Strong Match")
        .when((gap <= bands["acceptable_match_max_diff"]) | (F.least(conf_a, conf_b) >= sure), "Acceptable Match")
        .otherwise("Weak Match")
    )


def review_reasons(status: Column, conf_a: Column, conf_b: Column, overlapping: Column, thresholds=THRESHOLDS) -> Column:
    """Short reasons for a manual look, joined; empty where none applies."""
    band = thresholds["confidence"]["low_confidence_band"]
    found = F.array(
        F.when(status.isin("Model Disagreement", "Uncertain Result"), status),
        F.when(status == "Weak Match", "Weak model agreement"),
        F.when(conf_a < band, "Low Python confidence"),
        F.when(conf_b < band, "Low GTM confidence"),
        F.when(overlapping, "Possible overlapping sounds"),
    )
    return F.array_join(F.array_compact(found), "; ")


def predicate(when: dict, cols: dict[str, Column]) -> Column:
    """A condition tree over a fixed set of keys as one boolean column; an unknown key is an error."""
    out = F.lit(True)
    for key, want in when.items():
        if key in ("any", "all"):
            parts = [predicate(sub, cols) for sub in want]
            term = F.lit(key == "all")
            for p in parts:
                term = (term & p) if key == "all" else (term | p)
        elif key in ("models_agree", "overlapping", "unknown_class", "below_min_confidence_on_both", "class_is_critical"):
            term = cols[key] == F.lit(bool(want))
        elif key == "any_model_confidence_lt":
            term = (cols["python_confidence"] < want) | (cols["gtm_confidence"] < want)
        elif key == "top_two_margin_lt":
            term = cols["top_two_margin"] < want
        elif key == "confidence_difference_gt":
            term = cols["confidence_difference"] > want
        elif key in ("quality_in", "consistency_status_in"):
            term = cols[key.removesuffix("_in")].isin(list(want))
        else:
            raise ValueError(f"unknown review condition {key!r}")
        out = out & F.coalesce(term, F.lit(False))
    return out


def review_matches(conditions, cols: dict[str, Column], thresholds=THRESHOLDS) -> Column:
    """Array of (id, priority) of every condition that holds, in file order."""
    found = [
        F.when(predicate(resolve(when, thresholds), cols), F.struct(F.lit(i).alias("id"), F.lit(p).alias("priority")))
        for i, p, when in conditions
    ]
    return F.array_compact(F.array(*found))


def top_priority(matches: Column) -> Column:
    """Highest priority among matches; null where there are none."""
    best = F.array_max(F.transform(matches, lambda m: rank_of(m.priority, PRIORITIES)))
    return F.get(F.array(*[F.lit(p) for p in PRIORITIES]), best.cast("int"))


def is_critical(class_name: Column, critical=CRITICAL_CLASSES) -> Column:
    return class_name.isin(list(critical))


def csv_safe(cell: Column) -> Column:
    """A cell that a spreadsheet won't read as a formula."""
    return F.when(F.ltrim(cell).rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def iso_utc(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def from_iso(text: Column) -> Column:
    """The moment of an ISO-8601 text; one without a zone is UTC, whatever the session's zone. Null for another form."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))))


def order_key(salt: Column | str, value: Column) -> Column:
    """Hash order that any engine reproduces."""
    return F.sha2(F.concat_ws("|", F.lit(salt) if isinstance(salt, str) else salt, value.cast("string")), 256)


def hash_seed(value: Column) -> Column:
    """First eight hex digits of a SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(value, 256), 1, 8), 16, 10).cast("long")
