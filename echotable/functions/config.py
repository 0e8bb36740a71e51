"""Fixed values of the rule files: classes, severities, thresholds, class rules, review conditions."""

from __future__ import annotations

# Names and numbers of the rule files, in their order.
CLASSES = (
    "Machinery Fault", "Glass Breaking", "Alarm or Siren", "Vehicle Horn", "Animal Sound",
    "Gunshot", "Panic Scream", "Aggression", "Person Asking for Help", "Background Noise",
)
CRITICAL_CLASSES = ("Gunshot", "Glass Breaking", "Panic Scream", "Aggression", "Person Asking for Help")
CLASS_CODES = {"Machinery Fault": "MAC", "Glass Breaking": "GLA", "Alarm or Siren": "ALM", "Vehicle Horn": "HOR", "Animal Sound": "ANI", "Gunshot": "GUN", "Panic Scream": "SCR"}
QUALITIES = ("Unusable", "Poor", "Acceptable", "Good")
SEVERITIES = ("Informational", "Low", "Medium", "High", "Critical")
STATUSES = ("Strong Match", "Acceptable Match", "Weak Match", "Model Disagreement", "Uncertain Result")
PRIORITIES = ("low", "normal", "high", "critical")

THRESHOLDS = {
    "confidence": {"min_confidence": 0.4, "low_confidence_band": 0.4, "top_two_margin_min": 0.2, "overlap_secondary_confidence": 0.25},
    "consistency": {"strong_match_max_diff": 0.05, "acceptable_match_max_diff": 0.15, "weak_match_max_diff": 0.3, "confident_agreement_min": 0.5},
    "repeat_detection": {"required_consecutive_detections": 3, "window_seconds": 8, "requires_model_agreement": True, "min_quality": "Acceptable"},
    "audio_quality": {"silence_rms_dbfs_max": -50.0, "clipping_ratio_max": 0.01, "min_duration_sec": 0.5, "max_duration_sec": 300.0, "good_snr_db": 20.0, "acceptable_snr_db": 12.0, "poor_snr_db": 6.0},
    "monitoring": {
        "window_minutes": 60, "failed_uploads": 5, "model_failures": 1, "low_confidence_share": 0.5, "low_confidence_min_events": 10, "low_confidence_vs_baseline": 2.0,
        "critical_alerts": 10, "duplicate_files": 5, "failed_logins": 10, "error_rate": 0.2, "review_queue_depth": 100,
    },
    "duplicate_detection": {"near_duplicate_similarity": 0.92, "shortlist": 5, "spectral_match_min": 0.9},
}

RULE_DEFAULTS = {
    "enabled": True,
    "min_alert_severity": "Medium",
    "min_confidence": "$thresholds.confidence.min_confidence",
    "min_top_two_margin": "$thresholds.confidence.top_two_margin_min",
    "required_consecutive_detections": "$thresholds.repeat_detection.required_consecutive_detections",
    "window_seconds": "$thresholds.repeat_detection.window_seconds",
    "requires_model_agreement": "$thresholds.repeat_detection.requires_model_agreement",
    "min_audio_quality": "$thresholds.repeat_detection.min_quality",
    "noise_level_dbfs_limit": None,
    "escalation": (),
}
CLASS_RULES = (
    {"class": "Machinery Fault", "severity": "High", "escalation": ({"id": "machinery_persistent", "repeats_within_window_gte": 4, "to_severity": "High"},)},
    {"class": "Glass Breaking", "severity": "High", "min_top_two_margin": 0.10, "escalation": ({"id": "glass_with_scream", "confidence_gte": 0.85, "to_severity": "Critical"},)},
    {"class": "Alarm or Siren", "severity": "High", "escalation": ({"id": "alarm_will_not_stop", "sustained_seconds_gte": 120, "to_severity": "Critical"},)},
    {"class": "Vehicle Horn", "severity": "Low", "escalation": ({"id": "horn_repeated", "repeats_within_window_gte": 6, "to_severity": "Medium"},)},
    {"class": "Animal Sound", "severity": "Low"},
    {"class": "Gunshot", "severity": "Critical", "min_confidence": 0.75, "escalation": ({"id": "gunshot_repeat", "repeats_within_window_gte": 2, "to_severity": "Critical"},)},
    {"class": "Panic Scream", "severity": "Critical", "escalation": ({"id": "scream_sustained", "sustained_seconds_gte": 10, "to_severity": "Critical"},)},
    {"class": "Aggression", "severity": "High", "escalation": ({"id": "aggression_confident_repeat", "confidence_gte": 0.90, "consecutive_gte": 3, "to_severity": "Critical"},)},
    {"class": "Person Asking for Help", "severity": "Critical", "min_audio_quality": "Poor", "escalation": ({"id": "help_repeat", "repeats_within_window_gte": 2, "to_severity": "Critical"},)},
    {"class": "Background Noise", "severity": "Informational", "noise_level_dbfs_limit": -35.0, "escalation": ({"id": "noise_level_exceeded", "noise_level_dbfs_gte": -35.0, "to_severity": "Medium"},)},
)
#: (id, priority, predicate): a predicate is one key or "any"/"all" of predicates.
REVIEW_CONDITIONS = (
    ("model_disagreement", "high", {"models_agree": False}),
    ("low_confidence", "high", {"any": [{"any_model_confidence_lt": "$thresholds.confidence.low_confidence_band"}, {"any_model_confidence_lt": "$thresholds.confidence.min_confidence"}]}),
    ("poor_audio_quality", "high", {"quality_in": ["Poor", "Unusable"]}),
    ("similar_top_classes", "normal", {"top_two_margin_lt": "$thresholds.confidence.top_two_margin_min"}),
    ("overlapping_sounds", "normal", {"overlapping": True}),
    ("unsupported_sound_pattern", "normal", {"any": [{"unknown_class": True}, {"below_min_confidence_on_both": True}]}),
    ("critical_without_agreement", "critical", {"all": [{"class_is_critical": True}, {"consistency_status_in": ["Weak Match", "Model Disagreement", "Uncertain Result"]}]}),
    ("possible_false_alarm", "critical", {"all": [{"class_is_critical": True}, {"any": [{"quality_in": ["Poor", "Unusable"]}, {"top_two_margin_lt": "$thresholds.confidence.top_two_margin_min"}]}]}),
)
REPEAT_RATE_SECONDS, DEDUP_SECONDS, ALERTS_PER_WINDOW, REVIEW_ESCALATE_MINUTES = 600, 60, 20, 60
RETENTION_DAYS = {"audio": 180, "event_records": 730, "alert": 730, "review": 1095, "audit": 1825, "export": 30, "microphone_session_audio": 7, "model_version": None}
RETENTION_BY_SEVERITY = {
    "Informational": {"event_records": 365}, "Low": {"event_records": 365}, "Medium": {"event_records": 730},
    "High": {"event_records": 1095}, "Critical": {"event_records": 1825, "audio": 730},
}
PURGE_BATCH = 500
#: Audited actions that the monitoring checks count, and the least share that a usual level counts as.
CHECKED_ACTIONS = {
    "failed_uploads": ("audio_upload",), "model_failures": ("model_failure",), "duplicate_files": ("audio_duplicate_rejected", "audio_duplicate_allowed"),
    "failed_logins": ("login_failure", "login_blocked"),
}
LEAST_BASELINE = 0.05
#: Columns of the event export, in order.
EXPORT_COLUMNS = (
    "event_id", "audio_id", "filename", "created_at", "created_by", "source", "predicted_class", "severity", "consistency_status", "confidence_difference",
    "top_confidence", "quality_verdict", "status", "requires_manual_review", "location",
)
LOCKOUT = {"failures": 5, "minutes": 15}
# End of fixed values.


def resolve(value, thresholds=THRESHOLDS):
    """A value of a rule file with ``$thresholds.a.b`` references looked up, at any depth."""
    if isinstance(value, str) and value.startswith("$thresholds."):
        found = thresholds
        for part in value.split(".")[1:]:
            found = found[part]
        return found
    if isinstance(value, dict):
        return {k: resolve(v, thresholds) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [resolve(v, thresholds) for v in value]
    return value


def effective_rules(thresholds=THRESHOLDS, rules=CLASS_RULES, defaults=RULE_DEFAULTS) -> list[dict]:
    """One dict per class: defaults under the class's own values, references resolved."""
    return [resolve({**defaults, **rule}, thresholds) for rule in rules]
