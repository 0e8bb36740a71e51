"""What one analysis stores: file, event, score, alert, review and audit rows, and copies of stored bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from echotable.sources.commits import TableLog

TABLES = ("audio_files", "events", "confidence_scores", "alerts", "reviews", "audit")


class FirstStored(StatefulProcessor):
    """Of one content: the file that was stored first, whatever batch it came in."""

    def __init__(self, columns: list[str], key: str):
        self.columns, self.key = columns, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "audio_id string")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values(self.key, kind="stable").reset_index(drop=True)
        known = self.first.get()[0] if self.first.exists() else None
        if known is None:
            known = str(pdf[self.key].iloc[0])
            self.first.update((known,))
            copies = pdf.index > 0
        else:
            copies = pdf.index >= 0
        yield pdf[self.columns].assign(duplicate_of=[known if c else None for c in copies])

    def close(self) -> None:
        pass


def with_duplicates(records: DataFrame, content: str = "sha256", key: str = "audio_id") -> DataFrame:
    """A stream of records with ``duplicate_of``: the file that holds the same content and was stored first, by batch and then by id.

    The first file of each content is kept in the query's state, so no batch reads the stored tables. Records without a
    content hash are never copies: they share the state of null, so give them hashes of their own first.
    """
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema)
    columns = records.columns
    own = F.coalesce(F.col(content), F.concat(F.lit("no hash:"), key))
    return records.withColumn("_content", own).groupBy("_content").transformWithStateInPandas(FirstStored(columns, key), f"{typed}, duplicate_of string", "Append", "None")


def analysis_tables(records: DataFrame, allow_duplicates: bool = False) -> dict[str, DataFrame]:
    """The rows of each of ``TABLES`` for analysed records.

    ``records``: event_id, audio_id, sha256, source, duplicate_of, the compared columns, event_severity, alert_raised,
    review_required, review_priority, review_ids, and the ranked scores ``ra`` and ``rb``. New content gives a file row. A copy
    of stored bytes is refused, which is audited and stores nothing else; where copies are allowed its
    event belongs to the stored file.
    """
    new = F.col("duplicate_of").isNull()
    kept = records if allow_duplicates else records.where(new)
    stored = F.coalesce("duplicate_of", "audio_id")
    scores = None
    for model, ranked in (("python", "ra"), ("gtm", "rb")):
        part = kept.select("event_id", F.lit(model).alias("model"), F.posexplode(ranked).alias("at", "p"))
        part = part.select("event_id", "model", F.col("p.class_name").alias("class_name"), F.round("p.confidence", 6).alias("confidence"), (F.col("at") + 1).alias("rank"), (F.col("at") == 0).alias("is_top"))
        scores = part if scores is None else scores.unionByName(part)

    def audit(rows: DataFrame, action: str | Column, target: str, key: Column, outcome: str | Column = "success") -> DataFrame:
        text = lambda x: F.lit(x) if isinstance(x, str) else x
        return rows.select(text(action).alias("action"), F.lit(target).alias("target_type"), key.cast("string").alias("target_id"), text(outcome).alias("outcome"))

    copied = "audio_duplicate_allowed" if allow_duplicates else "audio_duplicate_rejected"
    logged = audit(records, F.when(new, "audio_upload").otherwise(copied), "audio_file", stored, F.when(new | F.lit(allow_duplicates), "success").otherwise("failure"))
    logged = logged.unionByName(audit(kept, "prediction", "event", F.col("event_id")))
    logged = logged.unionByName(audit(kept.where("alert_raised"), "alert_generated", "alert", F.col("event_id")))
    logged = logged.unionByName(audit(kept.where("review_required"), "review_queued", "review", F.col("event_id")))
    grouped = F.concat_ws(":", F.coalesce("sha256", "audio_id"), "python_class", "event_severity")
    return {
        "audio_files": records.where(new).select("audio_id", "sha256", "source"),
        "events": kept.select(stored.alias("audio_id"), *[c for c in records.columns if c not in ("ra", "rb", "audio_id", "duplicate_of")]),
        "confidence_scores": scores,
        "alerts": kept.where("alert_raised").select("event_id", F.col("event_severity").alias("severity"), F.lit("Open").alias("status"), grouped.alias("dedup_key")),
        "reviews": kept.where("review_required").select("event_id", F.lit("Pending Review").alias("status"), F.col("review_priority").alias("priority"), F.col("review_ids").alias("condition_ids")),
        "audit": logged,
    }


def persist_analyses(log: TableLog, name: str, allow_duplicates: bool = False):
    """A ``foreachBatch`` function that stores a batch of records in all ``TABLES`` at once, and once only."""

    def write(batch: DataFrame, number: int) -> None:
        key = f"{name}-{number:09d}"
        if not log.committed(key):
            log.commit(key, analysis_tables(log.staged(key, batch), allow_duplicates))

    return write
