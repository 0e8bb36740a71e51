"""Readers and writers of manifests, splits, logs, clips, reports and event rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotable.functions import scores as S
from echotable.functions.config import EXPORT_COLUMNS

#: Columns that a manifest must have.
REQUIRED = ("audio_id", "filename", "class_label", "licence", "sha256")
MANIFEST_COLUMNS = (*REQUIRED, "source", "author", "duration_sec", "original_or_augmented", "parent_audio_id", "dataset_split")


def load_manifest(spark: SparkSession, path: str, required=REQUIRED) -> DataFrame:
    """A manifest CSV with its extra columns, all strings; blank is null. Missing columns or no rows are errors."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    lacking = [c for c in required if c not in rows.columns]
    if lacking:
        raise ValueError(f"manifest lacks columns {lacking}")
    if rows.isEmpty():
        raise ValueError("manifest has no rows")
    return rows.select(*[F.when(F.trim(c) != "", F.col(c)).alias(c) for c in rows.columns])


def load_split(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``(audio_id, split, class_label, role, group)`` of split documents' assignment maps: one to a file, or with ``multi_line`` false one to a line."""
    one = T.StructType([T.StructField(n, T.StringType()) for n in ("split", "class_label", "role", "group")])
    doc = spark.read.schema(T.StructType([T.StructField("assignments", T.MapType(T.StringType(), one))])).json(path, multiLine=multi_line)
    return doc.select(F.explode("assignments").alias("audio_id", "a")).select("audio_id", "a.*")


def load_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines in a stated schema."""
    return spark.read.schema(schema).json(path)


def load_audio_parquet(spark: SparkSession, path: str, label: str) -> DataFrame:
    """Parquet rows with an embedded audio struct, as (filename, content, label)."""
    return spark.read.parquet(path).select(F.coalesce("audio.path", "filename").alias("filename"), F.col("audio.bytes").alias("content"), F.col(label).alias("label"))


def load_clips(spark: SparkSession, path: str) -> DataFrame:
    """WAV files below a folder as (path, length, content); the content is read only where it is used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path).select("path", "length", "content")


def export_csv(rows: DataFrame, path: str, columns: list[str], limit: int | None = 10_000) -> None:
    """Fixed columns as CSV: lower-case booleans, blank nulls, no formulas. Over ``limit`` rows it refuses."""
    if limit is not None and rows.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows")
    rows.select(*[S.csv_safe(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns]).write.mode("overwrite").csv(path, header=True)


def export_events(events: DataFrame, path: str, limit: int | None = 10_000) -> None:
    """Events as CSV in the fixed export columns, in their order; what ``events`` lacks is blank."""
    have = {c.lower() for c in events.columns}
    rows = events.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in EXPORT_COLUMNS])
    export_csv(rows, path, list(EXPORT_COLUMNS), limit)


def write_splits(manifest: DataFrame, assigned: DataFrame, path: str) -> None:
    """The manifest with its partition, one folder per partition, and below ``ids`` the ids of each, a line each."""
    joined = manifest.drop("dataset_split").join(assigned.select("audio_id", F.col("split").alias("dataset_split")), "audio_id")
    joined.write.mode("overwrite").partitionBy("dataset_split").parquet(f"{path}/manifest")
    assigned.select("split", "audio_id").write.mode("overwrite").partitionBy("split").text(f"{path}/ids")


def load_split_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(split, audio_id)`` from the id lists of ``write_splits``."""
    return spark.read.schema("audio_id string, split string").text(f"{path}/ids").select("split", F.col("audio_id"))


def write_split_documents(assigned: DataFrame, path: str, size: int = 1000) -> None:
    """Assignments as split documents of about ``size`` clips each, in a folder that ``load_split`` reads."""
    entry = F.struct("split", "class_label", "role", "group")
    n = max(1, assigned.count() // size)
    maps = assigned.groupBy(F.pmod(F.xxhash64("audio_id"), F.lit(n)).alias("part")).agg(F.map_from_entries(F.collect_list(F.struct("audio_id", entry))).alias("assignments"))
    maps.select(F.to_json(F.struct("assignments"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_report(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """Rows as CSV and a one-row summary as JSON."""
    rows.write.mode("overwrite").csv(f"{path}/rows", header=True)
    summary.write.mode("overwrite").json(f"{path}/summary")
