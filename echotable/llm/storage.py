"""Shared scratch tables.

Intermediate results are cut from their lineage by writing Parquet below the folder that
the cluster names in ``spark.checkpoint.dir``; every executor and the driver see it, so a
lost executor costs a re-read and nothing else. Where that setting is missing, a session on one
machine (tests, a laptop) gets a temporary folder, and a cluster an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Removes a query's shuffle files when it ends. They would stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one temporary folder where none is set and Spark runs in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="echotable-"))
    return _local[0]


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches small: texts may be long, and a worker holds a batch several times over."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


class Scratch:
    """Parquet tables of one operator run, below one folder of their own."""

    def __init__(self, spark: SparkSession, name: str):
        bounded_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/echotable-{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: set[str] = set()

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it as a read of what was written."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        kept = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if kept is None else self.spark.conf.set(CLEANUP, kept)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self._paths.add(path)
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table that nothing will read again."""
        self._delete(df._scratch_path)

    def drop_others(self, *kept: DataFrame) -> None:
        """Remove all tables but these."""
        for path in self._paths - {df._scratch_path for df in kept}:
            self._delete(path)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self._paths.discard(name)
