"""Tables of one run in the folder that all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch, and of a Parquet row group, where rows hold waveforms or images of them.
LONG = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_local: list[str] = []


def bounded_bytes(spark: SparkSession) -> None:
    """Keep Arrow batches small in bytes: a worker and its executor hold a batch of long rows several times over."""
    if int(spark.conf.get(_BATCH).rstrip("b")) > LONG:
        spark.conf.set(_BATCH, LONG)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one; a temporary one only where none is set and Spark runs in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="echotable-"))
        base = _local[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Tables:
    """Writes tables that several later steps read, so that none of them is worked out twice and no lineage grows."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self._n = spark, fresh_folder(spark, name), 0

    def save(self, df: DataFrame, long_rows: bool = False) -> DataFrame:
        """Write ``df`` and return it as a read of what was written; readers hold a row group at most, so those of long rows are small."""
        self._n += 1
        write = df.write.option("parquet.block.size", LONG) if long_rows else df.write
        write.parquet(f"{self.root}/{self._n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self._n}")
