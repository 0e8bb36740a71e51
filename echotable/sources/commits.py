"""A commit log over Parquet tables: what a batch writes to several tables becomes visible at once, and only once.

A batch writes each table to a folder of its own; then one small file in ``_commits`` names the folders. Readers
take the folders named there, so that what a failed attempt left behind is never read. A batch that is
committed already is not written again, and no batch reads the tables. The file appears by a rename, which
the file system must do in one step.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class TableLog:
    """Tables below ``path``, written in batches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def committed(self, batch: str) -> bool:
        fs, at = self._fs(f"{self.path}/_commits/{batch}.json")
        return fs.exists(at)

    def commit(self, batch: str, tables: dict[str, DataFrame]) -> bool:
        """Write the tables of a batch and make them visible; False where the batch is committed already."""
        if self.committed(batch):
            return False
        attempt = uuid.uuid4().hex
        folders = {}
        for name, rows in tables.items():
            folders[name] = f"{name}/{batch}-{attempt}"
            rows.write.parquet(f"{self.path}/{folders[name]}")
        fs, draft = self._fs(f"{self.path}/_drafts/{batch}-{attempt}.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"batch": batch, "folders": [{"table": t, "folder": f} for t, f in folders.items()]}).encode()))
        out.close()
        _, final = self._fs(f"{self.path}/_commits/{batch}.json")
        fs.mkdirs(final.getParent())
        visible = bool(fs.rename(draft, final))
        fs.delete(self._fs(f"{self.path}/_staged/{batch}")[1], True)
        return visible

    def staged(self, batch: str, rows: DataFrame) -> DataFrame:
        """A batch's rows, written once, for tables that are derived from them; gone when the batch is committed."""
        at = f"{self.path}/_staged/{batch}"
        rows.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def folders(self, table: str) -> list[str]:
        """Committed folders of a table: one small row for each batch."""
        fs, at = self._fs(f"{self.path}/_commits")
        if not fs.exists(at):
            return []
        log = self.spark.read.schema("batch string, folders array<struct<table:string,folder:string>>").json(f"{self.path}/_commits/*.json")
        return sorted(f"{self.path}/{x.folder}" for r in log.collect() for x in r.folders if x.table == table)

    def read(self, table: str) -> DataFrame:
        """All committed rows of a table. A table without a commit is an error."""
        folders = self.folders(table)
        if not folders:
            raise ValueError(f"nothing is committed to {table}")
        return self.spark.read.parquet(*folders)
