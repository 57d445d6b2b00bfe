"""A table that a stream adds to batch by batch, each batch exactly once.

A batch's rows are written to a folder of the attempt's own, then a record that names batch and attempt is moved into
place: that is the commit. Readers join the rows with the records, so what a failed attempt has left is never seen, and a batch
that has its record is not written again. What has to follow the commit (files beside the pages, keys) is done between
`begin` and `end`; a batch that was begun and not ended is found by `unended`, whoever begins next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.sources.sinks import move


class Ledger:
    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for name in ("data", "records", "open"):
            self._store.mkdirs(self._path(f"{self.folder}/{name}"))

    def _create(self, path: str, content: str = "") -> None:
        out = self._store.create(self._path(path), True)
        out.write(bytearray(content.encode()))
        out.close()

    def begin(self, batch: str) -> None:
        self._create(f"{self.folder}/open/{batch}")

    def end(self, batch: str) -> None:
        self._store.delete(self._path(f"{self.folder}/open/{batch}"), False)

    def unended(self) -> list[str]:
        """Batches that were begun and not ended: a few, those that a failure has interrupted."""
        return sorted(s.getPath().getName() for s in self._store.listStatus(self._path(f"{self.folder}/open")))

    def committed(self, batch: str) -> bool:
        return self._store.exists(self._path(f"{self.folder}/records/{batch}"))

    def write(self, df: DataFrame, batch: str) -> bool:
        """Writes and commits the batch's rows; False, and nothing is written, where it is committed already."""
        if self.committed(batch):
            return False
        attempt = uuid.uuid4().hex
        df.write.parquet(f"{self.folder}/data/batch={batch}/attempt={attempt}")
        draft = f"{self.folder}/records/.{batch}.{attempt}"
        self._create(draft, f"{batch} {attempt}")
        move(self.spark, draft, f"{self.folder}/records/{batch}")
        return True

    def read(self, batch: str | None = None) -> DataFrame:
        """The rows of all committed batches, or of one, with their batch."""
        where = f"{self.folder}/records" + (f"/{batch}" if batch else "")
        parts = F.split("value", " ")
        records = self.spark.read.text(where).select(parts[0].alias("batch"), parts[1].alias("attempt"))
        rows = self.spark.read.schema(f"{self.schema}, batch string, attempt string").parquet(f"{self.folder}/data")
        if batch:
            rows = rows.where(F.col("batch") == batch)
        return rows.join(records, ["batch", "attempt"], "left_semi").drop("attempt")
