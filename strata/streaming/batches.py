"""Idempotent bronze ingest: batches of a stream with a ledger of their own.

A file sink skips a batch number it has seen, so a new checkpoint over an old table loses files, and
a checkpoint older than the table doubles them. Here a batch is written to a folder named by its
files, and counts only once its ledger entry stands:

1. The batch's files (path, time, size) that no other committed batch holds are its own;
   rows of other files are left out. So a new checkpoint, which lists every file again, adds
   nothing that is there.
2. The rows of its own files go to ``rows/batch=<name>``; whatever a crash left there is overwritten.
3. The entry goes to ``files/batch=<name>``: each file with the rows it brought, and the rows that
   the write itself observed (no second scan). Readers take the rows of entries that stand; a batch that
   crashed before is not there, and its replay takes its place.

The name is a hash of the batch's own files: the same files give the same name, under any checkpoint
and batch number. Batches of one table are written one at a time, by one stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from strata.schemas import struct

_FILES_DDL = "path STRING, modified TIMESTAMP, size BIGINT, landed BIGINT, stored BIGINT"


class BatchTable:
    """Bronze rows under ``root``, and the ledger of the files they came from."""

    def __init__(self, spark: SparkSession, root: str, ddl: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), struct(ddl)

    def _stored(self, name: str, schema: str | StructType) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        files = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if files.exists(path) else None

    def files(self) -> DataFrame:
        """The ledger: path, modified, size, landed and stored (rows; those of the whole batch), batch."""
        schema = f"{_FILES_DDL}, batch STRING"
        stored = self._stored("files", schema)
        return self.spark.createDataFrame([], schema) if stored is None else stored

    def rows(self) -> DataFrame:
        """The rows of committed batches."""
        stored = self._stored("rows", StructType([*self.schema.fields, StructField("batch", StringType())]))
        if stored is None:
            return self.spark.createDataFrame([], self.schema)
        committed = self.files().select("batch").distinct()
        return stored.join(committed, "batch", "left_semi").select(*self.schema.names)

    def stream(self, landing: DataFrame) -> DataFrame:
        """A landing stream with the files its rows come from."""
        return landing.select(
            *self.schema.names,
            F.struct(
                F.col("_metadata.file_path").alias("path"),
                F.col("_metadata.file_modification_time").alias("modified"),
                F.col("_metadata.file_size").alias("size"),
            ).alias("_file"),
        )

    def write(self, batch: DataFrame, between: Callable[[], None] | None = None) -> str | None:
        """Write one batch of ``stream``; its name, or None if all its files are known. ``between``: see ``ingest``."""
        batch.persist()
        try:
            known = self.files().select(F.struct("path", "modified", "size").alias("_file"))
            own = batch.groupBy("_file").agg(F.count(F.lit(1)).alias("landed")).join(known, "_file", "left_anti")
            own = own.select("_file.*", "landed").persist()
            # An order-free hash over all files, so that no list of them is gathered.
            bits = F.xxhash64("path", "modified", "size").cast("decimal(38,0)")
            n, first, total = own.agg(F.count(F.lit(1)), F.min("path"), F.sum(bits)).first()
            if not n:
                return None
            name = hashlib.sha256(f"{n} {first} {total}".encode()).hexdigest()[:24]
            mine = own.select(F.struct("path", "modified", "size").alias("_file"))
            rows = batch.join(mine, "_file", "left_semi").select(*self.schema.names)
            seen = Observation()
            rows = rows.observe(seen, F.count(F.lit(1)).alias("stored"))
            rows.write.mode("overwrite").parquet(f"{self.root}/rows/batch={name}")
            if between is not None:
                between()
            entry = own.withColumn("stored", F.lit(seen.get["stored"]).cast("bigint"))
            entry.write.mode("overwrite").parquet(f"{self.root}/files/batch={name}")
            own.unpersist()
            return name
        finally:
            batch.unpersist()

    def start(self, landing: DataFrame, checkpoint: str, between: Callable[[], None] | None = None) -> StreamingQuery:
        """A triggered run of ``landing`` into this table. ``between`` runs between rows and entry (a test crashes there)."""
        return (
            self.stream(landing)
            .writeStream.foreachBatch(lambda batch, _: (self.write(batch, between), None)[1])
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def counts(self) -> DataFrame:
        """(batch, files, landed, stored): what each committed batch's files brought and what its write stored."""
        of_batch = self.files().groupBy("batch")
        return of_batch.agg(F.count(F.lit(1)).alias("files"), F.sum("landed").alias("landed"), F.max("stored").alias("stored"))
