"""A ledger of landed files, to see what a file stream cannot.

A file stream remembers paths: a file that is overwritten in place is never read again, and
nothing says so. The ledger holds each file's path, time and size, run by run; comparing a listing with the last
entries tells new, changed, unchanged and missing files. Listings read no file contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.schemas import struct
from strata.sources.landing import CSV_OPTIONS
from strata.session import staged

NEW, CHANGED, UNCHANGED, MISSING = "new", "changed", "unchanged", "missing"
# Paths that are handed to a read by name; more are picked by a join.
FEW = 1000
LEDGER_DDL = "path STRING, modified TIMESTAMP, size BIGINT"


def list_files(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """(path, modified, size) of the files below ``folder``; their contents stay unread."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    return files.load(folder).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def compare(known: DataFrame, found: DataFrame) -> DataFrame:
    """(path, status, modified, size): each file of either side. Other time or size means changed."""
    old = known.select("path", F.col("modified").alias("_modified"), F.col("size").alias("_size"))
    both = found.join(old, "path", "full_outer")
    same = (F.col("modified") == F.col("_modified")) & (F.col("size") == F.col("_size"))
    status = (
        F.when(F.col("size").isNull(), MISSING).when(F.col("_size").isNull(), NEW).when(same, UNCHANGED).otherwise(CHANGED)
    )
    return both.select(
        "path", status.alias("status"), F.coalesce("modified", "_modified").alias("modified"), F.coalesce("size", "_size").alias("size")
    )


class Ledger:
    """The files of one landing folder, as of the last run that was kept."""

    def __init__(self, spark: SparkSession, folder: str, glob: str = "*.csv", known: DataFrame | None = None):
        self.spark, self.folder, self.glob = spark, folder, glob
        self.known = spark.createDataFrame([], LEDGER_DDL) if known is None else known

    def check(self) -> DataFrame:
        """What the folder holds now against the last run, written down: later overwrites do not change it."""
        return staged(compare(self.known, list_files(self.spark, self.folder, self.glob)), "ledger-check")

    def keep(self, checked: DataFrame) -> Ledger:
        """The ledger after a run that has dealt with ``checked``."""
        rows = checked.where(F.col("status") != MISSING).select("path", "modified", "size")
        return Ledger(self.spark, self.folder, self.glob, staged(rows, "ledger"))

    def read(self, checked: DataFrame, ddl: str, status: str = CHANGED) -> DataFrame:
        """The rows of the files of a status, with their file: what a stream has lost when they changed.

        Only these files are read while they are ``FEW``; more are picked by a join over all files.
        """
        wanted = checked.where(F.col("status") == status).select("path")
        few = [r["path"] for r in wanted.limit(FEW + 1).collect()]
        reader = self.spark.read.format("csv").schema(struct(ddl)).options(**CSV_OPTIONS)
        if not few:
            return self.spark.createDataFrame([], struct(ddl)).withColumn("file", F.lit(""))
        if len(few) <= FEW:
            return reader.load(few).select("*", F.col("_metadata.file_path").alias("file"))
        rows = reader.options(pathGlobFilter=self.glob, recursiveFileLookup="true").load(self.folder)
        rows = rows.select("*", F.col("_metadata.file_path").alias("file"))
        # Listings and reads spell a local path's scheme differently (file:/x, file:///x).
        wanted = wanted.select(_plain(F.col("path")).alias("_path"))
        return rows.join(wanted, _plain(F.col("file")) == F.col("_path"), "left_semi")


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")
