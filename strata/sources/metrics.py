"""Run metrics as JSON: the input of the run gates.

A run of cycles has a folder. Its ``metrics.json`` is one document that is rewritten as
the run goes on, with all cycles so far nested in it; ``cycle-N.json`` holds one passing cycle.
So a cycle stands in several files, and its latest one counts. After a failure the durations of phases
that were not reached are absent. Schemas are declared, never inferred: an absent key is null, and
a document that does not parse fails the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.schemas import METRICS_DDL, RUNS_DDL, struct

# The columns of a run.
RUN_COLUMNS = struct(RUNS_DDL).fieldNames()
_FILE = ["_path", "_modified"]


def _read(spark: SparkSession, path: str, ddl: str, glob: str, documents: bool) -> DataFrame:
    reader = spark.read.format("json").schema(ddl).option("mode", "FAILFAST").option("pathGlobFilter", glob)
    rows = reader.option("recursiveFileLookup", True).option("multiLine", documents).load(path)
    return rows.select(
        "*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_modification_time").alias("_modified")
    )


def _folder(path: Column, levels: int) -> Column:
    """Name of the folder that a file lies in, ``levels`` up."""
    return F.element_at(F.split(path, "/"), -1 - levels)


def read_metrics(spark: SparkSession, path: str, glob: str = "*.json", documents: bool = True, levels: int = 1) -> DataFrame:
    """Nested metrics documents below ``path`` with ``run`` (the name of their folder) and where they were read.

    ``documents``: each file is one document over several lines; else each line is one.
    """
    rows = _read(spark, path, METRICS_DDL, glob, documents)
    return rows.withColumn("run", _folder(F.col("_path"), levels))


def cycles_of_metrics(metrics: DataFrame) -> DataFrame:
    """One row for each cycle in the documents' arrays: run, a run's columns, and where it was read."""
    return metrics.select("run", *_FILE, F.inline("cycles"))


def read_cycles(spark: SparkSession, path: str, glob: str = "cycle-*.json", documents: bool = True, levels: int = 1) -> DataFrame:
    """Cycle files below ``path``, in the shape of ``cycles_of_metrics``."""
    rows = _read(spark, path, RUNS_DDL, glob, documents)
    return rows.select(_folder(F.col("_path"), levels).alias("run"), *_FILE, *RUN_COLUMNS)


def latest_cycles(*sources: DataFrame) -> DataFrame:
    """The runs table: of each run's cycle the row of its latest file (by time, then by name).

    A partial aggregate per (run, cycle): a run with most of all cycles spreads over all tasks.
    """
    rows = sources[0]
    for more in sources[1:]:
        rows = rows.unionByName(more)
    others = [c for c in RUN_COLUMNS if c != "cycle"]
    latest = F.max_by(F.struct(*others), F.struct("_modified", "_path")).alias("_row")
    return rows.groupBy("run", "cycle").agg(latest).select("run", "cycle", "_row.*")


def notes(metrics: DataFrame) -> DataFrame:
    """(run, note) of each run's latest document, in the documents' order of notes."""
    latest = F.max_by(F.struct("notes"), F.struct("_modified", "_path")).alias("_row")
    return metrics.groupBy("run").agg(latest).select("run", F.posexplode("_row.notes").alias("position", "note"))
