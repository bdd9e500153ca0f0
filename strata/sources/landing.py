"""CSV landing folders: one directory per dataset, comma CSV with a header line.

The schema is always declared, never inferred. ``enforceSchema=false`` makes
Spark check each file's header against the declared column names, so a drop
with a misnamed column (``customerid``) fails the read instead of loading
silently under the wrong name.

Streaming reads go through the file source: each new file is read once and
recorded in the query's checkpoint. A file rewritten in place under the same
name is not read again; new data needs a new file name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession

from strata.schemas import struct

# CSV options of the landing files.
CSV_OPTIONS = {
    "header": "true",
    "sep": ",",
    "enforceSchema": "false",
    "mode": "FAILFAST",
}


def _options(
    path_glob: str | None, max_files_per_trigger: int | None, archive_dir: str | None = None
) -> dict[str, str]:
    opts = dict(CSV_OPTIONS)
    if path_glob:
        opts["pathGlobFilter"] = path_glob
    if max_files_per_trigger:
        opts["maxFilesPerTrigger"] = str(max_files_per_trigger)
    if archive_dir:
        # Files a committed batch has read move here, so listing stays short.
        opts["cleanSource"] = "archive"
        opts["sourceArchiveDir"] = archive_dir
    return opts


def read_landing(spark: SparkSession, path: str, ddl: str, path_glob: str | None = None) -> DataFrame:
    """Batch read of every file in a landing directory under a declared schema."""
    return spark.read.format("csv").options(**_options(path_glob, None)).schema(struct(ddl)).load(path)


def read_landing_stream(
    spark: SparkSession,
    path: str,
    ddl: str,
    path_glob: str | None = None,
    max_files_per_trigger: int | None = None,
    archive_dir: str | None = None,
) -> DataFrame:
    """Incremental read of a landing directory: each new file once, append-only.

    ``max_files_per_trigger`` bounds each micro-batch; ``archive_dir`` (on the
    same file system, outside the landing folder) moves read files away.
    """
    return (
        spark.readStream.format("csv")
        .options(**_options(path_glob, max_files_per_trigger, archive_dir))
        .schema(struct(ddl))
        .load(path)
    )


def write_csv_drop(df: DataFrame, folder: str) -> None:
    """Land ``df`` as one CSV drop (a new folder of part files with headers).

    Drops are never rewritten: a file source skips a path it has seen.
    """
    df.write.mode("errorifexists").option("header", "true").csv(folder)


def drops_glob(landing: str) -> str:
    """All drop folders of one dataset's landing directory."""
    return f"{landing.rstrip('/')}/*"


def upload(df: DataFrame, place: Column, files: int, folder: str, prefix: str = "part") -> None:
    """Upload ``df`` as CSV files of fixed names, over older ones of these names.

    Row by row ``place`` (0 to ``files`` - 1) tells the file ``<prefix>-<place>.csv``; the files are written in
    parallel and then renamed. A stream does not read a path twice (see ``strata.sources.ledger``).
    """
    spark = df.sparkSession
    staging = f"{folder.rstrip('/')}/.upload-{uuid.uuid4().hex[:12]}"
    df.repartitionById(files, place.cast("int")).write.option("header", True).csv(staging)
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    # At most ``files`` numbers; the writer may leave a file without rows, too.
    full = {r[0] for r in df.select(place.cast("int")).distinct().collect()}
    for status in system.globStatus(hadoop.Path(f"{staging}/part-*")):
        part = status.getPath()
        number = int(part.getName().split("-")[1])
        if number not in full:
            continue
        target = hadoop.Path(f"{folder.rstrip('/')}/{prefix}-{number}.csv")
        system.delete(target, False)
        if not system.rename(part, target):
            raise OSError(f"could not move an upload to {target}")
    system.delete(hadoop.Path(staging), True)
