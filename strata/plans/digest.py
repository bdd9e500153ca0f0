"""What a table holds, as a few numbers that do not depend on the order of rows.

The number of rows and the sum of their 64-bit hashes (columns by name, each with its place, so
that swapped values differ): one partial aggregate, one row a task. Equal tables have equal digests,
on any layout; a row more, less or altered changes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import scratch_dir


def table_digest(df: DataFrame) -> DataFrame:
    """One row (rows BIGINT, digest DECIMAL(38,0), columns STRING)."""
    names = sorted(df.columns)
    # A null hashes to its seed, so each column has a marker of its own.
    parts = [F.struct(F.lit(i).alias("place"), F.col(c).isNull().alias("none"), F.col(c).alias("value")) for i, c in enumerate(names)]
    row = F.xxhash64(*parts).cast("decimal(38,0)")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(row), F.lit(0).cast("decimal(38,0)")).cast("decimal(38,0)").alias("digest"),
    ).withColumn("columns", F.lit(",".join(names)))


class Updates:
    """A log of updates: the digest of every table after each of them."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_dir(spark, "updates")

    def record(self, update: str, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            digest = table_digest(df).select(F.lit(update).alias("update"), F.lit(name).alias("table"), "*")
            digest.coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def same(self, one: str, other: str) -> DataFrame:
        """(table, rows, same): each table after ``one``, and whether it was equal after ``other``."""
        log = self.read()
        a, b = (log.where(F.col("update") == u).select("table", "rows", "digest", "columns") for u in (one, other))
        b = b.select("table", *[F.col(c).alias(f"_{c}") for c in ("rows", "digest", "columns")])
        equal = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("rows", "digest", "columns")]
        return a.join(b, "table", "full_outer").select("table", "rows", (equal[0] & equal[1] & equal[2]).alias("same"))
