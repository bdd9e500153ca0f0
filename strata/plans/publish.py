"""Write, check, publish: a table's readers see a new version only once it has passed.

A version is written to a folder of its own and checked there: its schema against the declared one, then
the acceptance checks against the tables it was made from. Only then the table's location moves to it,
a change of metadata alone. A version that fails stays where it is, unread, and the table keeps its old rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.plans.checks import acceptance_checks, require_columns, schema_contract
from strata.schemas import struct

# The checks that a version must pass; the others tell of its inputs.
REQUIRED = [
    "bronze_customers_nonempty",
    "bronze_orders_nonempty",
    "silver_nonempty",
    "silver_rows_equal_distinct_customers",
    "orders_rolled_up_plus_unmatched",
]

_VERSION = "version-"


class NotPublished(ValueError):
    """A version failed its checks; ``failed`` names them."""

    def __init__(self, table: str, failed: list[str]):
        super().__init__(f"{table} keeps its rows, the new version failed: {', '.join(failed)}")
        self.failed = failed


def write_version(spark: SparkSession, table: str, rows: DataFrame, ddl: str) -> tuple[str, DataFrame]:
    """``rows`` written beside the table's present files: (folder, rows read back)."""
    location = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").first()["data_type"]
    parent, name = location.rstrip("/").rsplit("/", 1)
    if not name.startswith(_VERSION):
        # The folder that the table was made with; versions stand beside it.
        parent = f"{parent}/versions-of-{name}"
    folder = f"{parent}/{_VERSION}{uuid.uuid4().hex[:12]}"
    rows.write.parquet(folder)
    return folder, spark.read.schema(struct(ddl)).parquet(folder)


def failed_checks(customers: DataFrame, orders: DataFrame, version: DataFrame, ddl: str) -> list[str]:
    """The names of the required checks that a silver version does not pass."""
    require_columns(version, struct(ddl).fieldNames())
    wrong = [f"schema of {c['column']}" for c in schema_contract(version, ddl) if not c["ok"]]
    checks = acceptance_checks(customers, orders, version)
    failed = checks.where(F.col("check").isin(REQUIRED) & ~F.coalesce("passed", F.lit(False)))
    return wrong + sorted(r["check"] for r in failed.collect())


def switch(spark: SparkSession, table: str, folder: str) -> None:
    """Let the table's readers see the version in ``folder``."""
    quoted = folder.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{quoted}'")
    spark.catalog.refreshTable(table)


def publish_silver(
    spark: SparkSession, table: str, rows: DataFrame, customers: DataFrame, orders: DataFrame, ddl: str
) -> DataFrame:
    """Write ``rows`` as a version of ``table``, check it, publish it; ``NotPublished`` if a check fails."""
    folder, version = write_version(spark, table, rows, ddl)
    failed = failed_checks(customers, orders, version, ddl)
    if failed:
        raise NotPublished(table, failed)
    switch(spark, table, folder)
    return spark.read.table(table)
