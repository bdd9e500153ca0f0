"""The pipeline update: both bronze tables, then silver.

``run_update`` creates the namespace and the declared tables (schema and
comment, empty until data arrives), starts both bronze ingests together as
triggered streams, waits for both, and refreshes the silver table from the
bronze tables as a full recompute, published once it has passed its checks.

``reset`` drops the namespace with its tables and hands back a new
checkpoint folder: a dropped table with an old checkpoint would come back
empty, because the checkpoint remembers every file as already read. Landing
folders are inputs and are never touched.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.rollup import customer_summary
from strata.plans.checks import require_columns, schema_contract, tables_exist
from strata.plans.publish import publish_silver
from strata.schemas import (
    BRONZE_CUSTOMERS,
    BRONZE_CUSTOMERS_DDL,
    BRONZE_ORDERS,
    BRONZE_ORDERS_DDL,
    COMMENTS,
    DDL,
    SILVER_SUMMARY,
    struct,
)
from strata.sources.landing import read_landing_stream
from strata.streaming.ingest import await_all, start_ingest


@dataclass(frozen=True)
class Namespace:
    """Where the three tables live: ``[catalog.]schema.table``."""

    schema: str
    catalog: str | None = None

    def qualified(self, table: str) -> str:
        prefix = f"`{self.catalog}`.`{self.schema}`" if self.catalog else f"`{self.schema}`"
        return f"{prefix}.`{table}`"

    @property
    def database(self) -> str:
        return f"`{self.catalog}`.`{self.schema}`" if self.catalog else f"`{self.schema}`"


def create_namespace(spark: SparkSession, ns: Namespace, location: str | None = None) -> None:
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {ns.database}{loc}")


def create_declared_table(spark: SparkSession, ns: Namespace, table: str) -> None:
    """The table with its declared schema and comment; no rows until data arrives."""
    comment = COMMENTS[table].replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {ns.qualified(table)} ({DDL[table]}) USING parquet COMMENT '{comment}'"
    )


CHECKPOINT_PROPERTY = "strata.checkpoint"


def bind_checkpoint(spark: SparkSession, ns: Namespace, table: str, checkpoint: str) -> None:
    """Tie a bronze table to the checkpoint that feeds it; another one raises.

    A table's file sink remembers which batches it has: with a fresh checkpoint it would
    skip the first ones, and their files would be lost without an error.
    """
    shown = spark.sql(f"SHOW TBLPROPERTIES {ns.qualified(table)}").where(F.col("key") == CHECKPOINT_PROPERTY).first()
    if shown is None:
        if not spark.read.table(ns.qualified(table)).isEmpty():
            raise ValueError(f"{table} holds rows of an unknown checkpoint; reset the namespace to feed it from {checkpoint}")
        quoted = checkpoint.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"ALTER TABLE {ns.qualified(table)} SET TBLPROPERTIES ('{CHECKPOINT_PROPERTY}' = '{quoted}')")
    elif shown["value"] != checkpoint:
        raise ValueError(
            f"{table} is fed from checkpoint {shown['value']}, not {checkpoint}; reset the namespace to change it"
        )


def verify(spark: SparkSession, ns: Namespace) -> None:
    """After an update: every table exists with its declared schema, or an error."""
    tables = (BRONZE_CUSTOMERS, BRONZE_ORDERS, SILVER_SUMMARY)
    missing = [t for t, there in tables_exist(spark, [ns.qualified(t) for t in tables]).items() if not there]
    if missing:
        raise ValueError(f"tables missing after the update: {missing}")
    for t in tables:
        df = spark.read.table(ns.qualified(t))
        require_columns(df, struct(DDL[t]).fieldNames())
        wrong = [c for c in schema_contract(df, DDL[t]) if not c["ok"]]
        if wrong:
            raise ValueError(f"{t} departs from its schema: {wrong}")


def refresh_silver(spark: SparkSession, ns: Namespace) -> DataFrame:
    """Recompute silver from the bronze tables (batch reads); publish it once it has passed its checks."""
    for t in (BRONZE_CUSTOMERS, BRONZE_ORDERS):
        spark.catalog.refreshTable(ns.qualified(t))
    customers = spark.read.table(ns.qualified(BRONZE_CUSTOMERS))
    orders = spark.read.table(ns.qualified(BRONZE_ORDERS))
    summary = customer_summary(customers, orders)
    return publish_silver(spark, ns.qualified(SILVER_SUMMARY), summary, customers, orders, DDL[SILVER_SUMMARY])


def run_update(
    spark: SparkSession,
    customers_landing: str,
    orders_landing: str,
    ns: Namespace,
    checkpoint_root: str,
    *,
    location: str | None = None,
) -> DataFrame:
    """One pipeline update, verified at its end. Returns the silver table."""
    create_namespace(spark, ns, location)
    for t in (BRONZE_CUSTOMERS, BRONZE_ORDERS, SILVER_SUMMARY):
        create_declared_table(spark, ns, t)
    root = checkpoint_root.rstrip("/")
    for t in (BRONZE_CUSTOMERS, BRONZE_ORDERS):
        bind_checkpoint(spark, ns, t, f"{root}/{t}")
    running = [
        start_ingest(
            read_landing_stream(spark, customers_landing, BRONZE_CUSTOMERS_DDL),
            f"{root}/{BRONZE_CUSTOMERS}",
            table=ns.qualified(BRONZE_CUSTOMERS),
        ),
        start_ingest(
            read_landing_stream(spark, orders_landing, BRONZE_ORDERS_DDL),
            f"{root}/{BRONZE_ORDERS}",
            table=ns.qualified(BRONZE_ORDERS),
        ),
    ]
    await_all(running)
    silver = refresh_silver(spark, ns)
    verify(spark, ns)
    return silver


def reset(spark: SparkSession, ns: Namespace, shared_root: str) -> str:
    """Drop the namespace and its tables; return a new checkpoint folder."""
    spark.sql(f"DROP SCHEMA IF EXISTS {ns.database} CASCADE")
    return f"{shared_root.rstrip('/')}/checkpoints-{uuid.uuid4().hex[:12]}"
