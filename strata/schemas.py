"""Declared table contracts.

Every dataset carries a fixed DDL schema; nothing is inferred at read time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

# Table names and declared schemas of the three datasets.
BRONZE_CUSTOMERS = "bronze_customers"
BRONZE_ORDERS = "bronze_orders"
SILVER_SUMMARY = "silver_customer_summary"

BRONZE_CUSTOMERS_DDL = "id STRING, name STRING, region STRING, signup_date STRING"
BRONZE_ORDERS_DDL = "order_id STRING, customer_id STRING, amount STRING, order_date STRING"
SILVER_SUMMARY_DDL = (
    "id STRING, name STRING, region STRING, "
    "total_orders BIGINT, total_amount DOUBLE, last_order_date STRING"
)
RUNS_DDL = (
    "cycle INT, hard_mode INT, reset_duration BIGINT, health_check_duration BIGINT, "
    "seed_duration BIGINT, demo_duration BIGINT, verify_duration BIGINT, "
    "total_e2e_duration BIGINT, outcome STRING, failure_phase STRING"
)
# The metrics document of a run of cycles.
METRICS_DDL = (
    "dry_run_date STRING, total_cycles INT, hard_mode_cycle INT, "
    f"cycles ARRAY<STRUCT<{', '.join(f.replace(' ', ': ', 1) for f in RUNS_DDL.split(', '))}>>, "
    "notes ARRAY<STRING>"
)

# Table comments.
COMMENTS = {
    BRONZE_CUSTOMERS: "Bronze layer: raw customers, append-only from CSV drops",
    BRONZE_ORDERS: "Bronze layer: raw orders, append-only from CSV drops",
    SILVER_SUMMARY: "Silver layer: customer order roll-up",
}

DDL = {
    BRONZE_CUSTOMERS: BRONZE_CUSTOMERS_DDL,
    BRONZE_ORDERS: BRONZE_ORDERS_DDL,
    SILVER_SUMMARY: SILVER_SUMMARY_DDL,
}


def empty_like(spark: SparkSession, ddl: str) -> DataFrame:
    """A batch DataFrame of a declared schema with no rows."""
    return spark.createDataFrame([], struct(ddl))


_TYPES: dict[str, DataType] = {
    "STRING": StringType(),
    "BIGINT": LongType(),
    "INT": IntegerType(),
    "DOUBLE": DoubleType(),
}


def struct(ddl: str) -> StructType:
    """StructType of one of the flat declared schemas above (all nullable)."""
    fields = []
    for part in ddl.split(","):
        name, type_name = part.split()
        fields.append(StructField(name, _TYPES[type_name], True))
    return StructType(fields)
