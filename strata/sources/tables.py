"""Table scans and the fixture rules that shape the driver's test tables into
the bronze contracts and a runs table.

The projections are plain column expressions over parquet scans, so column
pruning and predicate pushdown reach the files. Nation and region are fixed
size dimensions (25 and 5 rows); Catalyst broadcasts them from file
statistics under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles
otherwise, so no hint is forced here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.money import AMOUNT_TYPE

# Fixed values of the fixture rules (not reference semantics):
# signup dates are spread over one year from this day, earlier than any order.
SIGNUP_EPOCH = "1994-01-01"
SIGNUP_SPREAD_DAYS = 365
# Run outcome rule for events: a run fails when user_id is a multiple of ten.
RUN_FAIL_EVERY = 10
# Event types whose runs all fail, or all pass.
FAILING_TYPE, STEADY_TYPE = "error", "signup"
# e2e duration of a derived run is this many times its reset duration.
E2E_FACTOR = 10


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as parquet."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bronze_customers_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer ⋈ nation ⋈ region`` in the ``bronze_customers`` shape, all STRING."""
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = load(spark, sf_dir, "region").select("r_regionkey", "r_name")
    signup = F.date_add(
        F.lit(SIGNUP_EPOCH).cast("date"), (F.col("c_custkey") % SIGNUP_SPREAD_DAYS).cast("int")
    )
    return (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
        .join(region, F.col("n_regionkey") == region.r_regionkey, "left")
        .select(
            F.col("c_custkey").cast("string").alias("id"),
            F.col("c_name").alias("name"),
            F.col("r_name").alias("region"),
            signup.cast("string").alias("signup_date"),
        )
    )


def _orders_shape(orders: DataFrame, owner: Column) -> DataFrame:
    """Driver orders in the ``bronze_orders`` shape, all STRING.

    The amount goes through DECIMAL(18,2) so its text form has two digits
    after the point, as in the landing CSVs.
    """
    return orders.select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        owner.alias("customer_id"),
        F.col("o_totalprice").cast(AMOUNT_TYPE).cast("string").alias("amount"),
        F.col("o_orderdate").cast("date").cast("string").alias("order_date"),
    )


def bronze_orders_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` in the ``bronze_orders`` shape."""
    return _orders_shape(load(spark, sf_dir, "orders"), F.col("o_custkey").cast("string"))


def displaced_orders_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders; only ``1-URGENT`` ones keep their customer.

    ``5-LOW`` orders name a customer that does not exist, the others none: so
    customers without orders, orphans and null keys all appear.
    """
    orders = load(spark, sf_dir, "orders")
    priority = F.col("o_orderpriority")
    customer = F.col("o_custkey").cast("string")
    owner = F.when(priority == "1-URGENT", customer).when(priority == "5-LOW", F.concat(F.lit("lost-"), customer))
    return _orders_shape(orders, owner)


def defective_customers_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers; some ids are null, some rows come twice."""
    customers = bronze_customers_from_tables(spark, sf_dir)
    key = F.col("id").cast("bigint")
    copies = F.when(key % 89 == 0, 2).otherwise(1)
    return customers.withColumn("_n", F.explode(F.sequence(F.lit(1), copies))).select(
        F.when(key % 97 != 0, F.col("id")).alias("id"), "name", "region", "signup_date"
    )


def defective_orders_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All displaced orders; some amounts are no numbers, too large or too fine, some dates are not ISO."""
    orders = displaced_orders_from_tables(spark, sf_dir)
    key = F.col("order_id").cast("bigint")
    amount = (
        F.when(key % 101 == 0, F.lit("oops"))
        .when(key % 103 == 0, F.lit("12345678901234567.00"))
        .when(key % 107 == 0, F.concat("amount", F.lit("000000001")))
        .otherwise(F.col("amount"))
    )
    date = F.when(key % 109 == 0, F.lit("1995-2-03")).otherwise(F.col("order_date"))
    return orders.select("order_id", "customer_id", amount.alias("amount"), date.alias("order_date"))


def runs_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dry-run cycle per event: the runs table the gate summary reads.

    ``outcome`` is ``fail`` for every tenth user, for every run of ``FAILING_TYPE`` and for
    none of ``STEADY_TYPE``, whose durations also stay under the limits; the reset
    duration is the event value and the end-to-end duration ``E2E_FACTOR`` times it.
    The event type is kept as the grouping column of the summary.
    """
    events = load(spark, sf_dir, "events")
    steady = F.col("event_type") == STEADY_TYPE
    passed = steady | ((F.col("user_id") % RUN_FAIL_EVERY != 0) & (F.col("event_type") != FAILING_TYPE))
    reset = F.when(steady, F.pmod(F.col("value"), F.lit(100.0))).otherwise(F.col("value"))
    return events.select(
        F.col("event_id").alias("cycle"),
        F.col("event_type"),
        F.when(passed, "pass").otherwise("fail").alias("outcome"),
        reset.alias("reset_duration"),
        (reset * E2E_FACTOR).alias("total_e2e_duration"),
    )
