"""Bronze streaming tables (declarative form): thin wrappers over strata."""

from pyspark import pipelines as dp
from pyspark.sql import SparkSession

from strata.schemas import (
    BRONZE_CUSTOMERS,
    BRONZE_CUSTOMERS_DDL,
    BRONZE_ORDERS,
    BRONZE_ORDERS_DDL,
    COMMENTS,
)
from strata.sources.landing import read_landing_stream

spark = SparkSession.active()


@dp.table(name=BRONZE_CUSTOMERS, comment=COMMENTS[BRONZE_CUSTOMERS], schema=BRONZE_CUSTOMERS_DDL)
def bronze_customers():
    return read_landing_stream(spark, spark.conf.get("strata.landing.customers"), BRONZE_CUSTOMERS_DDL)


@dp.table(name=BRONZE_ORDERS, comment=COMMENTS[BRONZE_ORDERS], schema=BRONZE_ORDERS_DDL)
def bronze_orders():
    return read_landing_stream(spark, spark.conf.get("strata.landing.orders"), BRONZE_ORDERS_DDL)
