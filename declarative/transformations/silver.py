"""Silver materialized view (declarative form): reads both bronze tables."""

from pyspark import pipelines as dp
from pyspark.sql import SparkSession

from strata.operators.rollup import customer_summary
from strata.schemas import BRONZE_CUSTOMERS, BRONZE_ORDERS, COMMENTS, SILVER_SUMMARY, SILVER_SUMMARY_DDL

spark = SparkSession.active()


@dp.materialized_view(name=SILVER_SUMMARY, comment=COMMENTS[SILVER_SUMMARY], schema=SILVER_SUMMARY_DDL)
def silver_customer_summary():
    return customer_summary(spark.read.table(BRONZE_CUSTOMERS), spark.read.table(BRONZE_ORDERS))
