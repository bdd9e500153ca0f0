"""The silver roll-up: one row per customer with order count, exact total and
last order date, by a left outer join of customers to orders.

It aggregates before it joins. Orders are summed per ``customer_id`` with a
map-side partial aggregate, so the shuffle carries at most one row per customer
per map task and a hot customer holding a third of all orders collapses before
any exchange. Identical customer rows are collapsed the same way into a copy
count ``k``; the join then pairs at most one aggregate row with each distinct
customer row, and the totals are scaled by ``k``. That reproduces joining first and
grouping after exactly, including duplicate customer rows (each copy matches every
order, so counts and sums multiply by ``k``; the latest date does not change).

Money is summed as DECIMAL(18,2) and cast to DOUBLE once, so totals do not
depend on row order. A non-numeric amount fails the refresh under ANSI. The
latest order date is the string maximum (see ``strata.functions.dates``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.dates import iso_date_is_exact, latest_date_text
from strata.functions.money import amount_value, money_to_double

_KEYS = ["id", "name", "region"]


def per_customer_orders(orders: DataFrame) -> DataFrame:
    """Orders reduced to one row per ``customer_id`` (partial + final aggregate)."""
    known = orders.where(F.col("customer_id").isNotNull())
    exact = F.coalesce(iso_date_is_exact("order_date"), F.lit(False))
    # Dates that are not ISO text (as a rule none) are groups of their own, so that the aggregate
    # over all orders keeps its latest date as a DATE and needs no sort.
    odd = F.when(~exact, F.col("order_date")).alias("_odd")
    per_date = known.groupBy("customer_id", odd).agg(
        F.count("order_id").alias("_orders"),
        F.sum(amount_value("amount")).alias("_amount"),
        F.max(F.when(exact, F.col("order_date").try_cast("date"))).alias("_iso"),
    )
    totals = per_date.groupBy("customer_id").agg(
        F.sum("_orders").alias("_orders"),
        F.sum("_amount").alias("_amount"),
        F.max("_iso").alias("_iso"),
        F.max("_odd").alias("_odd"),
    )
    return totals.select("customer_id", "_orders", "_amount", latest_date_text(F.col("_iso"), F.col("_odd")).alias("_last"))


def customer_summary(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Silver customer summary, aggregating both sides before the join."""
    distinct_customers = customers.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("_copies"))
    totals = per_customer_orders(orders)
    joined = distinct_customers.join(
        totals, distinct_customers["id"] == totals["customer_id"], "left"
    )
    copies = F.col("_copies")
    return joined.select(
        "id",
        "name",
        "region",
        (F.coalesce(F.col("_orders"), F.lit(0)) * copies).cast("bigint").alias("total_orders"),
        money_to_double(F.col("_amount") * copies).alias("total_amount"),
        F.col("_last").alias("last_order_date"),
    )
