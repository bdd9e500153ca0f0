"""Checks on the medallion tables, one row per check.

``acceptance_checks`` reports presence, row parity and key / value quality as
``(check, observed, target, passed)``. It is one Spark query: every input is
reduced by a partial aggregate before it shuffles (customers once per id,
orders once per customer id), so a hot key costs one row per map task, and
one full outer join of the two reduced sides finds every key fact.

``schema_contract`` compares a table's schema with its declared DDL;
``tables_exist`` asks the catalog; ``require_columns`` fails early with the
columns that are missing (Spark's own analysis error names the nearest match).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.dates import iso_date_is_exact
from strata.functions.money import amount_has_excess_scale, amount_is_bad
from strata.schemas import struct


def _facts(df: DataFrame, names: list[str]) -> DataFrame:
    """One-row aggregate as long (fact, value) rows."""
    return df.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("fact"), F.col(n).cast("bigint").alias("value")) for n in names]))
    )


def acceptance_checks(customers: DataFrame, orders: DataFrame, silver: DataFrame) -> DataFrame:
    """``(check STRING, observed BIGINT, target BIGINT, passed BOOLEAN)``, one row per check.

    Customers are reduced to one row per id and orders to one row per
    customer id (with their value checks) before the single full outer join
    that finds orphans, duplicates and null keys; the silver facts come from
    one aggregate. The facts are unioned and pivoted by one global aggregate.
    """
    per_id = customers.groupBy("id").agg(F.count(F.lit(1)).alias("_copies"))
    per_customer = orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(amount_is_bad("amount")).alias("_bad"),
        F.count_if(amount_has_excess_scale("amount")).alias("_rounded"),
        F.count_if(
            F.col("order_date").isNotNull() & ~F.coalesce(iso_date_is_exact("order_date"), F.lit(False))
        ).alias("_non_iso"),
    )
    keyed = per_id.join(per_customer, per_id["id"] == per_customer["customer_id"], "full_outer")
    is_customer = F.col("_copies").isNotNull()
    is_order = F.col("_n").isNotNull()
    key_facts = keyed.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("c_rows"),
        F.count_if(is_customer & F.col("id").isNotNull()).alias("c_distinct_ids"),
        F.count_if(is_customer & F.col("id").isNotNull() & (F.col("_copies") > 1)).alias("c_duplicate_ids"),
        F.coalesce(F.sum(F.when(is_customer & F.col("id").isNull(), F.col("_copies"))), F.lit(0)).alias(
            "c_null_ids"
        ),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("o_rows"),
        F.coalesce(F.sum(F.when(is_order & F.col("customer_id").isNull(), F.col("_n"))), F.lit(0)).alias(
            "o_null_customer"
        ),
        F.coalesce(
            F.sum(F.when(is_order & ~is_customer & F.col("customer_id").isNotNull(), F.col("_n"))), F.lit(0)
        ).alias("orphan_orders"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("o_bad_amounts"),
        F.coalesce(F.sum("_rounded"), F.lit(0)).alias("o_rounded_amounts"),
        F.coalesce(F.sum("_non_iso"), F.lit(0)).alias("o_non_iso_dates"),
    )
    silver_facts = silver.agg(
        F.count(F.lit(1)).alias("s_rows"),
        F.coalesce(F.sum("total_orders"), F.lit(0)).alias("s_orders_rolled_up"),
    )
    long = _facts(key_facts, key_facts.columns).unionByName(_facts(silver_facts, silver_facts.columns))
    names = key_facts.columns + silver_facts.columns
    facts = long.agg(*[F.max(F.when(F.col("fact") == n, F.col("value"))).alias(n) for n in names])

    def check(name: str, observed, target=None, passed=None):
        observed = observed.cast("bigint")
        target_col = F.lit(None).cast("bigint") if target is None else target.cast("bigint")
        if passed is None:
            passed = observed == target_col
        return F.struct(
            F.lit(name).alias("check"),
            observed.alias("observed"),
            target_col.alias("target"),
            passed.alias("passed"),
        )

    zero = F.lit(0)
    c = F.col
    rows = F.array(
        check("bronze_customers_nonempty", c("c_rows"), passed=c("c_rows") > 0),
        check("bronze_orders_nonempty", c("o_rows"), passed=c("o_rows") > 0),
        check("silver_nonempty", c("s_rows"), passed=c("s_rows") > 0),
        check("silver_rows_equal_distinct_customers", c("s_rows"), c("c_distinct_ids")),
        check("duplicate_customer_ids", c("c_duplicate_ids"), zero),
        check("null_customer_ids", c("c_null_ids"), zero),
        check("orders_without_customer_id", c("o_null_customer"), zero),
        check("orphan_orders", c("orphan_orders"), zero),
        check("bad_amounts", c("o_bad_amounts"), zero),
        check("rounded_amounts", c("o_rounded_amounts"), zero),
        check("non_iso_order_dates", c("o_non_iso_dates"), zero),
        check(
            "orders_rolled_up_plus_unmatched",
            c("s_orders_rolled_up") + c("orphan_orders") + c("o_null_customer"),
            c("o_rows"),
        ),
    )
    return facts.select(F.inline(rows))


def schema_contract(df: DataFrame, ddl: str) -> list[dict]:
    """Per declared column: present, expected and actual type, ok. Extra columns too."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = []
    declared = struct(ddl)
    for f in declared.fields:
        got = actual.get(f.name)
        out.append(
            {
                "column": f.name,
                "expected": f.dataType.simpleString(),
                "actual": got,
                "ok": got == f.dataType.simpleString(),
            }
        )
    for name, got in actual.items():
        if name not in declared.fieldNames():
            out.append({"column": name, "expected": None, "actual": got, "ok": False})
    return out


def tables_exist(spark: SparkSession, names: list[str]) -> dict[str, bool]:
    """Catalog presence of each table, by its qualified name."""
    return {n: spark.catalog.tableExists(n) for n in names}


def require_columns(df: DataFrame, columns: list[str]) -> None:
    """Fail with the missing columns before any job is planned."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available: {df.columns}")
