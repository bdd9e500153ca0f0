import pytest

from strata.operators.rollup import customer_summary
from strata.operators.preview import preview
from strata.plans.checks import acceptance_checks, require_columns, schema_contract
from strata.schemas import BRONZE_ORDERS_DDL, SILVER_SUMMARY_DDL, empty_like
from tests.fixtures import frames


def _checks(spark, customers, orders):
    out = acceptance_checks(customers, orders, customer_summary(customers, orders))
    return {r["check"]: (r["observed"], r["target"], r["passed"]) for r in out.collect()}


def test_clean_tables_pass_every_check(spark):
    customers, orders = frames(spark)
    checks = _checks(spark, customers, orders)
    assert all(p for _, _, p in checks.values()), checks
    assert checks["silver_rows_equal_distinct_customers"] == (5, 5, True)
    assert checks["orders_rolled_up_plus_unmatched"] == (6, 6, True)


def test_duplicate_id_fails_uniqueness(spark):
    customers, orders = frames(spark, ["7,Twin,EU,2024-01-01", "7,Twin,EU,2024-01-01"], ["1,7,5.00,2024-02-02"])
    checks = _checks(spark, customers, orders)
    assert checks["duplicate_customer_ids"] == (1, 0, False)
    assert checks["orders_rolled_up_plus_unmatched"][2] is False  # 2 rolled up for 1 order


def test_orphans_nulls_and_rounded_amounts_are_counted(spark):
    customers, orders = frames(
        spark,
        ["1,A,EU,2024-01-01", ",B,NA,2024-01-01"],
        ["1,1,1.005,2024-02-02", "2,99,3.00,2024-02-03", "3,,4.00,2024-02-04", "4,1,5.00,2024/02/05"],
    )
    customers_ok = customers
    orders_no_bad_date = orders.where("order_id <> '4'")
    checks = _checks(spark, customers_ok, orders_no_bad_date)
    assert checks["null_customer_ids"] == (1, 0, False)
    assert checks["orphan_orders"] == (1, 0, False)
    assert checks["orders_without_customer_id"] == (1, 0, False)
    assert checks["rounded_amounts"] == (1, 0, False)
    assert checks["silver_rows_equal_distinct_customers"] == (2, 1, False)
    # A non-ISO date is reported by the check even though the roll-up would fail on it.
    from pyspark.sql import functions as F
    from strata.plans import checks as C

    non_iso = orders.agg(
        F.count_if(F.col("order_date").isNotNull() & ~F.coalesce(C.iso_date_is_exact("order_date"), F.lit(False)))
    ).first()[0]
    assert non_iso == 1


def test_bad_amount_is_reported_without_failing(spark):
    customers, orders = frames(spark, ["1,A,EU,2024-01-01"], ["1,1,oops,2024-02-02"])
    silver = empty_like(spark, SILVER_SUMMARY_DDL)  # the refresh itself would fail
    out = {r["check"]: r["observed"] for r in acceptance_checks(customers, orders, silver).collect()}
    assert out["bad_amounts"] == 1


def test_schema_contract_flags_wrong_names(spark):
    _, orders = frames(spark)
    renamed = orders.withColumnRenamed("customer_id", "customerid")
    report = {c["column"]: c["ok"] for c in schema_contract(renamed, BRONZE_ORDERS_DDL)}
    assert report["customer_id"] is False and report["customerid"] is False
    assert report["order_id"] is True
    with pytest.raises(ValueError, match="customer_id"):
        require_columns(renamed, ["order_id", "customer_id"])


def test_preview(spark):
    customers, orders = frames(spark)
    top = preview(customer_summary(customers, orders), n=2).collect()
    assert [r["id"] for r in top] == ["1", "2"]


def test_too_large_and_too_fine_amounts_are_reported(spark):
    customers, orders = frames(
        spark, ["1,A,EU,2024-01-01"], ["1,1,12345678901234567.00,2024-02-02", "2,1,1.00000000001,2024-02-02"]
    )
    out = {r["check"]: r["observed"] for r in acceptance_checks(customers, orders, empty_like(spark, SILVER_SUMMARY_DDL)).collect()}
    assert out["bad_amounts"] == 1 and out["rounded_amounts"] == 1
