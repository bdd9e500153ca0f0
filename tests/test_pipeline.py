"""Pipeline update end to end on CSV landing folders; reset and rerun."""

import os
import uuid

import pytest

from strata.plans.checks import schema_contract, tables_exist
from strata.plans.pipeline import Namespace, reset, run_update
from strata.schemas import BRONZE_CUSTOMERS, BRONZE_ORDERS, SILVER_SUMMARY, SILVER_SUMMARY_DDL
from tests.conftest import write_csv
from tests.fixtures import (
    CUSTOMER_ROWS,
    CUSTOMERS_HEADER,
    EXPECTED_SILVER,
    ORDER_ROWS,
    ORDERS_HEADER,
)


def _land(workdir):
    write_csv(f"{workdir}/landing/customers/c1.csv", CUSTOMERS_HEADER, CUSTOMER_ROWS)
    write_csv(f"{workdir}/landing/orders/o1.csv", ORDERS_HEADER, ORDER_ROWS[:3])
    write_csv(f"{workdir}/landing/orders/o2.csv", ORDERS_HEADER, ORDER_ROWS[3:])
    return f"{workdir}/landing/customers", f"{workdir}/landing/orders"


def test_update_builds_three_tables_and_is_idempotent(spark, workdir):
    customers, orders = _land(workdir)
    ns = Namespace(schema=f"t_{uuid.uuid4().hex[:8]}")
    ckpt = f"{workdir}/ckpt"
    silver = run_update(spark, customers, orders, ns, ckpt, location=f"{workdir}/wh")
    assert {tuple(r) for r in silver.collect()} == EXPECTED_SILVER
    assert all(tables_exist(spark, [ns.qualified(t) for t in (BRONZE_CUSTOMERS, BRONZE_ORDERS, SILVER_SUMMARY)]).values())
    assert all(c["ok"] for c in schema_contract(spark.read.table(ns.qualified(SILVER_SUMMARY)), SILVER_SUMMARY_DDL))
    comment = spark.sql(f"DESCRIBE TABLE EXTENDED {ns.qualified(SILVER_SUMMARY)}").where("col_name = 'Comment'").first()
    assert comment is not None and "roll-up" in comment["data_type"]
    # A second update with the same checkpoint adds nothing.
    again = run_update(spark, customers, orders, ns, ckpt, location=f"{workdir}/wh")
    assert {tuple(r) for r in again.collect()} == EXPECTED_SILVER
    assert spark.read.table(ns.qualified(BRONZE_ORDERS)).count() == len(ORDER_ROWS)


def test_reset_then_rerun_gives_the_same_state(spark, workdir):
    customers, orders = _land(workdir)
    ns = Namespace(schema=f"t_{uuid.uuid4().hex[:8]}")
    run_update(spark, customers, orders, ns, f"{workdir}/ckpt", location=f"{workdir}/wh")
    fresh = reset(spark, ns, workdir)
    assert not spark.catalog.databaseExists(ns.schema)
    assert fresh != f"{workdir}/ckpt"
    silver = run_update(spark, customers, orders, ns, fresh, location=f"{workdir}/wh2")
    assert {tuple(r) for r in silver.collect()} == EXPECTED_SILVER
    assert spark.read.table(ns.qualified(BRONZE_CUSTOMERS)).count() == len(CUSTOMER_ROWS)


def test_kept_tables_with_another_checkpoint_raise_and_lose_nothing(spark, workdir):
    customers, orders = _land(workdir)
    ns = Namespace(schema=f"t_{uuid.uuid4().hex[:8]}")
    run_update(spark, customers, orders, ns, f"{workdir}/ckpt", location=f"{workdir}/wh")
    write_csv(f"{workdir}/landing/orders/o3.csv", ORDERS_HEADER, ["7,5,1.00,2025-01-01"])
    with pytest.raises(ValueError, match="checkpoint"):
        run_update(spark, customers, orders, ns, f"{workdir}/other", location=f"{workdir}/wh")
    run_update(spark, customers, orders, ns, f"{workdir}/ckpt", location=f"{workdir}/wh")
    assert spark.read.table(ns.qualified(BRONZE_ORDERS)).count() == len(ORDER_ROWS) + 1


def test_planted_error_fails_then_the_corrected_drop_succeeds(spark, workdir):
    customers, orders = _land(workdir)
    ns = Namespace(schema=f"t_{uuid.uuid4().hex[:8]}")
    write_csv(f"{workdir}/landing/orders/bad.csv", ORDERS_HEADER.replace("customer_id", "customerid"), ORDER_ROWS[:1])
    with pytest.raises(Exception, match="customer"):
        run_update(spark, customers, orders, ns, f"{workdir}/ckpt", location=f"{workdir}/wh")
    assert not spark.streams.active
    os.remove(f"{workdir}/landing/orders/bad.csv")
    write_csv(f"{workdir}/landing/orders/bad.csv", ORDERS_HEADER, ["7,5,1.00,2025-01-01"])
    run_update(spark, customers, orders, ns, f"{workdir}/ckpt", location=f"{workdir}/wh")
    assert spark.read.table(ns.qualified(BRONZE_ORDERS)).count() == len(ORDER_ROWS) + 1
