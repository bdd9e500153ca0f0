import uuid

import pytest

from strata.operators.rollup import customer_summary
from strata.plans.contract import contract, schema_diff
from strata.plans.digest import table_digest
from strata.plans.pipeline import Namespace, create_declared_table, create_namespace, reset, run_update
from strata.plans.publish import NotPublished, publish_silver
from strata.schemas import BRONZE_CUSTOMERS_DDL, BRONZE_ORDERS, BRONZE_ORDERS_DDL, SILVER_SUMMARY, SILVER_SUMMARY_DDL, struct
from tests.conftest import write_csv
from tests.fixtures import CUSTOMER_ROWS, CUSTOMERS_HEADER, EXPECTED_SILVER, ORDER_ROWS, ORDERS_HEADER


def _frame(spark, rows, ddl):
    return spark.createDataFrame([tuple(x or None for x in r.split(",")) for r in rows], struct(ddl))


@pytest.fixture
def silver(spark, workdir):
    ns = Namespace(schema=f"p_{uuid.uuid4().hex[:8]}")
    create_namespace(spark, ns, f"{workdir}/it's a warehouse".replace("'", ""))
    create_declared_table(spark, ns, SILVER_SUMMARY)
    yield ns.qualified(SILVER_SUMMARY)
    reset(spark, ns, workdir)


def test_a_failing_version_leaves_the_old_rows(spark, silver):
    customers, orders = _frame(spark, CUSTOMER_ROWS, BRONZE_CUSTOMERS_DDL), _frame(spark, ORDER_ROWS, BRONZE_ORDERS_DDL)
    publish_silver(spark, silver, customer_summary(customers, orders), customers, orders, SILVER_SUMMARY_DDL)
    assert {tuple(r) for r in spark.read.table(silver).collect()} == EXPECTED_SILVER
    reader = spark.read.table(silver)
    short = customer_summary(customers, orders).limit(1)
    with pytest.raises(NotPublished) as e:
        publish_silver(spark, silver, short, customers, orders, SILVER_SUMMARY_DDL)
    assert "silver_rows_equal_distinct_customers" in e.value.failed
    assert {tuple(r) for r in spark.read.table(silver).collect()} == EXPECTED_SILVER
    # A version that passes; those who read the old one still can.
    fewer = orders.limit(3)
    publish_silver(spark, silver, customer_summary(customers, fewer), customers, fewer, SILVER_SUMMARY_DDL)
    assert spark.read.table(silver).selectExpr("sum(total_orders)").first()[0] <= 3
    assert {tuple(r) for r in reader.collect()} == EXPECTED_SILVER


def test_an_empty_silver_is_not_published(spark, silver):
    customers, orders = _frame(spark, CUSTOMER_ROWS, BRONZE_CUSTOMERS_DDL), _frame(spark, ORDER_ROWS, BRONZE_ORDERS_DDL)
    with pytest.raises(NotPublished, match="silver_nonempty"):
        publish_silver(spark, silver, customer_summary(customers, orders).limit(0), customers, orders, SILVER_SUMMARY_DDL)


def test_an_update_whose_checks_fail_keeps_the_published_silver(spark, workdir):
    write_csv(f"{workdir}/customers/c1.csv", CUSTOMERS_HEADER, CUSTOMER_ROWS)
    write_csv(f"{workdir}/orders/o1.csv", ORDERS_HEADER, ORDER_ROWS)
    ns = Namespace(schema=f"p_{uuid.uuid4().hex[:8]}")
    run = lambda: run_update(spark, f"{workdir}/customers", f"{workdir}/orders", ns, f"{workdir}/it's", location=f"{workdir}/wh")
    run()
    # The same customer with another name: one id, two silver rows.
    first = CUSTOMER_ROWS[0].split(",")
    write_csv(f"{workdir}/customers/c2.csv", CUSTOMERS_HEADER, [",".join([first[0], "Other", *first[2:]])])
    with pytest.raises(NotPublished):
        run()
    assert {tuple(r) for r in spark.read.table(ns.qualified(SILVER_SUMMARY)).collect()} == EXPECTED_SILVER
    assert spark.read.table(ns.qualified(BRONZE_ORDERS)).count() == len(ORDER_ROWS)


def test_digest_ignores_order_and_sees_every_change(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "b"), (1, "a")], "x int, y string")
    digest = lambda d: tuple(table_digest(d).first())
    assert digest(df) == digest(df.repartition(3).orderBy("y")) == digest(df.select("y", "x"))
    assert digest(df) != digest(df.distinct())
    assert digest(df.where("x = 1")) != digest(df.where("x = 1").selectExpr("x", "'c' AS y"))
    swapped = spark.createDataFrame([("1", "2")], "x string, y string")
    assert digest(swapped) != digest(swapped.selectExpr("y AS x", "x AS y"))
    nulls = spark.createDataFrame([(None, "2")], "x string, y string")
    assert digest(nulls) != digest(nulls.selectExpr("y AS x", "x AS y"))


def test_schema_diff_names_the_nearest_column(spark):
    df = spark.createDataFrame([("1", "2", 3.0, 4)], "order_id string, customerid string, amount double, customer_idx int")
    got = {r["column"]: r for r in schema_diff(df, BRONZE_ORDERS_DDL).collect()}
    assert got["order_id"]["status"] == "ok" and got["amount"]["status"] == "retyped"
    missing = got["customer_id"]
    # Both names are one edit away; the type decides.
    assert (missing["status"], missing["suggestion"], missing["edits"], missing["type_distance"]) == ("missing", "customerid", 1, 0)
    assert got["customerid"]["status"] == "unexpected" and got["order_date"]["suggestion"] is not None
    filled = {r["column"]: (r["rows"], r["filled"]) for r in contract(df, BRONZE_ORDERS_DDL).collect()}
    assert filled["order_id"] == (1, 1) and filled["customer_id"] == (None, None)


def test_schema_diff_of_a_sound_table_suggests_nothing(spark):
    df = spark.createDataFrame([], struct(BRONZE_ORDERS_DDL))
    assert {(r["status"], r["suggestion"]) for r in schema_diff(df, BRONZE_ORDERS_DDL).collect()} == {("ok", None)}
