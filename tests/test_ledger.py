import os

from pyspark.sql import functions as F

from strata.schemas import BRONZE_ORDERS_DDL
from strata.sources import ledger as L
from strata.sources.landing import upload
from tests.conftest import write_csv
from tests.fixtures import ORDER_ROWS, ORDERS_HEADER


def _statuses(checked):
    return {r["path"].rsplit("/", 1)[1]: r["status"] for r in checked.collect()}


def test_new_changed_unchanged_and_missing_files(spark, workdir):
    for name in ("a", "b", "c"):
        write_csv(f"{workdir}/orders/{name}.csv", ORDERS_HEADER, ORDER_ROWS[:2])
    first = L.Ledger(spark, f"{workdir}/orders")
    checked = first.check()
    assert _statuses(checked) == {"a.csv": "new", "b.csv": "new", "c.csv": "new"}
    second = first.keep(checked)
    write_csv(f"{workdir}/orders/b.csv", ORDERS_HEADER, ORDER_ROWS[:3])
    write_csv(f"{workdir}/orders/d.csv", ORDERS_HEADER, ORDER_ROWS[:1])
    os.remove(f"{workdir}/orders/c.csv")
    checked = second.check()
    assert _statuses(checked) == {"a.csv": "unchanged", "b.csv": "changed", "c.csv": "missing", "d.csv": "new"}
    changed = second.read(checked, BRONZE_ORDERS_DDL)
    assert changed.count() == 3 and {r["file"].rsplit("/", 1)[1] for r in changed.collect()} == {"b.csv"}
    third = second.keep(checked)
    assert set(_statuses(third.check()).values()) == {"unchanged"}
    assert third.read(third.check(), BRONZE_ORDERS_DDL).collect() == []


def test_many_changed_files_are_picked_by_a_join(spark, workdir, monkeypatch):
    monkeypatch.setattr(L, "FEW", 1)
    for name in ("a", "b", "c"):
        write_csv(f"{workdir}/orders/{name}.csv", ORDERS_HEADER, ORDER_ROWS[:2])
    ledger = L.Ledger(spark, f"{workdir}/orders")
    assert ledger.read(ledger.check(), BRONZE_ORDERS_DDL, "new").count() == 6


def test_upload_replaces_files_of_the_same_name(spark, workdir):
    rows = spark.range(20).selectExpr("CAST(id AS STRING) AS order_id", "'1' AS customer_id", "'2.00' AS amount", "'2025-01-01' AS order_date")
    place = F.col("order_id").cast("bigint") % 4
    upload(rows, place, 4, f"{workdir}/orders")
    assert sorted(x for x in os.listdir(f"{workdir}/orders") if x.endswith(".csv") and x[0] != ".") == [f"part-{i}.csv" for i in range(4)]
    upload(rows.where("order_id IN ('1', '2')"), place, 4, f"{workdir}/orders")
    lines = {i: len(open(f"{workdir}/orders/part-{i}.csv").readlines()) - 1 for i in range(4)}
    assert lines == {0: 5, 1: 1, 2: 1, 3: 5}
