"""A run shaped like the seed: 40 customers, 50 orders, 14 customers without one, those with several at low ids.

The rows are made here by rule; what the seed's profile fixes (counts by region and by orders) is asserted
as such, amounts and dates against exact arithmetic.
"""

import datetime as dt
import uuid
from collections import Counter
from decimal import Decimal

from strata.operators.preview import preview
from strata.plans.pipeline import Namespace, reset, run_update
from strata.schemas import BRONZE_CUSTOMERS, BRONZE_ORDERS
from tests.conftest import write_csv
from tests.fixtures import CUSTOMERS_HEADER, ORDERS_HEADER

# Orders of each customer, by id from 1: 15 in EU, 15 in NA, 10 in APAC.
ORDERS = [4] * 3 + [2] * 12 + [2] * 3 + [1] * 8 + [0] * 4 + [0] * 10
REGIONS = ["EU"] * 15 + ["NA"] * 15 + ["APAC"] * 10


def _rows():
    customers, orders, expected = [], [], {}
    signup = dt.date(2024, 1, 15)
    for i, (n, region) in enumerate(zip(ORDERS, REGIONS, strict=True), 1):
        joined = signup + dt.timedelta(days=16 * i)
        customers.append(f"{i},Customer {i},{region},{joined}")
        own = []
        for k in range(n):
            amount = Decimal(3550 + 9949 * i * (k + 1) % 496450) / 100
            day = joined + dt.timedelta(days=26 + 7 * k)
            own.append((amount, str(day)))
            orders.append(f"{len(orders) + 1},{i},{amount:.2f},{day}")
        total = float(sum(a for a, _ in own)) if own else None
        expected[str(i)] = (f"Customer {i}", region, n, total, max((d for _, d in own), default=None))
    return customers, orders, expected


def test_seed_shaped_run(spark, workdir):
    customers, orders, expected = _rows()
    write_csv(f"{workdir}/customers/customers.csv", CUSTOMERS_HEADER, customers)
    write_csv(f"{workdir}/orders/orders.csv", ORDERS_HEADER, orders)
    ns = Namespace(schema=f"g_{uuid.uuid4().hex[:8]}")
    silver = run_update(spark, f"{workdir}/customers", f"{workdir}/orders", ns, f"{workdir}/ckpt", location=f"{workdir}/wh")
    rows = silver.collect()
    counts = [spark.read.table(ns.qualified(t)).count() for t in (BRONZE_CUSTOMERS, BRONZE_ORDERS)]
    assert counts == [40, 50]
    assert {r["id"]: tuple(r)[1:] for r in rows} == expected
    assert Counter(r["total_orders"] for r in rows) == {0: 14, 1: 8, 2: 15, 4: 3}
    by_region = Counter()
    for r in rows:
        by_region[r["region"], "customers"] += 1
        by_region[r["region"], "without"] += r["total_orders"] == 0
        by_region[r["region"], "orders"] += r["total_orders"]
    assert [by_region["EU", k] for k in ("customers", "without", "orders")] == [15, 0, 36]
    assert [by_region["NA", k] for k in ("customers", "without", "orders")] == [15, 4, 14]
    assert [by_region["APAC", k] for k in ("customers", "without", "orders")] == [10, 10, 0]
    assert all(r["total_amount"] is None and r["last_order_date"] is None for r in rows if not r["total_orders"])
    assert [r["id"] for r in preview(silver).collect()] == sorted(expected)[:10]
    reset(spark, ns, workdir)
