"""Small hand-made inputs (invented rows, seed-shaped)."""

from strata.schemas import BRONZE_CUSTOMERS_DDL, BRONZE_ORDERS_DDL, struct

CUSTOMERS_HEADER = "id,name,region,signup_date"
ORDERS_HEADER = "order_id,customer_id,amount,order_date"

CUSTOMER_ROWS = [
    "1,Ada Lind,EU,2024-01-10",
    "2,Ben Okafor,EU,2024-02-11",
    "3,Chen Wu,APAC,2024-03-12",
    "4,Dana Ruiz,NA,2024-04-13",
    "5,Eli Sato,APAC,2024-05-14",
]
ORDER_ROWS = [
    "1,1,100.00,2024-02-01",
    "2,1,250.50,2024-06-01",
    "3,1,49.99,2025-01-15",
    "4,2,1000.00,2024-03-01",
    "5,2,0.01,2024-03-02",
    "6,4,75.25,2024-05-05",
]
# Expected silver rows: (id, name, region, total_orders, total_amount, last_order_date)
EXPECTED_SILVER = {
    ("1", "Ada Lind", "EU", 3, 400.49, "2025-01-15"),
    ("2", "Ben Okafor", "EU", 2, 1000.01, "2024-03-02"),
    ("3", "Chen Wu", "APAC", 0, None, None),
    ("4", "Dana Ruiz", "NA", 1, 75.25, "2024-05-05"),
    ("5", "Eli Sato", "APAC", 0, None, None),
}


def frames(spark, customer_rows=None, order_rows=None):
    def parse(rows):
        return [tuple(None if x == "" else x for x in r.split(",")) for r in rows]

    customers = spark.createDataFrame(parse(customer_rows or CUSTOMER_ROWS), struct(BRONZE_CUSTOMERS_DDL))
    orders = spark.createDataFrame(parse(order_rows if order_rows is not None else ORDER_ROWS), struct(BRONZE_ORDERS_DDL))
    return customers, orders
