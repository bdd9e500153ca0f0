"""

Every query reads the driver's tables (or data Spark derives from them) whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata import queries as more_queries
from strata.operators.gates import gate_summary, run_breaches, run_verdict
from strata.plans.checks import acceptance_checks
from strata.plans.pipeline import Namespace, reset, run_update
from strata.schemas import BRONZE_CUSTOMERS_DDL, BRONZE_ORDERS_DDL, SILVER_SUMMARY
from strata.session import scratch_dir
from strata.sources.landing import drops_glob, read_landing_stream, write_csv_drop
from strata.streaming.ingest import ingest
from strata.operators.rollup import customer_summary
from strata.operators.preview import preview
from strata.sources.tables import (
    bronze_customers_from_tables,
    bronze_orders_from_tables,
    defective_customers_from_tables,
    defective_orders_from_tables,
    displaced_orders_from_tables,
    runs_from_events,
)

try:  # this subpackage and its pipeline may be left out
    import corpus_pipeline
    from strata.llm import queries as llm_queries
except ModuleNotFoundError as e:
    if e.name not in ("corpus_pipeline", "strata.llm"):
        raise
    corpus_pipeline = llm_queries = None

SMOKE_DIR = "/root/testdata/sf0.001"


def _silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_summary(
        bronze_customers_from_tables(spark, sf_dir), bronze_orders_from_tables(spark, sf_dir)
    )


def _silver_displaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_summary(
        bronze_customers_from_tables(spark, sf_dir), displaced_orders_from_tables(spark, sf_dir)
    )


def _stored(spark: SparkSession, df: DataFrame, purpose: str) -> DataFrame:
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _silver_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of the stored silver table."""
    return preview(_stored(spark, _silver(spark, sf_dir), "silver"))


def _acceptance_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = bronze_customers_from_tables(spark, sf_dir)
    orders = bronze_orders_from_tables(spark, sf_dir)
    return acceptance_checks(customers, orders, _stored(spark, customer_summary(customers, orders), "silver"))


def _acceptance_checks_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks on defective tables, against the silver table of the sound orders."""
    customers = defective_customers_from_tables(spark, sf_dir)
    silver = customer_summary(customers, displaced_orders_from_tables(spark, sf_dir))
    return acceptance_checks(customers, defective_orders_from_tables(spark, sf_dir), _stored(spark, silver, "silver"))


def _run_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate_summary(runs_from_events(spark, sf_dir), ["event_type"])


def _run_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_breaches(runs_from_events(spark, sf_dir), ["event_type"])


def _run_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_verdict(runs_from_events(spark, sf_dir), ["event_type"])


# Split date of the two order drops: the first drop holds older orders, the
# second the rest (including any without a date); together they are the table.
DROP_SPLIT = "1998-01-01"


def _land_orders(spark: SparkSession, sf_dir: str, landing: str) -> list[str]:
    from pyspark.sql import functions as F

    orders = bronze_orders_from_tables(spark, sf_dir)
    older = F.col("order_date") < DROP_SPLIT
    first, second = f"{landing}/drop-0001", f"{landing}/drop-0002"
    write_csv_drop(orders.where(older), first)
    write_csv_drop(orders.where(~older | F.col("order_date").isNull()), second)
    return [first, second]


def _orders_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders landed as two CSV drops, ingested by two triggered runs."""
    from pyspark.sql import functions as F

    root = scratch_dir(spark, "orders-stream")
    landing, sink, checkpoint = f"{root}/landing/orders", f"{root}/bronze_orders", f"{root}/checkpoint"
    orders = bronze_orders_from_tables(spark, sf_dir)
    older = F.col("order_date") < DROP_SPLIT
    # First drop, first triggered run; then the second drop and a second run.
    write_csv_drop(orders.where(older), f"{landing}/drop-0001")
    ingest(read_landing_stream(spark, drops_glob(landing), BRONZE_ORDERS_DDL), checkpoint, path=sink)
    write_csv_drop(orders.where(~older | F.col("order_date").isNull()), f"{landing}/drop-0002")
    ingest(read_landing_stream(spark, drops_glob(landing), BRONZE_ORDERS_DDL), checkpoint, path=sink)
    return spark.read.parquet(sink)


def _customers_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "customers-stream")
    landing, sink = f"{root}/landing/customers", f"{root}/bronze_customers"
    write_csv_drop(bronze_customers_from_tables(spark, sf_dir), f"{landing}/drop-0001")
    ingest(
        read_landing_stream(spark, drops_glob(landing), BRONZE_CUSTOMERS_DDL),
        f"{root}/checkpoint",
        path=sink,
    )
    return spark.read.parquet(sink)


def _pipeline_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land both datasets as CSV, run one pipeline update, read silver back."""
    root = scratch_dir(spark, "pipeline")
    customers_landing, orders_landing = f"{root}/landing/customers", f"{root}/landing/orders"
    write_csv_drop(bronze_customers_from_tables(spark, sf_dir), f"{customers_landing}/drop-0001")
    _land_orders(spark, sf_dir, orders_landing)
    ns = Namespace(schema="strata_" + root.rsplit("-", 1)[-1])
    run_update(
        spark,
        drops_glob(customers_landing),
        drops_glob(orders_landing),
        ns,
        f"{root}/checkpoints",
        location=f"{root}/warehouse",
    )
    # The rows outlive the namespace, which is dropped.
    silver = _stored(spark, spark.read.table(ns.qualified(SILVER_SUMMARY)), "silver")
    reset(spark, ns, root)
    return silver


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the silver customer summary on sf0.001."""
    return _silver(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _own_queries() | ({**llm_queries.queries(), "pipeline": corpus_pipeline.run} if llm_queries else {})


def _own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "bronze_customers": bronze_customers_from_tables,
        "bronze_orders": bronze_orders_from_tables,
        "silver_customer_summary": _silver,
        "silver_displaced_orders": _silver_displaced,
        "silver_preview": _silver_preview,
        "acceptance_checks": _acceptance_checks,
        "acceptance_checks_defects": _acceptance_checks_defects,
        "bronze_orders_streamed": _orders_streamed,
        "bronze_customers_streamed": _customers_streamed,
        "pipeline_end_to_end": _pipeline_end_to_end,
        "run_gates": _run_gates,
        "run_verdict": _run_verdict,
        "run_breaches": _run_breaches,
        **more_queries.queries(),
    }


# ---------------------------------------------------------------------------
# DuckDB oracles. The CTEs restate the fixture rules of strata.sources.tables.

_BRONZE_CUSTOMERS = """
bronze_customers AS (
  SELECT CAST(c.c_custkey AS VARCHAR) AS id,
         c.c_name AS name,
         r.r_name AS region,
         CAST(DATE '1994-01-01' + CAST(c.c_custkey % 365 AS INTEGER) AS VARCHAR) AS signup_date
  FROM customer c
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

_BRONZE_ORDERS = """
bronze_orders AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
         CAST(o_custkey AS VARCHAR) AS customer_id,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount,
         CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date
  FROM orders
)"""

_DISPLACED_ORDERS = """
displaced_orders AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
         CASE o_orderpriority WHEN '1-URGENT' THEN CAST(o_custkey AS VARCHAR)
           WHEN '5-LOW' THEN 'lost-' || CAST(o_custkey AS VARCHAR) END AS customer_id,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount,
         CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date
  FROM orders
)"""

_DEFECTS = """
defective_customers AS (
  SELECT CASE WHEN CAST(id AS BIGINT) % 97 <> 0 THEN id END AS id, name, region, signup_date
  FROM bronze_customers, LATERAL (SELECT unnest(range(CASE WHEN CAST(id AS BIGINT) % 89 = 0 THEN 2 ELSE 1 END))) n
),
defective_orders AS (
  SELECT order_id, customer_id,
         CASE WHEN k % 101 = 0 THEN 'oops' WHEN k % 103 = 0 THEN '12345678901234567.00'
              WHEN k % 107 = 0 THEN amount || '000000001' ELSE amount END AS amount,
         CASE WHEN k % 109 = 0 THEN '1995-2-03' ELSE order_date END AS order_date
  FROM (SELECT *, CAST(order_id AS BIGINT) AS k FROM displaced_orders) o
)"""


def _silver_sql(orders_cte: str, customers_cte: str = "bronze_customers") -> str:
    return f"""
SELECT c.id, c.name, c.region,
       count(o.order_id) AS total_orders,
       CAST(sum(CAST(o.amount AS DECIMAL(18,2))) AS DOUBLE) AS total_amount,
       max(o.order_date) AS last_order_date
FROM {customers_cte} c LEFT JOIN {orders_cte} o ON c.id = o.customer_id
GROUP BY c.id, c.name, c.region"""


_RUNS = """
runs AS (
  SELECT cycle, event_type, outcome, reset_duration, reset_duration * 10 AS total_e2e_duration
  FROM (SELECT event_id AS cycle, event_type,
               CASE WHEN event_type = 'signup' OR (user_id % 10 <> 0 AND event_type <> 'error')
                 THEN 'pass' ELSE 'fail' END AS outcome,
               CASE WHEN event_type = 'signup' THEN value % 100 ELSE value END AS reset_duration
        FROM events) e
),
stacked AS (
  SELECT event_type, 'm1' AS metric, CAST(reset_duration AS DOUBLE) AS duration, 120.0 AS lim
  FROM runs WHERE outcome = 'pass'
  UNION ALL
  SELECT event_type, 'm2' AS metric, CAST(total_e2e_duration AS DOUBLE) AS duration, 1500.0 AS lim
  FROM runs WHERE outcome = 'pass'
),
frame AS (
  SELECT g.event_type, m.metric
  FROM (SELECT DISTINCT event_type FROM runs) g, (VALUES ('m1'), ('m2')) m(metric)
),
agg AS (
  SELECT event_type, metric, min(duration) AS mn, max(duration) AS mx,
         count(*) FILTER (WHERE duration < lim) AS under_limit, count(*) AS passed_runs
  FROM stacked GROUP BY event_type, metric
),
ranked AS (
  SELECT event_type, metric, duration,
         row_number() OVER (PARTITION BY event_type, metric ORDER BY duration) - 1 AS rn,
         count(*) OVER (PARTITION BY event_type, metric) AS n
  FROM stacked
),
med AS (
  SELECT event_type, metric, avg(duration) AS p50
  FROM ranked WHERE rn = (n - 1) // 2 OR rn = n // 2
  GROUP BY event_type, metric
),
gates AS (
  SELECT f.event_type, f.metric,
         coalesce(a.mn, 0.0) AS min, coalesce(a.mx, 0.0) AS max, coalesce(m.p50, 0.0) AS p50,
         coalesce(a.under_limit, 0) AS under_limit, coalesce(a.passed_runs, 0) AS passed_runs,
         (coalesce(a.under_limit, 0) = coalesce(a.passed_runs, 0) AND coalesce(a.passed_runs, 0) > 0)
           AS all_pass
  FROM frame f
  LEFT JOIN agg a ON f.event_type IS NOT DISTINCT FROM a.event_type AND f.metric = a.metric
  LEFT JOIN med m ON f.event_type IS NOT DISTINCT FROM m.event_type AND f.metric = m.metric
)"""

_VERDICT = """
SELECT c.event_type, c.cycles, c.cycles_passed, c.cycles - c.cycles_passed AS flakes,
       g.m1_all_pass, g.m2_all_pass,
       c.cycles_passed = c.cycles AS m3_pass,
       blockers = '' AS ready,
       CASE WHEN blockers = '' THEN 'READY' ELSE 'NOT READY' END AS verdict,
       blockers
FROM (SELECT event_type, count(*) AS cycles, count(*) FILTER (WHERE outcome = 'pass') AS cycles_passed
      FROM runs GROUP BY event_type) c
LEFT JOIN (SELECT event_type,
                  bool_and(CASE WHEN metric = 'm1' THEN all_pass END) AS m1_all_pass,
                  bool_and(CASE WHEN metric = 'm2' THEN all_pass END) AS m2_all_pass
           FROM gates GROUP BY event_type) g
  ON c.event_type IS NOT DISTINCT FROM g.event_type,
LATERAL (SELECT concat_ws('; ',
           CASE WHEN c.cycles - c.cycles_passed > 0
                THEN CAST(c.cycles - c.cycles_passed AS VARCHAR) || ' flake(s) detected' END,
           CASE WHEN NOT g.m1_all_pass THEN 'm1 gate failed' END,
           CASE WHEN NOT g.m2_all_pass THEN 'm2 gate failed' END) AS blockers) b"""


_BREACHES = """
SELECT event_type, cycle, metric, duration, lim AS "limit"
FROM (SELECT event_type, cycle, 'm1' AS metric, CAST(reset_duration AS DOUBLE) AS duration,
             CAST(120.0 AS DOUBLE) AS lim FROM runs WHERE outcome = 'pass'
      UNION ALL
      SELECT event_type, cycle, 'm2', CAST(total_e2e_duration AS DOUBLE), CAST(1500.0 AS DOUBLE) FROM runs
      WHERE outcome = 'pass') s
WHERE duration > lim"""


_CHECKS = """
per_id AS (SELECT id, count(*) AS copies FROM bronze_customers GROUP BY id),
cust AS (
  SELECT CAST(coalesce(sum(copies), 0) AS BIGINT) AS c_rows,
         count(id) AS c_distinct_ids,
         count(*) FILTER (WHERE id IS NOT NULL AND copies > 1) AS c_duplicate_ids,
         CAST(coalesce(sum(CASE WHEN id IS NULL THEN copies END), 0) AS BIGINT) AS c_null_ids
  FROM per_id
),
ords AS (
  SELECT count(*) AS o_rows,
         count(*) FILTER (WHERE customer_id IS NULL) AS o_null_customer,
         count(*) FILTER (WHERE amount IS NOT NULL AND TRY_CAST(amount AS DECIMAL(18,2)) IS NULL)
           AS o_bad_amounts,
         count(*) FILTER (WHERE TRY_CAST(amount AS DECIMAL(38,18)) <> TRY_CAST(amount AS DECIMAL(18,2)))
           AS o_rounded_amounts,
         count(*) FILTER (WHERE order_date IS NOT NULL
                            AND NOT coalesce(CAST(TRY_CAST(order_date AS DATE) AS VARCHAR) = order_date, false))
           AS o_non_iso_dates
  FROM bronze_orders
),
orphans AS (
  SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS orphan_orders
  FROM (SELECT customer_id, count(*) AS n FROM bronze_orders
        WHERE customer_id IS NOT NULL GROUP BY customer_id) p
  WHERE NOT EXISTS (SELECT 1 FROM bronze_customers c WHERE c.id = p.customer_id)
),
sil AS (
  SELECT count(*) AS s_rows, CAST(coalesce(sum(total_orders), 0) AS BIGINT) AS s_orders_rolled_up
  FROM silver
),
facts AS (SELECT * FROM cust, ords, orphans, sil)"""


def _check_rows() -> str:
    rows = [
        ("bronze_customers_nonempty", "c_rows", None, "c_rows > 0"),
        ("bronze_orders_nonempty", "o_rows", None, "o_rows > 0"),
        ("silver_nonempty", "s_rows", None, "s_rows > 0"),
        ("silver_rows_equal_distinct_customers", "s_rows", "c_distinct_ids", None),
        ("duplicate_customer_ids", "c_duplicate_ids", "0", None),
        ("null_customer_ids", "c_null_ids", "0", None),
        ("orders_without_customer_id", "o_null_customer", "0", None),
        ("orphan_orders", "orphan_orders", "0", None),
        ("bad_amounts", "o_bad_amounts", "0", None),
        ("rounded_amounts", "o_rounded_amounts", "0", None),
        ("non_iso_order_dates", "o_non_iso_dates", "0", None),
        ("orders_rolled_up_plus_unmatched", "s_orders_rolled_up + orphan_orders + o_null_customer", "o_rows", None),
    ]
    parts = []
    for name, observed, target, passed in rows:
        t = "CAST(NULL AS BIGINT)" if target is None else f"CAST({target} AS BIGINT)"
        p = passed if passed is not None else f"CAST({observed} AS BIGINT) = {t}"
        parts.append(
            f"SELECT '{name}' AS \"check\", CAST({observed} AS BIGINT) AS observed, {t} AS target, "
            f"{p} AS passed FROM facts"
        )
    return "\nUNION ALL\n".join(parts)


def oracle_sql() -> dict[str, str]:
    return _own_oracle_sql() | (llm_queries.oracle_sql() if llm_queries else {})


def _own_oracle_sql() -> dict[str, str]:
    silver = f"WITH {_BRONZE_CUSTOMERS}, {_BRONZE_ORDERS} {_silver_sql('bronze_orders')}"
    defective_checks = _CHECKS.replace("FROM bronze_", "FROM defective_")
    return {
        "bronze_customers": f"WITH {_BRONZE_CUSTOMERS} SELECT * FROM bronze_customers",
        "bronze_orders": f"WITH {_BRONZE_ORDERS} SELECT * FROM bronze_orders",
        "silver_customer_summary": silver,
        "silver_displaced_orders": (
            f"WITH {_BRONZE_CUSTOMERS}, {_DISPLACED_ORDERS} {_silver_sql('displaced_orders')}"
        ),
        "silver_preview": f"SELECT * FROM ({silver}) s ORDER BY id LIMIT 10",
        "acceptance_checks": (
            f"WITH {_BRONZE_CUSTOMERS}, {_BRONZE_ORDERS}, silver AS ({_silver_sql('bronze_orders')}),"
            f" {_CHECKS} {_check_rows()}"
        ),
        "acceptance_checks_defects": (
            f"WITH {_BRONZE_CUSTOMERS}, {_DISPLACED_ORDERS}, {_DEFECTS},"
            f" silver AS ({_silver_sql('displaced_orders', 'defective_customers')}),"
            f" {defective_checks} {_check_rows()}"
        ),
        "run_breaches": f"WITH {_RUNS} {_BREACHES}",
        "bronze_orders_streamed": f"WITH {_BRONZE_ORDERS} SELECT * FROM bronze_orders",
        "bronze_customers_streamed": f"WITH {_BRONZE_CUSTOMERS} SELECT * FROM bronze_customers",
        "pipeline_end_to_end": silver,
        "run_gates": f"WITH {_RUNS} SELECT * FROM gates",
        "run_verdict": f"WITH {_RUNS} {_VERDICT}",
        **more_queries.oracle_sql(_BRONZE_CUSTOMERS, _BRONZE_ORDERS, _DISPLACED_ORDERS, _DEFECTS, _silver_sql),
    }
