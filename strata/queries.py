"""Registered queries over run metrics, landed files, batches, published versions and contracts.

Each lands the driver's tables in the form its job reads (JSON documents, CSV uploads), through
Spark, and then runs the library's own code over all of it. The oracles restate the rules that shape the
landed rows (see ``strata.sources.tables``) and take their CTEs from the caller.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.gates import failure_phases, run_verdict
from strata.operators.rollup import customer_summary
from strata.plans.contract import contract
from strata.plans.digest import Updates
from strata.plans.pipeline import Namespace, create_declared_table, create_namespace, reset, run_update
from strata.plans.publish import NotPublished, publish_silver
from strata.schemas import (
    BRONZE_CUSTOMERS,
    BRONZE_CUSTOMERS_DDL,
    BRONZE_ORDERS,
    BRONZE_ORDERS_DDL,
    COMMENTS,
    SILVER_SUMMARY,
    SILVER_SUMMARY_DDL,
)
from strata.session import scratch_dir, staged
from strata.sources.landing import drops_glob, read_landing_stream, upload, write_csv_drop
from strata.sources.ledger import Ledger
from strata.sources.metrics import RUN_COLUMNS, cycles_of_metrics, latest_cycles, notes, read_cycles, read_metrics
from strata.sources.tables import (
    bronze_customers_from_tables,
    bronze_orders_from_tables,
    defective_customers_from_tables,
    displaced_orders_from_tables,
    load,
)
from strata.streaming.batches import BatchTable

# Fixed values of the landed rows: cycles of a run, files of an upload, the date between two drops.
CYCLES, FILES, SPLIT = 2000, 8, "1998-01-01"


# --- run metrics as JSON -----------------------------------------------------------------------


def cycles_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cycle per event: run (a block of ids), then a run's columns. Phases after a failure have no duration."""
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    failed = (F.col("user_id") % 10 == 0) & (F.col("event_type") != "signup")
    phase = F.when(failed, F.element_at(F.array(F.lit("reset"), F.lit("seed"), F.lit("verify")), (F.col("event_id") % 3 + 1).cast("int")))
    rows = events.withColumn("phase", phase).withColumn("reset", F.floor("value").cast("bigint"))
    reached = F.coalesce("phase", F.lit("")).isin
    columns = {
        "cycle": (F.col("event_id") % CYCLES + 1).cast("int"),
        "hard_mode": F.when(F.col("event_id") % CYCLES == 2, 1).otherwise(0),
        "reset_duration": F.col("reset"),
        "health_check_duration": F.lit(5).cast("bigint"),
        "seed_duration": F.when(~reached("reset", "seed"), F.col("reset") % 60),
        "demo_duration": F.when(~reached("reset", "seed"), F.col("reset") * 8),
        "verify_duration": F.when(F.col("phase").isNull(), F.col("reset") % 7),
        "total_e2e_duration": F.col("reset") * 10,
        "outcome": F.when(F.col("phase").isNull(), "pass").otherwise("fail"),
        "failure_phase": F.col("phase"),
    }
    run = F.concat(F.lit("run-"), F.floor(F.col("event_id") / CYCLES).cast("string"))
    return rows.select(run.alias("run"), *[c.alias(name) for name, c in columns.items()])


def land_metrics(spark: SparkSession, sf_dir: str) -> str:
    """Each run's folders: a document with half of its cycles (seconds not final), one with all, files of passing cycles."""
    root = scratch_dir(spark, "metrics")
    cycles = cycles_from_events(spark, sf_dir)

    def documents(rows: DataFrame) -> DataFrame:
        note = F.concat(F.lit("Cycle "), F.col("cycle").cast("string"), F.lit(": "), F.col("failure_phase"), F.lit(" failed"))
        rows = rows.withColumn("note", F.when(F.col("failure_phase").isNotNull(), F.struct("cycle", note.alias("note"))))
        return rows.groupBy("run").agg(
            F.count(F.lit(1)).cast("int").alias("total_cycles"),
            F.lit(3).alias("hard_mode_cycle"),
            F.sort_array(F.collect_list(F.struct(*RUN_COLUMNS))).alias("cycles"),
            F.transform(F.sort_array(F.collect_list("note")), lambda x: x["note"]).alias("notes"),
        )

    early = cycles.where("cycle % 2 = 0").withColumn("total_e2e_duration", F.col("total_e2e_duration") + 1)
    documents(early).write.partitionBy("run").json(f"{root}/documents/at=1")
    documents(cycles).write.partitionBy("run").json(f"{root}/documents/at=2")
    cycles.where("outcome = 'pass'").write.partitionBy("run").json(f"{root}/cycles")
    return root


def _landed_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    root = land_metrics(spark, sf_dir)
    documents = read_metrics(spark, f"{root}/documents")
    files = read_cycles(spark, f"{root}/cycles", glob="*.json", documents=False)
    runs = latest_cycles(cycles_of_metrics(documents), files)
    # Spark's writer names a run's folder run=<name>.
    return runs.withColumn("run", F.regexp_replace("run", "^run=", "")), documents


def metrics_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of each run, from its latest JSON files."""
    return run_verdict(_landed_runs(spark, sf_dir)[0], ["run"])


def metrics_failure_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failed cycles of each run by phase, and the notes its latest document has on them."""
    runs, documents = _landed_runs(spark, sf_dir)
    said = notes(documents).select(F.regexp_replace("run", "^run=", "").alias("run"), "note")
    phase = F.regexp_extract("note", r"^Cycle \d+: (\w+) failed$", 1).alias("phase")
    said = said.groupBy(F.col("run").alias("_run"), phase).agg(F.count(F.lit(1)).alias("notes"))
    phases = failure_phases(runs, ["run"])
    same = (F.col("run") == F.col("_run")) & (F.col("failure_phase") == F.col("phase"))
    return phases.join(said, same, "left").select(*phases.columns, F.coalesce("notes", F.lit(0)).alias("notes"))


# --- landed files ------------------------------------------------------------------------------


def landing_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(drop, status, files, rows): three looks at a folder whose files come, change in place and stay."""
    folder = f"{scratch_dir(spark, 'uploads')}/orders"
    orders = bronze_orders_from_tables(spark, sf_dir)
    place = F.col("order_id").cast("bigint") % FILES
    older = F.col("order_date") < SPLIT
    later = orders.where(~older | F.col("order_date").isNull())
    out, ledger = None, Ledger(spark, folder)
    for drop in (1, 2, 3):
        if drop == 1:
            upload(orders.where(older), place, FILES, folder)
        if drop == 2:
            upload(later.where(place < 3), place, FILES, folder)
            upload(later.where(place >= 6), place, FILES, folder, prefix="late")
        checked = ledger.check()
        files = checked.groupBy("status").agg(F.count(F.lit(1)).alias("files"))
        rows = ledger.read(checked, BRONZE_ORDERS_DDL, "new").withColumn("status", F.lit("new"))
        rows = rows.unionByName(ledger.read(checked, BRONZE_ORDERS_DDL).withColumn("status", F.lit("changed")))
        rows = rows.groupBy(F.col("status").alias("_status")).agg(F.count(F.lit(1)).alias("rows"))
        seen = files.join(rows, F.col("status") == F.col("_status"), "left")
        seen = seen.select(F.lit(drop).cast("bigint").alias("drop"), "status", "files", F.coalesce("rows", F.lit(0)).alias("rows"))
        seen = staged(seen, "ledger-seen")
        out = seen if out is None else out.unionByName(seen)
        ledger = ledger.keep(checked)
    return out


# --- batches -----------------------------------------------------------------------------------


class _Crash(RuntimeError):
    pass


def _crash() -> None:
    raise _Crash("between rows and ledger entry")


def _land_drops(spark: SparkSession, sf_dir: str, landing: str, drop: int) -> None:
    orders = bronze_orders_from_tables(spark, sf_dir)
    older = F.col("order_date") < SPLIT
    write_csv_drop(orders.where(older if drop == 1 else ~older | F.col("order_date").isNull()), f"{landing}/drop-{drop}")


def _replayed_orders(spark: SparkSession, sf_dir: str) -> BatchTable:
    """Orders in two drops: the second one's batch crashes and is replayed, then a new checkpoint lists all files again."""
    root = scratch_dir(spark, "replayed")
    landing, table = f"{root}/landing", BatchTable(spark, f"{root}/orders", BRONZE_ORDERS_DDL)

    def run(checkpoint: str, between: Callable[[], None] | None = None) -> None:
        stream = read_landing_stream(spark, drops_glob(landing), BRONZE_ORDERS_DDL)
        table.start(stream, f"{root}/{checkpoint}", between).awaitTermination()

    _land_drops(spark, sf_dir, landing, 1)
    run("checkpoint")
    _land_drops(spark, sf_dir, landing, 2)
    try:
        run("checkpoint", _crash)
    except StreamingQueryException:
        pass
    run("checkpoint")
    run("another")
    return table


def bronze_orders_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders after a crash between rows and entry, a replay and a change of checkpoint."""
    return _replayed_orders(spark, sf_dir).rows()


def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, landed, stored, kept): rows that came, rows that writes observed, rows that readers see."""
    root = scratch_dir(spark, "counted")
    customers = BatchTable(spark, f"{root}/customers", BRONZE_CUSTOMERS_DDL)
    write_csv_drop(bronze_customers_from_tables(spark, sf_dir), f"{root}/landing/drop-1")
    stream = read_landing_stream(spark, drops_glob(f"{root}/landing"), BRONZE_CUSTOMERS_DDL)
    customers.start(stream, f"{root}/checkpoint").awaitTermination()
    out = None
    for name, table in (("customers", customers), ("orders", _replayed_orders(spark, sf_dir))):
        sums = table.counts().agg(F.sum("landed").alias("landed"), F.sum("stored").alias("stored"))
        kept = table.rows().agg(F.count(F.lit(1)).alias("kept"))
        # Two rows of figures, made one by an aggregate.
        both = sums.select("landed", "stored", F.lit(None).cast("bigint").alias("kept")).unionByName(
            kept.select(F.lit(None).cast("bigint").alias("landed"), F.lit(None).cast("bigint").alias("stored"), "kept")
        )
        row = both.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("landed", "stored", "kept")])
        row = row.select(F.lit(name).alias("dataset"), "*")
        out = row if out is None else out.unionByName(row)
    return out


# --- publishing, resetting, contracts ------------------------------------------------------------


def silver_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(step, published, silver_rows, orders_rolled_up): what readers see after a good, a bad and a good version."""
    root = scratch_dir(spark, "publish")
    ns = Namespace(schema="strata_" + root.rsplit("-", 1)[-1])
    create_namespace(spark, ns, f"{root}/warehouse")
    create_declared_table(spark, ns, SILVER_SUMMARY)
    table = ns.qualified(SILVER_SUMMARY)
    customers, orders = bronze_customers_from_tables(spark, sf_dir), displaced_orders_from_tables(spark, sf_dir)
    inputs = [
        (customers, orders.where(F.col("order_date") < SPLIT)),
        (defective_customers_from_tables(spark, sf_dir), orders),
        (customers, orders),
    ]
    out = None
    for step, (c, o) in enumerate(inputs, 1):
        try:
            publish_silver(spark, table, customer_summary(c, o), c, o, SILVER_SUMMARY_DDL)
            published = True
        except NotPublished:
            published = False
        seen = spark.read.table(table).agg(
            F.count(F.lit(1)).alias("silver_rows"), F.coalesce(F.sum("total_orders"), F.lit(0)).alias("orders_rolled_up")
        )
        seen = staged(seen.select(F.lit(step).cast("bigint").alias("step"), F.lit(published).alias("published"), "*"), "publish-seen")
        out = seen if out is None else out.unionByName(seen)
    reset(spark, ns, root)
    return out


def reset_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table, rows, same, comment): each table after an update, and whether reset and another update gave the same."""
    root = scratch_dir(spark, "rerun")
    ns = Namespace(schema="strata_" + root.rsplit("-", 1)[-1])
    write_csv_drop(bronze_customers_from_tables(spark, sf_dir), f"{root}/landing/customers/drop-1")
    write_csv_drop(bronze_orders_from_tables(spark, sf_dir), f"{root}/landing/orders/drop-1")
    updates, comments = Updates(spark), []
    checkpoints = f"{root}/checkpoints"
    for n in ("first", "second"):
        customers, orders = drops_glob(f"{root}/landing/customers"), drops_glob(f"{root}/landing/orders")
        run_update(spark, customers, orders, ns, checkpoints, location=f"{root}/warehouse-{n}")
        tables = {t: spark.read.table(ns.qualified(t)) for t in (BRONZE_CUSTOMERS, BRONZE_ORDERS, SILVER_SUMMARY)}
        updates.record(n, tables)
        comments = [(t, spark.catalog.getTable(ns.qualified(t)).description) for t in tables]
        checkpoints = reset(spark, ns, root)
    told = spark.createDataFrame(comments, "_table STRING, comment STRING")
    same = updates.same("first", "second")
    return same.join(told, F.col("table") == F.col("_table"), "left").select("table", "rows", "same", "comment")


def schema_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared schema of orders against the sound table and one with a misnamed, a retyped and a strange column."""
    orders = bronze_orders_from_tables(spark, sf_dir)
    broken = orders.select(
        "order_id",
        F.col("customer_id").alias("customerid"),
        F.col("amount").cast("double").alias("amount"),
        F.when(F.col("order_date") < SPLIT, F.col("order_date")).alias("order_day"),
        F.lit(1).alias("note"),
    )
    sound = contract(orders, BRONZE_ORDERS_DDL).select(F.lit("sound").alias("frame"), "*")
    return sound.unionByName(contract(broken, BRONZE_ORDERS_DDL).select(F.lit("broken").alias("frame"), "*"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        metrics_verdict,
        metrics_failure_phases,
        landing_ledger,
        bronze_orders_replayed,
        ingest_counts,
        silver_publish,
        reset_rerun,
        schema_contracts,
    ]
    return {f.__name__: f for f in own}


_CYCLES = """
cycles AS (
  SELECT 'run-' || CAST(event_id // 2000 AS VARCHAR) AS run, event_id % 2000 + 1 AS cycle,
         CASE WHEN user_id % 10 = 0 AND event_type <> 'signup'
           THEN CASE event_id % 3 WHEN 0 THEN 'reset' WHEN 1 THEN 'seed' ELSE 'verify' END END AS phase,
         CAST(floor(value) AS BIGINT) AS reset
  FROM events
)"""

_METRICS_VERDICT = """
SELECT run, cycles, cycles_passed, cycles - cycles_passed AS flakes,
       m1 AS m1_all_pass, m2 AS m2_all_pass, cycles = cycles_passed AS m3_pass,
       blockers = '' AS ready, CASE WHEN blockers = '' THEN 'READY' ELSE 'NOT READY' END AS verdict, blockers
FROM (
  SELECT *, concat_ws('; ',
      CASE WHEN cycles > cycles_passed THEN CAST(cycles - cycles_passed AS VARCHAR) || ' flake(s) detected' END,
      CASE WHEN NOT m1 THEN 'm1 gate failed' END, CASE WHEN NOT m2 THEN 'm2 gate failed' END) AS blockers
  FROM (
    SELECT run, count(*) AS cycles, count(*) FILTER (WHERE phase IS NULL) AS cycles_passed,
           count(*) FILTER (WHERE phase IS NULL) > 0
             AND count(*) FILTER (WHERE phase IS NULL AND reset >= 120) = 0 AS m1,
           count(*) FILTER (WHERE phase IS NULL) > 0
             AND count(*) FILTER (WHERE phase IS NULL AND reset * 10 >= 1500) = 0 AS m2
    FROM cycles GROUP BY run
  ) x
) y"""

_PHASES = """
SELECT run, phase AS failure_phase, count(*) AS flakes, min(cycle) AS first_cycle,
       CAST(sum(reset * 10) AS BIGINT) AS seconds, count(*) AS notes
FROM cycles WHERE phase IS NOT NULL GROUP BY run, phase"""

_LEDGER = """
placed AS (
  SELECT CAST(order_id AS BIGINT) % 8 AS place, coalesce(order_date < '1998-01-01', false) AS older FROM bronze_orders
),
first_drop AS (SELECT place, count(*) AS n FROM placed WHERE older GROUP BY place),
second_drop AS (SELECT place, count(*) AS n FROM placed WHERE NOT older AND (place < 3 OR place >= 6) GROUP BY place),
states AS (
  SELECT 1 AS "drop", 'new' AS status, n FROM first_drop
  UNION ALL SELECT 2, 'new', n FROM second_drop s WHERE place >= 6 OR NOT EXISTS (SELECT 1 FROM first_drop f WHERE f.place = s.place)
  UNION ALL SELECT 2, 'changed', n FROM second_drop s WHERE place < 3 AND EXISTS (SELECT 1 FROM first_drop f WHERE f.place = s.place)
  UNION ALL SELECT 2, 'unchanged', 0 FROM first_drop f
    WHERE NOT (place < 3 AND EXISTS (SELECT 1 FROM second_drop s WHERE f.place = s.place))
  UNION ALL SELECT 3, 'unchanged', 0 FROM first_drop
  UNION ALL SELECT 3, 'unchanged', 0 FROM second_drop s
    WHERE place >= 6 OR NOT EXISTS (SELECT 1 FROM first_drop f WHERE f.place = s.place)
)
SELECT "drop", status, count(*) AS files, CAST(sum(n) AS BIGINT) AS rows FROM states GROUP BY "drop", status"""


def oracle_sql(customers: str, orders: str, displaced: str, defects: str, silver: Callable[..., str]) -> dict[str, str]:
    """From the CTEs of the landed tables; ``silver(orders, customers)`` is the roll-up over two of them."""
    counts = "SELECT '{0}' AS dataset, count(*) AS landed, count(*) AS stored, count(*) AS kept FROM bronze_{0}"
    comment = {t: COMMENTS[t].replace("'", "''") for t in COMMENTS}
    tables = " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", (SELECT count(*) FROM {source}) AS rows, true AS same, '{comment[t]}' AS comment"
        for t, source in (
            (BRONZE_CUSTOMERS, "bronze_customers"),
            (BRONZE_ORDERS, "bronze_orders"),
            (SILVER_SUMMARY, "bronze_customers"),
        )
    )
    publish = f"""
early AS (SELECT * FROM displaced_orders WHERE order_date < '{SPLIT}'),
one AS ({silver('early')}), two AS ({silver('displaced_orders', 'defective_customers')}), three AS ({silver('displaced_orders')}),
sums AS (
  SELECT 1 AS step, (SELECT count(*) FROM one) AS n, (SELECT sum(total_orders) FROM one) AS o, true AS good
  UNION ALL SELECT 2, (SELECT count(*) FROM two), (SELECT sum(total_orders) FROM two),
    (SELECT count(*) FROM two) = (SELECT count(DISTINCT id) FROM defective_customers)
  UNION ALL SELECT 3, (SELECT count(*) FROM three), (SELECT sum(total_orders) FROM three), true
)
SELECT a.step, a.good AS published, b.n AS silver_rows, CAST(b.o AS BIGINT) AS orders_rolled_up
FROM sums a JOIN sums b ON b.step = CASE WHEN a.good THEN a.step ELSE a.step - 1 END"""
    every, dated = "(SELECT count(*) FROM bronze_orders)", f"(SELECT count(*) FROM bronze_orders WHERE order_date < '{SPLIT}')"

    def filled(column: str) -> str:
        return f"(SELECT count({column}) FROM bronze_orders)"

    def field(frame, column, position, expected, actual, status, suggestion, edits, types, count) -> str:
        texts = ", ".join("NULL" if x is None else f"'{x}'" for x in (frame, column))
        kinds = ", ".join("NULL" if x is None else f"'{x}'" for x in (expected, actual, status, suggestion))
        numbers = ", ".join("NULL" if x is None else str(x) for x in (edits, types))
        return f"SELECT {texts}, {position}, {kinds}, {numbers}, {every if count else 'NULL'}, {count or 'NULL'}"

    text = "string"
    fields = [
        field("sound", c, i, text, text, "ok", None, None, 0, filled(c))
        for i, c in enumerate(["order_id", "customer_id", "amount", "order_date"])
    ]
    fields += [
        field("broken", "order_id", 0, text, text, "ok", None, None, 0, filled("order_id")),
        field("broken", "customer_id", 1, text, None, "missing", "customerid", 1, 0, None),
        field("broken", "amount", 2, text, "double", "retyped", None, None, 6, filled("amount")),
        field("broken", "order_date", 3, text, None, "missing", "order_day", 2, 0, None),
        field("broken", "customerid", 4, None, text, "unexpected", None, None, None, filled("customer_id")),
        field("broken", "order_day", 5, None, text, "unexpected", None, None, None, dated),
        field("broken", "note", 6, None, "int", "unexpected", None, None, None, every),
    ]
    names = 'frame, "column", position, expected, actual, status, suggestion, edits, type_distance, rows, filled'
    return {
        "metrics_verdict": f"WITH {_CYCLES} {_METRICS_VERDICT}",
        "metrics_failure_phases": f"WITH {_CYCLES} {_PHASES}",
        "landing_ledger": f"WITH {orders}, {_LEDGER}",
        "bronze_orders_replayed": f"WITH {orders} SELECT * FROM bronze_orders",
        "ingest_counts": f"WITH {customers}, {orders} {counts.format('customers')} UNION ALL {counts.format('orders')}",
        "silver_publish": f"WITH {customers}, {orders}, {displaced}, {defects}, {publish}",
        "reset_rerun": f"WITH {customers}, {orders} {tables}",
        "schema_contracts": f"WITH {orders} SELECT * FROM ({' UNION ALL '.join(fields)}) t({names})",
    }
