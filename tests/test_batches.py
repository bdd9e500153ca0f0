import pytest
from pyspark.errors import StreamingQueryException

from strata.schemas import BRONZE_ORDERS_DDL
from strata.sources.landing import read_landing_stream
from strata.streaming.batches import BatchTable
from tests.conftest import write_csv
from tests.fixtures import ORDER_ROWS, ORDERS_HEADER


def _run(spark, table, workdir, checkpoint, between=None, most=None):
    stream = read_landing_stream(spark, f"{workdir}/landing", BRONZE_ORDERS_DDL, max_files_per_trigger=most)
    table.start(stream, f"{workdir}/{checkpoint}", between).awaitTermination()


def _ids(table):
    return sorted(r["order_id"] for r in table.rows().collect())


def _crash():
    raise RuntimeError("crash")


@pytest.fixture
def table(spark, workdir):
    write_csv(f"{workdir}/landing/a.csv", ORDERS_HEADER, ORDER_ROWS[:3])
    write_csv(f"{workdir}/landing/b.csv", ORDERS_HEADER, ORDER_ROWS[3:])
    return BatchTable(spark, f"{workdir}/orders", BRONZE_ORDERS_DDL)


WANT = sorted(r.split(",")[0] for r in ORDER_ROWS)


def test_a_crash_between_rows_and_entry_is_replayed_once(spark, workdir, table):
    assert _ids(table) == []
    with pytest.raises(StreamingQueryException):
        _run(spark, table, workdir, "c", _crash)
    assert _ids(table) == []
    _run(spark, table, workdir, "c")
    assert _ids(table) == WANT
    assert [(r["files"], r["landed"], r["stored"]) for r in table.counts().collect()] == [(2, len(WANT), len(WANT))]


def test_a_new_checkpoint_adds_only_what_is_new(spark, workdir, table):
    _run(spark, table, workdir, "c", most=1)
    assert table.counts().count() == 2
    write_csv(f"{workdir}/landing/c.csv", ORDERS_HEADER, ["70,5,1.00,2025-01-01"])
    _run(spark, table, workdir, "other")
    assert _ids(table) == sorted([*WANT, "70"])
    _run(spark, table, workdir, "c")
    assert _ids(table) == sorted([*WANT, "70"])


def test_a_crash_then_other_batches_leave_no_rows_behind(spark, workdir, table):
    # The crashed batch held both files, the next ones hold one each: its rows are never read.
    with pytest.raises(StreamingQueryException):
        _run(spark, table, workdir, "c", _crash)
    _run(spark, table, workdir, "other", most=1)
    assert _ids(table) == WANT
