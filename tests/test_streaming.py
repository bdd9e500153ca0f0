"""Streaming ingest behaviour: each file once, reruns add nothing, reset needs a new checkpoint."""

import os

import pytest

from strata.schemas import BRONZE_CUSTOMERS_DDL, BRONZE_ORDERS_DDL, struct
from strata.sources.landing import read_landing, read_landing_stream
from strata.streaming.ingest import ingest
from tests.conftest import write_csv
from tests.fixtures import CUSTOMER_ROWS, CUSTOMERS_HEADER, ORDER_ROWS, ORDERS_HEADER


def _run(spark, landing, ckpt, sink, ddl=BRONZE_ORDERS_DDL):
    ingest(read_landing_stream(spark, landing, ddl), ckpt, path=sink)
    return spark.read.parquet(sink).count()


def test_rerun_adds_nothing_and_a_new_drop_adds_only_its_rows(spark, workdir):
    landing, ckpt, sink = f"{workdir}/orders", f"{workdir}/ckpt", f"{workdir}/sink"
    write_csv(f"{landing}/a.csv", ORDERS_HEADER, ORDER_ROWS[:4])
    assert _run(spark, landing, ckpt, sink) == 4
    assert _run(spark, landing, ckpt, sink) == 4
    write_csv(f"{landing}/b.csv", ORDERS_HEADER, ORDER_ROWS[4:])
    assert _run(spark, landing, ckpt, sink) == 6
    # Two drops streamed equal the batch read of the same folder.
    batch = read_landing(spark, landing, BRONZE_ORDERS_DDL)
    streamed = spark.read.parquet(sink)
    assert batch.exceptAll(streamed).count() == 0 and streamed.exceptAll(batch).count() == 0


def test_same_path_overwrite_is_not_read_again(spark, workdir):
    landing, ckpt, sink = f"{workdir}/orders", f"{workdir}/ckpt", f"{workdir}/sink"
    write_csv(f"{landing}/a.csv", ORDERS_HEADER, ORDER_ROWS[:3])
    assert _run(spark, landing, ckpt, sink) == 3
    write_csv(f"{landing}/a.csv", ORDERS_HEADER, ORDER_ROWS)
    assert _run(spark, landing, ckpt, sink) == 3


def test_misnamed_header_fails_the_read(spark, workdir):
    landing, ckpt, sink = f"{workdir}/orders", f"{workdir}/ckpt", f"{workdir}/sink"
    write_csv(f"{landing}/a.csv", "order_id,customerid,amount,order_date", ORDER_ROWS)
    with pytest.raises(Exception, match="customer"):
        _run(spark, landing, ckpt, sink)
    with pytest.raises(Exception, match="customer"):
        read_landing(spark, landing, BRONZE_ORDERS_DDL).collect()


def test_tables_dropped_with_old_checkpoint_come_back_empty(spark, workdir):
    landing = f"{workdir}/customers"
    write_csv(f"{landing}/a.csv", CUSTOMERS_HEADER, CUSTOMER_ROWS)
    assert _run(spark, landing, f"{workdir}/ckpt", f"{workdir}/sink1", BRONZE_CUSTOMERS_DDL) == 5
    # Same checkpoint, fresh sink: every file counts as read already.
    ingest(read_landing_stream(spark, landing, BRONZE_CUSTOMERS_DDL), f"{workdir}/ckpt", path=f"{workdir}/sink2")
    sink2 = f"{workdir}/sink2"
    assert not os.path.exists(sink2) or spark.read.schema(struct(BRONZE_CUSTOMERS_DDL)).parquet(sink2).count() == 0
    # A new checkpoint reads everything again.
    assert _run(spark, landing, f"{workdir}/ckpt-new", f"{workdir}/sink3", BRONZE_CUSTOMERS_DDL) == 5


def test_bounded_batches_and_archive(spark, workdir):
    landing, ckpt, sink, archive = f"{workdir}/in/orders", f"{workdir}/ckpt", f"{workdir}/sink", f"{workdir}/archive"
    for i, row in enumerate(ORDER_ROWS):
        write_csv(f"{landing}/f{i}.csv", ORDERS_HEADER, [row])
    stream = read_landing_stream(spark, landing, BRONZE_ORDERS_DDL, max_files_per_trigger=2, archive_dir=archive)
    ingest(stream, ckpt, path=sink)
    assert spark.read.parquet(sink).count() == len(ORDER_ROWS)
    again = read_landing_stream(spark, landing, BRONZE_ORDERS_DDL, max_files_per_trigger=2, archive_dir=archive)
    ingest(again, ckpt, path=sink)
    assert spark.read.parquet(sink).count() == len(ORDER_ROWS)
