"""Append-only bronze ingest with Structured Streaming.

A triggered run (``availableNow``) reads every file that arrived since the
last run, in as many micro-batches as the source limits allow, then stops.
The checkpoint records which files were read and which batches committed,
so a rerun adds nothing, a new drop adds only its rows, and a failed batch
is replayed without duplicates. A checkpoint and the table it feeds live and
die together: drop the table and the old checkpoint would skip every file.
"""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def start_ingest(
    stream: DataFrame,
    checkpoint: str,
    *,
    table: str | None = None,
    path: str | None = None,
    fmt: str = "parquet",
    name: str | None = None,
) -> StreamingQuery:
    """Start an ``availableNow`` append of ``stream`` into a table or a path."""
    if (table is None) == (path is None):
        raise ValueError("give exactly one of table= or path=")
    writer = (
        stream.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    if name:
        writer = writer.queryName(name)
    if table is not None:
        return writer.toTable(table)
    return writer.format(fmt).start(path)


def await_all(queries: list[StreamingQuery]) -> None:
    """Wait for every triggered run to end; then raise the first failure."""
    failed = None
    for q in queries:
        try:
            q.awaitTermination()
        except StreamingQueryException as e:
            failed = failed or e
    if failed is not None:
        raise failed


def ingest(stream: DataFrame, checkpoint: str, **target) -> None:
    """One triggered run to completion."""
    await_all([start_ingest(stream, checkpoint, **target)])
