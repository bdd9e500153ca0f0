"""Consumer preview: the first rows of a table in a stable order.

``LIMIT n`` without an order returns whichever rows arrive first; ordering by
the key makes it repeatable. Spark plans ``orderBy(...).limit(n)`` as a
top-k (``TakeOrderedAndProject``): each partition keeps n rows, so nothing
but n rows per task reaches the final merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Fixed value: rows in the consumer preview.
PREVIEW_ROWS = 10


def preview(df: DataFrame, key: str = "id", n: int = PREVIEW_ROWS) -> DataFrame:
    return df.orderBy(key).limit(n)
