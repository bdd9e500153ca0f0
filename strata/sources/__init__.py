"""Sources: CSV landing folders (batch and streaming), and the
test-table fixtures."""

from strata.sources.landing import read_landing, read_landing_stream
from strata.sources.tables import (
    load,
    bronze_customers_from_tables,
    bronze_orders_from_tables,
    displaced_orders_from_tables,
    runs_from_events,
)

__all__ = [
    "read_landing",
    "read_landing_stream",
    "load",
    "bronze_customers_from_tables",
    "bronze_orders_from_tables",
    "displaced_orders_from_tables",
    "runs_from_events",
]
