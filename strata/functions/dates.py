"""Order dates arrive as text, nearly always ISO ``yyyy-MM-dd``.

For ISO dates the text order is the calendar order, so the latest one is taken on
a DATE (a fixed-width int) in a hash aggregate; a string buffer would force a
sort-based aggregate over every order row. Texts that are not exactly ISO (none,
as a rule) are reduced apart, as strings, and the greater of the two counts: the
result is the string maximum, and no value of the declared type fails.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def iso_date_is_exact(c: str | Column) -> Column:
    """True where the text is exactly the ISO form of a date (round trip)."""
    c = _col(c)
    return c.try_cast("date").cast("string") == c


def latest_date_text(iso: Column, other: Column) -> Column:
    """The string maximum of the latest ISO date and the greatest other text."""
    return F.greatest(iso.cast("string"), other)
