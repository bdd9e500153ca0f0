"""Amounts arrive as text; totals are summed exactly and cast once.

Summing doubles depends on the order rows arrive in; summing DECIMAL(18,2) does
not, so totals are equal on any cluster layout and against any other engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the declared money type (two digits after the point).
AMOUNT_TYPE = "decimal(18,2)"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def amount_value(c: str | Column) -> Column:
    """Text amount as DECIMAL(18,2). Under ANSI a bad value fails the query."""
    return _col(c).cast(AMOUNT_TYPE)


def amount_is_bad(c: str | Column) -> Column:
    """True where a non-null amount does not parse as, or does not fit, the money type."""
    c = _col(c)
    return c.isNotNull() & c.try_cast(AMOUNT_TYPE).isNull()


def amount_has_excess_scale(c: str | Column) -> Column:
    """True where an amount has more than two digits after the point (it gets rounded)."""
    wide = _col(c).try_cast("decimal(38,18)")
    money = _col(c).try_cast(AMOUNT_TYPE)
    return F.coalesce(wide != money, F.lit(False))


def money_to_double(c: str | Column) -> Column:
    """The declared DOUBLE of an exact money total."""
    return _col(c).cast("double")
