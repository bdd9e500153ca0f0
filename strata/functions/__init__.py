"""Column expressions shared by the operators (all JVM-side, codegen-friendly)."""

from strata.functions.money import (
    AMOUNT_TYPE,
    amount_value,
    amount_is_bad,
    amount_has_excess_scale,
    money_to_double,
)
from strata.functions.dates import iso_date_is_exact, latest_date_text

__all__ = [
    "AMOUNT_TYPE",
    "amount_value",
    "amount_is_bad",
    "amount_has_excess_scale",
    "money_to_double",
    "iso_date_is_exact",
    "latest_date_text",
]
