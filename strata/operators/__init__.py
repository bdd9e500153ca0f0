"""Operators: the silver roll-up, preview, exact median and run gates."""

from strata.operators.rollup import customer_summary, per_customer_orders
from strata.operators.preview import preview

__all__ = ["customer_summary", "per_customer_orders", "preview"]
